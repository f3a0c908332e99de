"""Operator 1: exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text is cut at content-defined places: a cheap pattern proposes cuts, and the hash of the
piece before a proposed cut decides whether it is one, so an edit moves only the cuts beside
it. Chunks get 64-bit identifiers that are verified over the whole corpus before use: each
distinct chunk text crosses the network once, to the identifier it claims, and if two texts
claim the same one all identifiers are drawn anew with another salt. After that a text is its
short ordered list of identifiers (its recipe), and only recipes are grouped and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, numbered, stage

#: The white space that equality ignores, [\x20\x09-\x0D].
WHITE_SPACE = " \n\t\r\x0b\x0c"
#: A cut may follow a letter, digit or last byte of a letter whose low three bits are 011: whatever the script, they tell a
#: letter from its neighbours, so an eighth of its letters are among them. The hash keeps so many of the places (a power of two).
PROPOSE = "(?<=[3CKScks\u0083\u008b\u0093\u009b\u00a3\u00ab\u00b3\u00bb])"
KEEP_ONE_IN = 32


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(norm: Column) -> Column:
    """Content-defined chunks of a normalised text's UTF-8 bytes, in order; they concatenate to it. A byte stands as one character."""
    pieces = F.split(F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1"), PROPOSE)
    # A line feed can't stand in a normalised text, so it can mark the cuts.
    marked = F.transform(pieces, lambda s: F.when(F.xxhash64(s).bitwiseAND(KEEP_ONE_IN - 1) == 0, F.concat(s, F.lit("\n"))).otherwise(s))
    return F.split(F.array_join(marked, ""), "\n")


def _identifier(chunk: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), chunk)


def verified_salt(cut: DataFrame) -> int:
    """The first salt under which no two different chunks of ``cut`` (column chunks) share an identifier."""
    salt = 0
    while True:
        found = cut.select(F.explode("chunks").alias("chunk")).select(_identifier(F.col("chunk"), salt).alias("id"), "chunk")
        clash = found.groupBy("id", "chunk").agg(F.lit(1).alias("one")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        if clash.isEmpty():
            return salt
        salt += 1


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, columns ``more``, n_points, text_sha256 and the recipe, a list of verified identifiers.

    Texts are cut once, into a table in the shared folder; identifiers are verified and recipes read from there.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), *more, F.coalesce(F.length(text_col), F.lit(0)).alias("n_points"), normalised(F.col(text_col)).alias("norm"))
    cut = stage(base.select("doc_id", *more, "n_points", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks")), "chunks")
    salt = verified_salt(cut.select("chunks"))
    return stage(cut.select("doc_id", *more, "n_points", "text_sha256", F.transform("chunks", lambda c: _identifier(c, salt)).alias("recipe")), "recipes")


def _order(*more: str) -> Column:
    """Order of the rows of a group: the most code points first, then the smallest id, null ids last."""
    return F.struct((-F.col("n_points")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *more)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are equal apart from white space.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. The row with
    the most code points in its original text stays, then the smallest id. A null text counts
    as empty; empty texts are equal to each other. A null id never stays while another row of
    the group has an id. Rows that repeat an id and a text are all marked as the id is. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = recipes(docs, id_col, text_col).withColumn("h", F.xxhash64("recipe"))
    groups = rows.groupBy("h", "recipe").agg(F.count("*").alias("n"), F.min(_order()).alias("best")).where("n > 1")
    groups = groups.select("h", "recipe", F.col("n").alias("group_n"), F.col("best.id").alias("best_id"))
    groups = stage(groups, "groups")  # so that both sides of the join are plain exchanges, which Spark can split where a key is hot
    joined = rows.join(groups, ["h", "recipe"], "left")
    keep = F.when(F.col("group_n").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_dedup` keeps; of rows that repeat an id and a text one.

    Ids may be of any type that has an order. A row is told from others by a number of its own, so texts under a repeated or
    null id are not lost. Columns may have any names but ``_row``. An empty table gives an empty one.
    """
    rows = numbered(docs, "exact-rows")
    found = recipes(rows, id_col, text_col, (ROW,)).withColumn("h", F.xxhash64("recipe"))
    groups = found.groupBy("h", "recipe").agg(F.count("*").alias("n"), F.min(_order(ROW)).alias("best")).where("n > 1").select("h", "recipe", F.col(f"best.{ROW}").alias("stays"))
    gone = found.join(stage(groups, "groups"), ["h", "recipe"]).where(F.col(ROW) != F.col("stays")).select(ROW)
    return rows.join(stage(gone, "copies"), ROW, "left_anti").drop(ROW)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole text."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
