"""Queries on text: filters, citations, terms, previews, tiling, bill titles and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import extract as X
from corpusloom.operators import outcomes as O
from corpusloom.plans.registry import Registry
from corpusloom.sources import bridge
from corpusloom.sources.bridge import BILLS_SQL, SECTIONS_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

#: Sentences that each document yields; the tables hold no references of their own.
LEGAL = "'See Section ' || doc_id % 40 || '.' || doc_id % 9 || CASE doc_id % 4 WHEN 0 THEN ' to 9.' || doc_id % 5 ELSE '' END || ' and § ' || n_chars % 300 || '. Ord. ' || n_chars % 400 || '-' || CASE doc_id % 3 WHEN 0 THEN '98' WHEN 1 THEN '23' ELSE '2015' END || ', File No. ' || doc_id || ', App. ' || (doc_id % 14) || '/' || (n_chars % 33) || '/' || CASE doc_id % 2 WHEN 0 THEN '15' ELSE '2023' END || '.'"


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(LEGAL).alias("sentence"))


@query(f"""WITH l AS (SELECT doc_id, {LEGAL} AS sentence FROM documents),
e AS (SELECT doc_id, unnest(regexp_extract_all(sentence, '{X.CITATION}', 0)) AS display, generate_subscripts(regexp_extract_all(sentence, '{X.CITATION}', 0), 1) - 1 AS position FROM l),
p AS (SELECT doc_id, CAST(position AS INTEGER) AS position, display, regexp_extract(display, '{X.CITATION}', 2) AS first, nullif(regexp_extract(display, '{X.CITATION}', 3), '') AS last FROM e)
SELECT *, CASE WHEN last IS NOT NULL AND length(first) - length(replace(first, '.', '')) = length(last) - length(replace(last, '.', '')) THEN 'range' ELSE 'single' END AS kind FROM p""")
def citation_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in every sentence with their targets; expressions only."""
    found = legal(spark, sf_dir).select("doc_id", F.posexplode(X.citations(F.col("sentence"))).alias("position", "c"))
    return found.select("doc_id", "position", "c.display", "c.first", "c.last", X.target_kind(F.col("c.first"), F.col("c.last")).alias("kind"))


#: One row per section with an ordinance: number, year, file, app, approved (DuckDB).
ORDINANCES_SQL = f"""l AS (SELECT doc_id, source, {LEGAL} AS s FROM documents),
m AS (SELECT doc_id, source, regexp_extract(s, '{X.ORDINANCE}', 1) AS number, regexp_extract(s, '{X.ORDINANCE}', 2) AS file, regexp_extract(s, '{X.ORDINANCE}', 3) AS app FROM l),
y AS (SELECT *, CAST(split_part(number, '-', 2) AS INTEGER) AS n, length(split_part(number, '-', 2)) AS d FROM m),
z AS (SELECT *, CASE WHEN d = 4 THEN n WHEN n >= 90 THEN n + 1900 ELSE n + 2000 END AS year, CAST(split_part(app, '/', 1) AS INTEGER) AS mo, CAST(split_part(app, '/', 2) AS INTEGER) AS da, CAST(split_part(app, '/', 3) AS INTEGER) AS ye FROM y),
i AS (SELECT *, CASE WHEN mo BETWEEN 1 AND 12 AND da BETWEEN 1 AND 31 THEN CAST(CASE WHEN ye < 100 THEN year // 100 * 100 + ye ELSE ye END AS VARCHAR) || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(da AS VARCHAR), 2, '0') END AS approved FROM z)"""


def ordinances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinance that each section's history names: doc_id, source, number, file, app, year, approved."""
    s = F.col("sentence")
    rows = legal(spark, sf_dir).select("doc_id", "source", *[F.regexp_extract(s, X.ORDINANCE, k).alias(n) for k, n in ((1, "number"), (2, "file"), (3, "app"))])
    rows = rows.withColumn("year", X.ordinance_year(F.col("number")))
    return rows.withColumn("approved", X.iso_date(F.col("app"), F.col("year")))


@query(f"""WITH {ORDINANCES_SQL}
SELECT number, min(year) AS year, arg_min(file, doc_id) AS file_no, arg_min(approved, doc_id) FILTER (approved IS NOT NULL) AS approved_at, count(DISTINCT source || '::' || doc_id) AS n_cited_in FROM i GROUP BY number""")
def ordinance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinances by number: year, file, the first known date, and how many sections cite each."""
    rows = ordinances(spark, sf_dir)
    known = F.min_by("approved", F.when(F.col("approved").isNotNull(), F.col("doc_id")))
    return rows.groupBy("number").agg(F.min("year").alias("year"), F.min_by("file", "doc_id").alias("file_no"), known.alias("approved_at"), F.countDistinct("source", "doc_id").alias("n_cited_in"))


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, module_id || '/' || section_id || '#' || left(sha256(regexp_replace(trim(title), '[ \\t\\n]+', ' ', 'g')), 8) AS def_id FROM sections")
def definition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.sections(spark, sf_dir).select("doc_id", X.definition_id(F.col("module_id"), F.col("section_id"), F.col("title")).alias("def_id"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')) AS flat FROM documents), h AS (SELECT *, left(flat, 180) AS head FROM f), s AS (SELECT *, 180 - strpos(reverse(head), ' ') AS space FROM h)
SELECT doc_id, CASE WHEN length(flat) <= 180 THEN flat ELSE CASE WHEN space >= 140 THEN left(head, space) ELSE head END || '…' END AS preview FROM s""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, CAST(doc_id % 4100 AS INTEGER) AS n, CASE WHEN doc_id % 4100 BETWEEN 1 AND 3999 THEN
 repeat('M', CAST(doc_id % 4100 // 1000 AS INTEGER)) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][doc_id % 4100 // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][doc_id % 4100 // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][doc_id % 10 + 1] END AS numeral FROM documents""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 4100).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), X.roman(n).alias("numeral"))


#: The glossary that the recogniser's queries look for.
GLOSSARY = ("the", "of the", "of", "and", "la", "le", "der", "die", "los", "el")


@query("SELECT doc_id, text AS flattened FROM documents")
def tiling_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts tiled by glossary terms and flattened again; every text must come back whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    segments = X.tile(X.recognise(d, list(GLOSSARY)), d)
    flat = segments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "raw"))), lambda x: x["raw"]), "").alias("flattened"))
    return d.select("doc_id").join(flat, "doc_id", "left").select("doc_id", F.coalesce("flattened", F.lit("")).alias("flattened"))



@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_])(the|of)', 0)) AS INTEGER) AS n FROM documents WHERE len(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_])(the|of)', 0)) > 0""")
def term_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often words of each document begin like a term."""
    n = F.size(F.regexp_extract_all("text", F.lit("(?:^|[^0-9A-Za-z_])(the|of)"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query(f"WITH {BILLS_SQL} SELECT file_no, status, introduced IS NULL OR introduced BETWEEN '1995-01-01' AND '1996-12-31' OR (introduced < '1995-01-01' AND status IN ('filed', 'committee', 'engrossed', 'floor', 'enrolled')) AS in_session FROM states")
def session_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills' states, mapped from free text, and whether each belongs to a session."""
    b = bridge.bills(spark, sf_dir).withColumn("status", O.bill_status(F.col("status_text")))
    return b.select("file_no", "status", O.in_session(F.col("introduced"), F.col("status"), "1995-01-01", "1996-12-31").alias("in_session"))


@query("SELECT c_custkey, c_name FROM customer WHERE len(list_filter(string_split(lower(c_mktsegment || ' ' || c_name), ' '), lambda t: starts_with(t, 'auto'))) > 0")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which any word begins with what was typed."""
    tokens = F.split(F.lower(F.concat_ws(" ", "c_mktsegment", "c_name")), " ")
    return table(spark, sf_dir, "customer").where(F.exists(tokens, lambda t: F.startswith(t, F.lit("auto")))).select("c_custkey", "c_name")


#: The answers that the verifier's queries judge: each assistant turn with cites of its own.
ANSWER = "text || ' [src' || conv_id % 25 || ' § ' || conv_id % 60 || '] [Bill #' || (1000 + turn) || ']'"


@query(f"""WITH a AS (SELECT conv_id, turn, {ANSWER} AS answer FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, regexp_extract(answer, '{X.QUALIFIED}', 1) AS module_id, regexp_extract(answer, '{X.QUALIFIED}', 2) AS section_id, regexp_extract(answer, '{X.BILL}', 1) AS bill FROM a),
f AS (SELECT DISTINCT source AS module_id, CAST(doc_id % 40 AS VARCHAR) AS section_id, true AS fetched FROM documents)
SELECT conv_id, turn, module_id, section_id, bill, coalesce(fetched, false) AS fetched, CASE WHEN module_id = '' THEN 'no_citations' WHEN fetched IS NULL THEN 'not_fetched' ELSE 'valid' END AS verdict
FROM c LEFT JOIN f USING (module_id, section_id)""")
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what each answer cites was fetched, and its verdict."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(ANSWER).alias("answer"))
    c = a.select("conv_id", "turn", *[F.regexp_extract("answer", p, k).alias(n) for p, k, n in ((X.QUALIFIED, 1, "module_id"), (X.QUALIFIED, 2, "section_id"), (X.BILL, 1, "bill"))])
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("module_id"), (F.col("doc_id") % 40).cast("string").alias("section_id")).distinct()
    joined = c.join(d.withColumn("fetched", F.lit(True)), ["module_id", "section_id"], "left")
    verdict = F.when(F.col("module_id") == "", "no_citations").when(F.col("fetched").isNull(), "not_fetched").otherwise("valid")
    return joined.select("conv_id", "turn", "module_id", "section_id", "bill", F.coalesce("fetched", F.lit(False)).alias("fetched"), verdict.alias("verdict"))
