"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.staging import shared_dir, small_batches, stage  # noqa: F401


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Column that tells rows apart, whatever their ids.
ROW = "_row"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, written with a unique number per row, so that the number holds whenever the rows are read."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def without_others(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (numbered) less all but one of each group: the smallest id stays, null ids last, then the first row.

    ``groups`` has node (a row's number) and root; rows in no group stay.
    """
    order = F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("id"), F.col(ROW).alias("row"))
    placed = rows.select(F.col(ROW).alias("node"), order.alias("o")).join(groups, "node")
    best = stage(placed.groupBy("root").agg(F.min("o").alias("best")), "best")
    gone = stage(placed.join(best.select("root", F.col("best.row").alias("stays")), "root").where("node <> stays").select(F.col("node").alias(ROW)), "others")
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def utf8(text: str | None) -> bytes:
    """A text's UTF-8 bytes; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "replace")


def crc_fold(column: str, folds: int) -> F.Column:
    """crc32 of a key, written as text, modulo ``folds``; a null key falls into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(0))
