"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _stars(pairs: DataFrame, keep: F.Column) -> tuple[DataFrame, DataFrame]:
    """Link every neighbour that satisfies ``keep`` to the smallest of its centre's neighbourhood; also the table of these."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    least = stage(least, "least")  # so that both sides of the join are plain exchanges, which Spark can split at a hub
    return pairs.join(least, "u").where(keep), least


def connected_components(links: DataFrame) -> DataFrame:
    """Label every linked node with the smallest node that it reaches.

    ``links`` has two columns of one orderable type, in any order and with repeats; rows with
    a null end and self-links carry no information and are ignored. Returns ``node, root`` for
    every node with a link, roots included. An empty table gives an empty table.

    Each round is two aggregations with map-side minima and two joins, written to the shared
    folder; the driver sees a row count and a checksum only. Rounds grow with the logarithm of
    the longest path.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    edges = stage(edges.where("not x and not y and u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, least = _stars(both, F.expr("v > u"))
        large = stage(star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        discard(edges, least)
        star, least = _stars(large, F.lit(True))
        star = star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stage(star.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        discard(large, least)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
