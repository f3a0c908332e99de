"""Order-dependent results that stay parallel when one group holds a large share of all rows.

Rows of a group are ordered inside slices of their sort key (its first characters); what a slice
needs from the others is a count or its outermost rows, and those are one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sliced(rows: DataFrame, group: str, key: Column, width: int) -> DataFrame:
    return rows.withColumns({"_key": key, "_slice": F.left(key, F.lit(width))})


def places(rows: DataFrame, group: str, key: Column, tie: str, width: int, name: str = "place") -> DataFrame:
    """``rows`` with each one's place in its group, from 1, in the order of (key, tie)."""
    sliced = _sliced(rows, group, key, width)
    before = F.expr(f"sum(n) over (partition by {group} order by _slice rows between unbounded preceding and current row) - n")
    sizes = sliced.groupBy(group, "_slice").agg(F.count("*").alias("n")).select(group, "_slice", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_key", tie))
    return sliced.withColumn("_inside", inside).join(sizes, [group, "_slice"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_key", "_slice", "_inside", "_before")


def neighbours(rows: DataFrame, group: str, key: Column, value: str, width: int) -> DataFrame:
    """``rows`` with the ``value`` of the row before and after each in its group, in the order of (key, value)."""
    sliced = _sliced(rows, group, key, width)
    order = F.struct("_key", value)
    edges = sliced.groupBy(group, "_slice").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    w = Window.partitionBy(group).orderBy("_slice")
    edges = edges.select(group, "_slice", F.lag(f"last.{value}").over(w).alias("_prior"), F.lead(f"first.{value}").over(w).alias("_next"))
    inside = Window.partitionBy(group, "_slice").orderBy("_key", value)
    out = sliced.withColumns({"_lag": F.lag(value).over(inside), "_lead": F.lead(value).over(inside)}).join(edges, [group, "_slice"])
    return out.withColumns({"previous": F.coalesce("_lag", "_prior"), "following": F.coalesce("_lead", "_next")}).drop("_key", "_slice", "_lag", "_lead", "_prior", "_next")


def value_at(rows: DataFrame, group: str, value: str, share: float, cells: int = 1000, name: str = "value") -> DataFrame:
    """Per group the value at index floor(share * n) of its sorted values, counting from 0 (the last at most).

    Values are counted in cells of equal width between the group's least and largest; only the cell
    that holds the index is sorted.
    """
    known = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    span = known.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    celled = known.join(span, group).withColumn("cell", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)).otherwise(0))
    sizes = celled.groupBy(group, "cell").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    upto = F.expr(f"sum(c) over (partition by {group} order by cell)")
    held = sizes.withColumn("upto", upto).withColumn("at", F.least(F.floor(F.col("n") * share), F.col("n") - 1))
    held = held.where("upto > at and upto - c <= at").select(group, "cell", (F.col("at") - (F.col("upto") - F.col("c")) + 1).alias("rank"))
    inside = celled.join(held, [group, "cell"]).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("v")))
    return inside.where("place = rank").select(group, F.col("v").alias(name))
