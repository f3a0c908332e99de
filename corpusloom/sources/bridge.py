"""Corpus-shaped views over the driver's tables.

The tables hold no law, so sections, modules and citations are derived from them by
expressions that Spark and DuckDB both evaluate. Each view has a DataFrame form and a SQL
form with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Editorial statuses, in the order in which the bridge assigns them.
STATUSES = ("reserved", "repealed", "redesignated")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section per document: module_id, section_id, title, text, article, hierarchy level 2, status."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    status = F.when(n % 13 == 0, "reserved").when(n % 13 == 1, "repealed").when(n % 13 == 2, "redesignated").otherwise("active")
    return d.select(
        F.col("source").alias("module_id"),
        n,
        F.concat((n % 40).cast("string"), F.lit("."), F.expr("doc_id div 40").cast("string")).alias("section_id"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        "text",
        F.col("lang").alias("chapter"),
        F.concat(F.lit("article-"), (n % 7).cast("string")).alias("article_id"),
        status.alias("editorial_status"),
    )


SECTIONS_SQL = """
sections AS (
  SELECT source AS module_id, doc_id,
         CAST(doc_id % 40 AS VARCHAR) || '.' || CAST(doc_id // 40 AS VARCHAR) AS section_id,
         split_part(text, chr(10), 1) AS title, text, lang AS chapter,
         'article-' || CAST(doc_id % 7 AS VARCHAR) AS article_id,
         CASE doc_id % 13 WHEN 0 THEN 'reserved' WHEN 1 THEN 'repealed' WHEN 2 THEN 'redesignated' ELSE 'active' END AS editorial_status
  FROM documents)
"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges: each order's line items cite parts; (citing_id, position, cited_id, kind)."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "cross_module").when(F.col("l_returnflag") == "A", "vague").otherwise("internal")
    return li.select(F.col("l_orderkey").alias("citing_id"), F.col("l_linenumber").cast("int").alias("citation_index"), F.col("l_partkey").alias("cited_id"), kind.alias("target_kind"))


CITATIONS_SQL = """
citations AS (
  SELECT l_orderkey AS citing_id, CAST(l_linenumber AS INTEGER) AS citation_index, l_partkey AS cited_id,
         CASE l_returnflag WHEN 'R' THEN 'cross_module' WHEN 'A' THEN 'vague' ELSE 'internal' END AS target_kind
  FROM lineitem)
"""


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bill per order: file_no, sponsor, status text, introduced (ISO date), priority."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("sponsor"))
    state, priority = F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1))
    text = (
        F.when((state == "F") & (priority == "1"), "Signed by Mayor").when((state == "F") & (priority == "2"), "Vetoed by Mayor").when((state == "F") & (priority == "3"), "Tabled").when(state == "F", "Withdrawn")
        .when((state == "P") & (priority == "1"), "Awaiting Mayor's signature").when((state == "P") & (priority == "2"), "Second Reading").when(state == "P", "Passed Committee")
        .when(priority == "1", "Pending Committee Hearing").when(priority == "2", "Introduced").otherwise("Unscheduled")
    )
    return o.join(c, "o_custkey").select(F.col("o_orderkey").alias("file_no"), "sponsor", text.alias("status_text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("introduced"))


BILLS_SQL = """
bills AS (
  SELECT o_orderkey AS file_no, c_name AS sponsor, CASE
    WHEN o_orderstatus = 'F' THEN CASE left(o_orderpriority, 1) WHEN '1' THEN 'Signed by Mayor' WHEN '2' THEN 'Vetoed by Mayor' WHEN '3' THEN 'Tabled' ELSE 'Withdrawn' END
    WHEN o_orderstatus = 'P' THEN CASE left(o_orderpriority, 1) WHEN '1' THEN 'Awaiting Mayor''s signature' WHEN '2' THEN 'Second Reading' ELSE 'Passed Committee' END
    ELSE CASE left(o_orderpriority, 1) WHEN '1' THEN 'Pending Committee Hearing' WHEN '2' THEN 'Introduced' ELSE 'Unscheduled' END END AS status_text,
    strftime(o_orderdate, '%Y-%m-%d') AS introduced
  FROM orders JOIN customer ON o_custkey = c_custkey),
states AS (SELECT *, CASE status_text WHEN 'Signed by Mayor' THEN 'enacted' WHEN 'Vetoed by Mayor' THEN 'vetoed' WHEN 'Tabled' THEN 'failed' WHEN 'Withdrawn' THEN 'withdrawn'
    WHEN 'Awaiting Mayor''s signature' THEN 'enrolled' WHEN 'Second Reading' THEN 'floor' WHEN 'Passed Committee' THEN 'engrossed' WHEN 'Pending Committee Hearing' THEN 'committee' ELSE 'filed' END AS status FROM bills)
"""


def arrival() -> Column:
    """Where a row stands in a table as it is read: its file by name, and its number in the file."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def outcomes(spark: SparkSession, sf_dir: str, arrivals: bool = False) -> DataFrame:
    """Section outcomes: one per line item; file_no, section_id, position, status, words changed; with ``arrivals`` also arrival, which puts rows at one position in the table's order."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "anchored").when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "no_changes").otherwise("added_section")).otherwise(F.when(F.col("l_linenumber") % 3 == 0, "no_baseline").when(F.col("l_linenumber") % 3 == 1, "absorbed_external").otherwise("unresolved"))
    return li.select(F.col("l_orderkey").alias("file_no"), F.col("l_partkey").alias("section_id"), F.col("l_linenumber").cast("int").alias("position"), status.alias("status"), F.col("l_quantity").cast("long").alias("n_words"), *([arrival().alias("arrival")] if arrivals else []))


OUTCOMES_SQL = """
outcomes AS (
  SELECT l_orderkey AS file_no, l_partkey AS section_id, CAST(l_linenumber AS INTEGER) AS position,
    CASE l_returnflag WHEN 'A' THEN 'anchored' WHEN 'R' THEN CASE l_linestatus WHEN 'F' THEN 'no_changes' ELSE 'added_section' END
      ELSE CASE l_linenumber % 3 WHEN 0 THEN 'no_baseline' WHEN 1 THEN 'absorbed_external' ELSE 'unresolved' END END AS status,
    CAST(l_quantity AS BIGINT) AS n_words
  FROM lineitem)
"""
