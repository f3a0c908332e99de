"""Headings, hierarchy, links between codes, grids and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answers as A
from corpusloom.operators import headings as H
from corpusloom.operators.diff import mapped
from corpusloom.plans.registry import Registry
from corpusloom.sources.bridge import table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.5' WHEN 1 THEN '4.' || p_size WHEN 2 THEN CAST(p_size AS VARCHAR) END AS id, CASE p_partkey % 4 WHEN 0 THEN 'Fees *' WHEN 1 THEN 'Sewer System' WHEN 2 THEN 'Old' END AS title FROM part""")
def hierarchy_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and titles of article and chapter labels in their several forms."""
    label = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Article ' || p_size || '.5: Fees *' WHEN 1 THEN 'CHAPTER 4.' || p_size || '.Sewer System' WHEN 2 THEN 'Chapter ' || p_size || '* Old' ELSE 'Chapter ' END")
    return table(spark, sf_dir, "part").select("p_partkey", H.hierarchy_marker(label).alias("m")).select("p_partkey", "m.id", "m.title")


_LEVELS = "CASE event_type WHEN 'signup' THEN 'division' WHEN 'purchase' THEN 'chapter' WHEN 'error' THEN 'article' END"


@query(f"""WITH b AS (SELECT user_id, event_id, {_LEVELS} AS level FROM events),
r AS (SELECT *, count(*) FILTER (level = 'division') OVER w AS d, count(*) FILTER (level IN ('division', 'chapter')) OVER w AS c FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, max(event_id) FILTER (level = 'division') OVER (PARTITION BY user_id ORDER BY event_id) AS division, max(event_id) FILTER (level = 'chapter') OVER (PARTITION BY user_id, d ORDER BY event_id) AS chapter,
 max(event_id) FILTER (level = 'article') OVER (PARTITION BY user_id, c ORDER BY event_id) AS article FROM r""")
def carried_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The division, chapter and article that hold at every row, each cleared by what stands above it."""
    boxes = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_LEVELS).alias("level"), F.col("event_id").alias("marker"))
    return H.carried(boxes, "user_id", "event_id").select("user_id", "event_id", "division", "chapter", "article")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.7-fn1' WHEN 1 THEN p_size || 'a-orig' ELSE 'art-' || p_size END AS section_id,
 CASE p_partkey % 3 WHEN 0 THEN 'Use of Parks' WHEN 1 THEN '[Reserved.]' ELSE 'Scope' END AS title, CASE p_partkey % 3 WHEN 1 THEN 'reserved' ELSE 'active' END AS status FROM part""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, titles and statuses of sections from their headings and anchors."""
    k = F.expr("p_partkey % 3")
    size = F.col("p_size").cast("string")
    heading = F.when(k == 0, F.concat(F.lit("SEC. "), size, F.lit(".7*. Use of Parks."))).when(k == 1, F.concat(F.lit("SEC. "), size, F.lit("A. [Reserved.]"))).otherwise("Scope.")
    none = F.lit(None).cast("string")
    anchor = F.when(k == 2, F.concat(F.lit("Art "), size, F.lit(" Note 3")))
    own = H.chosen_id(none, F.lit(False), anchor, F.when(k == 2, size), heading)
    status = H.editorial_status(F.when(k == 1, "deleted").otherwise("active"), heading, F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", own.alias("section_id"), H.section_title(heading, F.lit("-")).alias("title"), status.alias("status"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Rent and CEQA for the City' WHEN 1 THEN 'U.S. Department of ' || c_mktsegment[1] || lower(c_mktsegment[2:]) ELSE 'Already Cased of the' END AS title FROM customer""")
def pretty_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in capitals put in title case."""
    raw = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'RENT AND CEQA FOR THE CITY' WHEN 1 THEN 'U.S. DEPARTMENT OF ' || c_mktsegment ELSE 'Already Cased of the' END")
    return table(spark, sf_dir, "customer").select("c_custkey", mapped(H.title_case, raw).alias("title"))


@query("""WITH n AS (SELECT page_id, CAST(page_id * 7 AS VARCHAR) AS anchor FROM pages), t AS (SELECT CAST(doc_id AS VARCHAR) AS anchor, source FROM documents)
SELECT page_id, anchor, source AS target FROM n LEFT JOIN t USING (anchor)""")
def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links joined to the anchors that they name; unknown targets stay as warnings."""
    links = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/codes/latest#JD_"), (F.col("page_id") * 7).cast("string")).alias("link"))
    anchors = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("anchor"), F.col("source").alias("target"))
    return H.link_edges(links, anchors).select("page_id", "anchor", "target")


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '1234:src1:5.1' WHEN 3 THEN '99999:src2:7,99999:src3:8' WHEN 4 THEN '77' || turn || ':src4:9' ELSE '' END AS claims FROM conversations WHERE role = 'assistant'""")
def bill_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers say that bills change, less what they deny, fence off or quote in lines with >."""
    body = "CASE turn % 5 WHEN 0 THEN 'So [Bill #1234] amends [src1 § 5.1]. It [Bill #1234] amends [src1 § 5.1].' WHEN 1 THEN 'But [Bill #1234] does not amend [src1 § 5.1].' WHEN 2 THEN 'See:\n> [Bill #1234] amends [src1 § 5.1].\n```\n[Bill #1234] repeals [src1 § 5.1].\n```\nDone.' WHEN 3 THEN 'First.\n[Bill #99999] repeals [src2 § 7] and [src3 § 8].' ELSE concat('It reads \"[Bill #77', turn, '] adds [src4 § 9]\" there.') END"
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", A.claims(F.expr(body)).alias("c"))
    return a.select("conv_id", "turn", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["file_no"], x["module_id"], x["section_id"])), ",").alias("claims"))
