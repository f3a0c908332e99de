"""All invariants of a corpus, over tables that rows of the driver's tables make right and, in places, wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import gates
from corpusloom.plans.registry import Registry
from corpusloom.sources import bridge
from corpusloom.sources.bridge import OUTCOMES_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

_ID = "concat('m', p_size % 3, '/', p_partkey % 60)"
_STATUS = "CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'structural_change' END"
_SCOPE = "CASE WHEN o_orderkey % 6 < 3 THEN 'chapter' END"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    d, p, o, s, li = (table(spark, sf_dir, t) for t in ("documents", "part", "orders", "supplier", "lineitem"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "(?<=\n)")).alias("seg_index", "raw")).where("not (doc_id % 17 = 0 and seg_index = 0)")
    word = F.regexp_extract("raw", "^[^ \n]*", 0)
    segments = lines.select("doc_id", "seg_index", "raw", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("ref"))
    outcomes = bridge.outcomes(spark, sf_dir)
    return {
        "texts": d.select("doc_id", "text"), "segments": segments, "cited": lines.select("doc_id", F.col("seg_index").alias("citation_index"), word.alias("display")),
        "targets": li.select(F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ref_id"), F.col("l_partkey").cast("string").alias("section_id"), F.expr("CASE l_suppkey % 3 WHEN 0 THEN string(l_partkey) WHEN 1 THEN string(l_partkey + 1) END").alias("range_from")).distinct(),
        "definitions": p.select(F.expr("concat('m', p_size % 3)").alias("module_id"), F.expr(_ID).alias("def_id"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + F.col("p_size") - 10).alias("end")),
        "bills": o.select(F.col("o_orderkey").alias("file_no"), F.expr(_STATUS).alias("parse_status"), F.expr("o_orderkey % 4 = 2").alias("structural"), F.expr(_SCOPE).alias("structural_change_scope")),
        "outcomes": outcomes, "chunks": outcomes.where("file_no % 5 <> 0").select("file_no").distinct(), "bodies": outcomes.where("status = 'anchored' or (status = 'no_changes' and section_id % 9 = 0)").select("file_no", "section_id"),
        "modules": s.select(F.expr("concat('m', s_suppkey % 40)").alias("id"), F.expr("concat(CASE WHEN s_suppkey % 2 = 0 THEN 'CODE ' ELSE 'Code ' END, s_suppkey % 25)").alias("code_title")),
        "jurisdictions": s.select(F.col("s_name").alias("jurisdiction"), F.lit("amlegal-html").alias("source_format"), F.lit("x").alias("bill_source"), F.expr("CASE WHEN s_suppkey % 3 > 0 THEN '2026-01-01' END").alias("session_start"), F.expr("CASE WHEN s_suppkey % 3 = 1 THEN '2025-01-01' ELSE '2027-01-01' END").alias("session_end"), F.expr("array('a', CASE WHEN s_suppkey % 4 > 0 THEN 'b' END)").alias("jd_anchors")),
        "history": p.select(F.expr("concat(1990 + p_size % 2, '-', p_partkey)").alias("id"), F.expr("1990 + p_size % 3").alias("year"), F.expr("CASE WHEN p_size % 5 > 0 THEN 'ordinance' END").alias("instrument_kind"), F.lit("ordinance").alias("file_kind")),
        "sources": s.select(F.col("s_name").alias("jurisdiction"), F.expr("CASE s_suppkey % 5 WHEN 0 THEN '/a/b' WHEN 1 THEN '../b' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'a..b/c' ELSE 'a/b' END").alias("path")),
    }


@query(f"""WITH {OUTCOMES_SQL}, o AS (SELECT file_no, count(*) AS n, count(*) FILTER (status IN ('anchored', 'added_section', 'no_changes')) AS r, count(*) FILTER (status = 'absorbed_external') AS a FROM outcomes GROUP BY 1),
b AS (SELECT o_orderkey AS file_no, {_STATUS} AS s, {_SCOPE} AS scope, CASE WHEN o_orderkey % 4 = 2 THEN 'structural_change' WHEN coalesce(n, 0) = 0 THEN 'body_only' WHEN a = n THEN 'absorbed_external' WHEN r = n THEN 'ok' WHEN r > 0 THEN 'partial' ELSE 'manual_review' END AS w FROM orders LEFT JOIN o ON file_no = o_orderkey),
shown AS (SELECT DISTINCT file_no, section_id FROM outcomes WHERE status IN ('anchored', 'added_section')), made AS (SELECT DISTINCT file_no, section_id FROM outcomes WHERE status = 'anchored' OR (status = 'no_changes' AND section_id % 9 = 0)),
x AS (SELECT 'body_is_text' AS gate, CAST(doc_id AS VARCHAR) AS subject FROM documents WHERE doc_id % 17 = 0 AND text <> ''
UNION ALL SELECT DISTINCT 'range_start', l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey FROM lineitem WHERE l_suppkey % 3 = 1
UNION ALL SELECT 'definition_anchor', 'm' || p_size % 3 || '/' || {_ID} FROM part WHERE p_size < 10
UNION ALL SELECT 'definition_ids', k FROM (SELECT 'm' || p_size % 3 || '/' || {_ID} AS k FROM part) GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'parse_status', CAST(file_no AS VARCHAR) FROM b WHERE s IS DISTINCT FROM w
UNION ALL SELECT DISTINCT 'has_chunks', CAST(file_no AS VARCHAR) FROM shown WHERE file_no % 5 = 0
UNION ALL SELECT 'new_bodies', file_no || '/' || section_id FROM (SELECT * FROM shown EXCEPT SELECT * FROM made) UNION ALL SELECT 'new_bodies', file_no || '/' || section_id FROM (SELECT * FROM made EXCEPT SELECT * FROM shown)
UNION ALL SELECT 'structural_scope', CAST(file_no AS VARCHAR) FROM b WHERE (scope IS NOT NULL) <> (coalesce(s, '') = 'structural_change')
UNION ALL SELECT 'module_ids', k FROM (SELECT 'm' || s_suppkey % 40 AS k FROM supplier) GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'module_ids', k FROM (SELECT 'code ' || s_suppkey % 25 AS k FROM supplier) GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'jurisdiction', s_name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'jurisdiction', s_name FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'jurisdiction', s_name FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'history_items', 1990 + p_size % 2 || '-' || p_partkey FROM part WHERE p_size % 5 = 0 OR p_size % 2 <> p_size % 3
UNION ALL SELECT 'source_path', s_name FROM supplier WHERE s_suppkey % 5 < 3)
SELECT gate, subject, count(*) AS n FROM x GROUP BY ALL""")
def schema_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break any invariant, by gate."""
    return gates.violations(tables(spark, sf_dir)).groupBy("gate", "subject").agg(F.count("*").alias("n"))
