"""Queries on predicates and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import lookups as L
from corpusloom.operators import ordering
from corpusloom.plans import binding
from corpusloom.plans.registry import Registry
from corpusloom.sources import bridge
from corpusloom.sources.bridge import OUTCOMES_SQL, SECTIONS_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, module_id FROM sections WHERE editorial_status = 'active' AND (chapter = 'en' OR article_id = 'article-3')")
def filtered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by composed predicates; empty ones hold everywhere."""
    s = bridge.sections(spark, sf_dir)
    return s.where(L.all_of(F.col("editorial_status") == "active", L.any_of(F.col("chapter") == "en", F.col("article_id") == "article-3"), L.all_of(), L.any_of())).select("doc_id", "module_id")


@query(f"""WITH {OUTCOMES_SQL}, f AS (SELECT file_no, section_id, arg_min(status, position) AS status, bool_or(n_words % 4 > 0) AS chunk FROM outcomes GROUP BY 1, 2)
SELECT section_id, file_no FROM f WHERE status IN ('anchored', 'added_section') AND chunk AND file_no % 13 > 0""")
def bills_with_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills that show a diff for a section."""
    o = bridge.outcomes(spark, sf_dir, arrivals=True)
    chunks = o.where("n_words % 4 > 0").select("file_no", "section_id")
    # of every bill that has outcomes, in the table of orders or not
    bills = o.select("file_no", F.expr("CASE WHEN file_no % 13 = 0 THEN 'body_only' ELSE 'ok' END").alias("parse_status"))
    return L.with_diffs(o, chunks, bills)


@query("SELECT event_id, event_id % 15000 AS doc_id FROM events WHERE event_id % 15000 IN (SELECT doc_id FROM documents)")
def vanished_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved references less those to sections that the corpus no longer has."""
    saved = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 15000).alias("doc_id"))
    return L.still_there(saved, table(spark, sf_dir, "documents"), ["doc_id"])


@query("SELECT DISTINCT l_orderkey AS section_key, p_partkey AS def_id, p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey")
def section_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that each section uses."""
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_key"), F.col("l_partkey").alias("def_id"))
    return L.section_definitions(uses, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("def_id"), F.col("p_name").alias("term")))


@query(f"""WITH {binding._BASE}, f AS (SELECT ref_id, module_id, unnest({binding._FORMS.format(c="raw")}) AS form, generate_subscripts({binding._FORMS.format(c="raw")}, 1) AS rank FROM r),
o AS (SELECT ref_id, arg_min(form, rank) AS anchor_id FROM f JOIN anchors a ON a.module_id = f.module_id AND a.anchor_id = form GROUP BY 1),
h AS (SELECT ref_id, a.module_id AS m, form, rank FROM f JOIN anchors a ON a.anchor_id = form AND a.module_id <> f.module_id WHERE ref_id NOT IN (SELECT ref_id FROM o)),
x AS (SELECT ref_id, m, form FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY m, rank) AS k FROM h) WHERE k = 1)
SELECT ref_id, CASE WHEN o.anchor_id IS NOT NULL THEN 'own' WHEN x.m IS NOT NULL THEN 'orphan' ELSE 'missing' END AS place, CASE WHEN o.anchor_id IS NOT NULL THEN r.module_id ELSE x.m END AS found_module, coalesce(o.anchor_id, x.form) AS anchor_id
FROM r LEFT JOIN o USING (ref_id) LEFT JOIN x USING (ref_id)""")
def bill_section_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sections that bills name are, orphans in other modules."""
    return L.bill_sections(binding.refs(spark, sf_dir).select("ref_id", "module_id", "raw"), binding.anchors(spark, sf_dir))


@query(f"WITH {OUTCOMES_SQL}, d AS (SELECT DISTINCT section_id, file_no FROM outcomes) SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY file_no) AS place, file_no FROM d")
def bills_in_section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bills of each section id, whatever the module, in order."""
    d = bridge.outcomes(spark, sf_dir).select("section_id", "file_no").distinct()
    return ordering.places(d, "section_id", F.lpad(F.col("file_no").cast("string"), 19, "0"), "file_no", 14).select("section_id", "place", "file_no")
