"""Text search over sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import natural_key, natural_key_sql, snippet, snippet_sql
from corpusloom.sources import bridge

#: Hits that one answer shows, as a feature of the search.
HITS = 25
WORD = "tion"


def contains(column: str, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.instr(F.lower(F.col(column)), F.lit(needle.lower())) > 0


def search(sections: DataFrame, needle: str, limit: int = HITS) -> DataFrame:
    """Sections whose text holds ``needle``, in natural order, with a snippet and the total number of hits.

    The total is one aggregated row beside the ordered hits, so no window pulls all rows into a task.
    """
    hits = sections.where(contains("text", needle)).select("module_id", "section_id", "doc_id", snippet(F.col("text"), needle).alias("snippet"))
    total = sections.where(contains("text", needle)).agg(F.count("*").alias("total_hits"))
    shown = hits.orderBy("module_id", natural_key(F.col("section_id")), "doc_id").limit(limit)
    return shown.join(F.broadcast(total))  # one aggregated row


def search_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the number of citations that each section's document receives."""
    hits = search(bridge.sections(spark, sf_dir), WORD)
    cited = bridge.citations(spark, sf_dir).groupBy("cited_id").agg(F.count("*").alias("n_citations"), F.countDistinct("citing_id").alias("n_citing"))
    out = hits.join(cited, F.col("doc_id") == F.col("cited_id"), "left")
    return out.select("module_id", "section_id", "doc_id", "snippet", "total_hits", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("n_citing", F.lit(0)).alias("n_citing"))


SQL = {
    "search_sections": f"""
WITH {bridge.SECTIONS_SQL}, {bridge.CITATIONS_SQL},
hits AS (SELECT module_id, section_id, doc_id, {snippet_sql("text", WORD)} AS snippet FROM sections WHERE strpos(lower(text), '{WORD}') > 0),
shown AS (SELECT * FROM hits ORDER BY module_id, {natural_key_sql("section_id")}, doc_id LIMIT {HITS}),
cited AS (SELECT cited_id, count(*) AS n_citations, count(DISTINCT citing_id) AS n_citing FROM citations GROUP BY 1)
SELECT module_id, section_id, doc_id, snippet, (SELECT count(*) FROM hits) AS total_hits,
       coalesce(n_citations, 0) AS n_citations, coalesce(n_citing, 0) AS n_citing
FROM shown LEFT JOIN cited ON doc_id = cited_id
"""
}
QUERIES = {"search_sections": search_sections}
