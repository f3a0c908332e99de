"""Batch equivalents of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import Registry
from corpusloom.sources import corpus
from corpusloom.sources.bridge import SECTIONS_SQL, sections, table
from corpusloom.streaming import ingest

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def daily_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.action_counts(table(spark, sf_dir, "events")).select(F.date_format("from", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(f"""WITH {SECTIONS_SQL}, r AS (SELECT module_id, sha256(section_id || chr(10) || text) AS d FROM sections), s AS (SELECT module_id, left(d, 3) AS slice, sha256(string_agg(d, chr(10) ORDER BY d)) AS part FROM r GROUP BY 1, 2)
SELECT module_id, sha256(string_agg(slice || ':' || part, chr(10) ORDER BY slice)) AS checksum FROM s GROUP BY 1""")
def module_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of modules that do not depend on partitions or order of arrival."""
    return corpus.row_checksum(sections(spark, sf_dir), "module_id", F.concat_ws("\n", "section_id", "text"))


@query("""SELECT left(sha256(string_agg(k, chr(10) ORDER BY k)), 12) AS corpus_hash FROM (SELECT source || '@' || count(*) AS k FROM documents GROUP BY source)""")
def corpus_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("module_id")).agg(F.count("*").cast("string").alias("module_version"))
    return corpus.corpus_hash(m)
