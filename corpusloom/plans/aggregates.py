"""Aggregations over sections, outcomes, bills and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import PAD, natural_key, natural_key_sql
from corpusloom.operators import ordering
from corpusloom.operators import outcomes as O
from corpusloom.plans.registry import Registry
from corpusloom.sources import bridge
from corpusloom.sources.bridge import BILLS_SQL, OUTCOMES_SQL, SECTIONS_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql


@query(f"WITH {OUTCOMES_SQL} SELECT status, count(*) AS n, count(DISTINCT file_no) AS n_bills FROM outcomes GROUP BY status")
def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.outcomes(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("file_no").alias("n_bills"))


@query(f"""WITH {OUTCOMES_SQL}, c AS (SELECT file_no, count(*) AS n, count(*) FILTER (status IN ('anchored', 'added_section', 'no_changes')) AS n_renderable, count(*) FILTER (status = 'absorbed_external') AS n_absorbed FROM outcomes GROUP BY 1)
SELECT *, CASE WHEN n_absorbed = n THEN 'absorbed_external' WHEN n_renderable = n THEN 'ok' WHEN n_renderable > 0 THEN 'partial' ELSE 'manual_review' END AS parse_status FROM c""")
def bill_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse status of every bill from its outcomes."""
    return O.outcome_summary(bridge.outcomes(spark, sf_dir), "file_no")


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, article_id, first_value(title) OVER (PARTITION BY module_id, article_id ORDER BY doc_id) AS title, count(*) OVER (PARTITION BY module_id, article_id) AS n_sections,
row_number() OVER (PARTITION BY module_id, article_id ORDER BY {natural_key_sql("section_id")}, section_id) AS place, section_id FROM sections""")
def article_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their first title, one row per section with its place in natural order."""
    s = bridge.sections(spark, sf_dir).withColumn("group", F.concat_ws("/", "module_id", "article_id"))
    heads = s.groupBy("group").agg(F.min_by("title", "doc_id").alias("title"), F.count("*").alias("n_sections"))
    rows = ordering.places(s.select("group", "module_id", "article_id", "section_id"), "group", natural_key(F.col("section_id")), "section_id", PAD)
    return rows.join(heads, "group").select("module_id", "article_id", "title", "n_sections", "place", "section_id")


@query("""SELECT lang AS term, source AS module_id, count(*) AS n_occurrences, string_agg(DISTINCT CAST(doc_id % 7 AS VARCHAR), ',' ORDER BY CAST(doc_id % 7 AS VARCHAR)) AS definers FROM documents GROUP BY 1, 2""")
def definition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definers of each term in each module, sorted."""
    d = table(spark, sf_dir, "documents")
    definers = F.array_join(F.sort_array(F.collect_set((F.col("doc_id") % 7).cast("string"))), ",")
    return d.groupBy(F.col("lang").alias("term"), F.col("source").alias("module_id")).agg(F.count("*").alias("n_occurrences"), definers.alias("definers"))


@query(f"""WITH {SECTIONS_SQL} SELECT (SELECT count(DISTINCT module_id) FROM sections) AS n_modules, (SELECT count(*) FROM sections) AS n_sections,
(SELECT strftime(max(o_orderdate), '%Y.%m.%d') FROM orders) AS version, (SELECT count(DISTINCT k) FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem)) AS n_bills""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the corpus: modules, sections, newest version, distinct bills of two sources."""
    s = bridge.sections(spark, sf_dir).agg(F.countDistinct("module_id").alias("n_modules"), F.count("*").alias("n_sections"))
    v = table(spark, sf_dir, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy.MM.dd").alias("version"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).union(table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return s.crossJoin(v).crossJoin(keys.agg(F.countDistinct("k").alias("n_bills")))  # three single rows


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, count(*) AS n_sections, count(DISTINCT article_id) AS n_articles, count(*) FILTER (editorial_status <> 'active') AS n_inactive, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM sections GROUP BY 1""")
def module_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bridge.sections(spark, sf_dir)
    return s.groupBy("module_id").agg(F.count("*").alias("n_sections"), F.countDistinct("article_id").alias("n_articles"), F.count_if(F.col("editorial_status") != "active").alias("n_inactive"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {SECTIONS_SQL} SELECT coalesce(module_id, 'total') AS module_id, count(*) AS n_skipped FROM sections WHERE editorial_status = 'reserved' GROUP BY ROLLUP (module_id)""")
def skips_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped sections per module and in total, by one rollup."""
    s = bridge.sections(spark, sf_dir).where("editorial_status = 'reserved'")
    return s.rollup("module_id").agg(F.count("*").alias("n_skipped")).select(F.coalesce("module_id", F.lit("total")).alias("module_id"), "n_skipped")


@query("""WITH e AS (SELECT user_id AS matter, event_type, value, ts, event_id FROM events)
SELECT matter, max(ts) FILTER (event_type = 'purchase') AS enacted_at, max(ts) FILTER (event_type IN ('purchase', 'error')) AS terminal_at,
 arg_min(value, event_id) FILTER (event_type = 'view') AS first_view_value, count(*) AS n_actions FROM e GROUP BY matter""")
def action_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of each matter from its action history; a first known value by order of its events."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    return e.groupBy(F.col("user_id").alias("matter")).agg(
        F.max(F.when(kind == "purchase", F.col("ts"))).alias("enacted_at"),
        F.max(F.when(kind.isin("purchase", "error"), F.col("ts"))).alias("terminal_at"),
        F.min_by(F.when(kind == "view", F.col("value")), F.when(kind == "view", F.col("event_id"))).alias("first_view_value"),
        F.count("*").alias("n_actions"),
    )


@query(f"""WITH {OUTCOMES_SQL} SELECT file_no, CAST(sum(n_words) FILTER (status = 'added_section') AS BIGINT) AS n_inserted, CAST(sum(n_words) FILTER (status = 'no_baseline') AS BIGINT) AS n_deleted, count(DISTINCT section_id) AS n_affected FROM outcomes GROUP BY 1""")
def impact_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each bill inserts and deletes, and the sections that it touches."""
    s = F.col("status")
    out = bridge.outcomes(spark, sf_dir).groupBy("file_no")
    return out.agg(F.sum(F.when(s == "added_section", F.col("n_words"))).alias("n_inserted"), F.sum(F.when(s == "no_baseline", F.col("n_words"))).alias("n_deleted"), F.countDistinct("section_id").alias("n_affected"))


@query(f"""WITH {OUTCOMES_SQL}, c AS (SELECT file_no, count(*) AS n, count(*) FILTER (status IN ('anchored', 'added_section', 'no_changes')) AS r, count(*) FILTER (status = 'absorbed_external') AS a FROM outcomes GROUP BY 1),
p AS (SELECT file_no, CASE WHEN a = n THEN 'absorbed_external' WHEN r = n THEN 'ok' WHEN r > 0 THEN 'partial' ELSE 'manual_review' END AS flag FROM c)
SELECT file_no, 'parse' AS kind, flag, NULL AS refs FROM p WHERE flag <> 'ok'
UNION ALL SELECT file_no, 'outcome', status, string_agg(CAST(section_id AS VARCHAR), ', ' ORDER BY position, section_id) FROM outcomes WHERE status IN ('no_baseline', 'unresolved') GROUP BY 1, 3""")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each bill: its parse status if not ok, and each failing outcome with its sections in order."""
    out = bridge.outcomes(spark, sf_dir)
    parse = O.outcome_summary(out, "file_no").where("parse_status <> 'ok'").select("file_no", F.lit("parse").alias("kind"), F.col("parse_status").alias("flag"), F.lit(None).cast("string").alias("refs"))
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "section_id"))), lambda x: x["section_id"].cast("string")), ", ")
    failing = out.where(F.col("status").isin("no_baseline", "unresolved")).groupBy("file_no", F.col("status").alias("flag")).agg(refs.alias("refs"))
    return parse.union(failing.select("file_no", F.lit("outcome").alias("kind"), "flag", "refs"))


@query(f"""WITH {OUTCOMES_SQL} SELECT 'ok_rate' AS gate, count(*) AS n, count(*) FILTER (status = 'no_baseline') AS n_failing, count(*) FILTER (status = 'no_baseline') = 0 AS passed FROM outcomes
UNION ALL SELECT 'completeness', count(*), count(*) FILTER (status = 'anchored' AND n_words = 0), count(*) FILTER (status = 'anchored' AND n_words = 0) = 0 FROM outcomes""")
def bill_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both gates from one pass over the outcomes."""
    s = F.col("status")
    one = bridge.outcomes(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(s == "no_baseline").alias("a"), F.count_if((s == "anchored") & (F.col("n_words") == 0)).alias("b"))
    gates = F.array(F.struct(F.lit("ok_rate").alias("gate"), "n", F.col("a").alias("n_failing")), F.struct(F.lit("completeness").alias("gate"), "n", F.col("b").alias("n_failing")))
    return one.select(F.explode(gates).alias("g")).select("g.*", (F.col("g.n_failing") == 0).alias("passed"))


@query("""WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1),
top AS (SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC, event_id) AS slowest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3 GROUP BY 1)
SELECT event_type, n, round(mean_value, 6) AS mean_value, slowest FROM s JOIN top USING (event_type)""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per kind and the three largest of each; the three are kept per task before they are merged."""
    e = table(spark, sf_dir, "events")
    ranked = e.withColumn("rn", F.expr("row_number() over (partition by event_type order by value desc, event_id)")).where("rn <= 3")
    top = ranked.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("slowest"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).join(top, "event_type")


@query("""SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1""")
def p95_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index floor(0.95 n) of each kind, counting from 0 (no interpolation)."""
    return ordering.value_at(table(spark, sf_dir, "events"), "event_type", "value", 0.95, name="p95")


@query(f"""WITH {BILLS_SQL} SELECT status, status IN ('filed', 'committee', 'engrossed', 'floor', 'enrolled') AS pending, count(*) AS n, max(introduced) AS newest FROM states GROUP BY 1""")
def bill_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills by the state that their status text maps to."""
    b = bridge.bills(spark, sf_dir).withColumn("status", O.bill_status(F.col("status_text")))
    return b.groupBy("status").agg(F.count("*").alias("n"), F.max("introduced").alias("newest")).select("status", F.col("status").isin(*O.PENDING).alias("pending"), "n", "newest")


@query("SELECT doc_id % 500 AS dup_id, source AS module_id, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy((F.col("doc_id") % 500).alias("dup_id"), F.col("source").alias("module_id")).agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY 1""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage summed per conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("role") == "user").alias("n_user"))
