"""Windows, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import PAD, natural_key, natural_key_sql
from corpusloom.operators import ordering
from corpusloom.operators import outcomes as O
from corpusloom.operators.references import first_seen
from corpusloom.plans.registry import Registry
from corpusloom.sources import bridge
from corpusloom.sources.bridge import BILLS_SQL, OUTCOMES_SQL, SECTIONS_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql
#: Rows that a listing shows, as a feature of the listing.
LISTED = 50


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, section_id, lag(section_id) OVER w AS previous, lead(section_id) OVER w AS following FROM sections WINDOW w AS (PARTITION BY module_id ORDER BY {natural_key_sql("section_id")}, section_id)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections before and after each, in natural order within its module."""
    s = bridge.sections(spark, sf_dir).select("module_id", "section_id")
    return ordering.neighbours(s, "module_id", natural_key(F.col("section_id")), "section_id", PAD)


@query(f"""WITH {SECTIONS_SQL}, p AS (SELECT module_id, section_id, unnest([module_id, module_id || '/' || chapter, module_id || '/' || chapter || '/' || article_id]) AS prefix FROM sections)
SELECT prefix, first(section_id ORDER BY {natural_key_sql("section_id")}, section_id) AS first_section, count(*) AS n FROM p GROUP BY prefix""")
def ancestor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section of every hierarchy prefix; a minimum per prefix, combined before the shuffle."""
    levels = F.array(F.col("module_id"), F.concat_ws("/", "module_id", "chapter"), F.concat_ws("/", "module_id", "chapter", "article_id"))
    p = bridge.sections(spark, sf_dir).select("section_id", F.explode(levels).alias("prefix"))
    return p.groupBy("prefix").agg(F.min_by("section_id", F.struct(natural_key(F.col("section_id")), "section_id")).alias("first_section"), F.count("*").alias("n"))


@query(f"""WITH {SECTIONS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY module_id, article_id ORDER BY doc_id) AS position, count(*) OVER (PARTITION BY module_id, article_id) AS set_size FROM sections WHERE editorial_status = 'active'""")
def sibling_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and number of the visible siblings of each section."""
    s = bridge.sections(spark, sf_dir).where("editorial_status = 'active'").withColumn("group", F.concat_ws("/", "module_id", "article_id"))
    rows = ordering.places(s.select("group", "doc_id"), "group", F.lpad(F.col("doc_id").cast("string"), 19, "0"), "doc_id", 16, "position")
    return rows.join(s.groupBy("group").agg(F.count("*").alias("set_size")), "group").select("doc_id", "position", "set_size")


@query("""WITH r AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS depth FROM events)
SELECT event_id, max(event_id) FILTER (depth = 0) OVER w AS ancestor_0, max(event_id) FILTER (depth = 1) OVER w AS ancestor_1 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def sticky_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each lower depth before every row."""
    depth = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", depth.alias("depth"))
    return rows.select("event_id", *[F.max(F.when(F.col("depth") == k, F.col("event_id"))).over(w).alias(f"ancestor_{k}") for k in (0, 1)])


@query(f"""WITH {OUTCOMES_SQL} SELECT file_no, status, section_id FROM (SELECT *, row_number() OVER (PARTITION BY file_no, status ORDER BY position) AS rn FROM outcomes) WHERE rn = 1""")
def first_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first outcome of each kind in every bill (first wins; at one position the first in the table)."""
    return first_seen(bridge.outcomes(spark, sf_dir, arrivals=True), ["file_no", "status"], ["position"]).select("file_no", "status", "section_id")


@query("""WITH r AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT conv_id, turn, block, first_value(turn) OVER (PARTITION BY conv_id, block ORDER BY turn) AS opened_by FROM r""")
def carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that a marker row opens, by a running sum, with the row that opened each (carry-forward)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "user").cast("long")).over(w).alias("block"))
    return c.withColumn("opened_by", F.first("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn")))


@query(f"""WITH {BILLS_SQL} SELECT file_no, status, introduced FROM states WHERE status IN ('filed', 'committee', 'engrossed', 'floor', 'enrolled')
ORDER BY CASE status WHEN 'filed' THEN 0 WHEN 'committee' THEN 1 WHEN 'engrossed' THEN 2 WHEN 'floor' THEN 3 ELSE 4 END, introduced DESC, file_no LIMIT {LISTED}""")
def pending_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pending bills in workflow order, then newest first (a capped listing)."""
    b = bridge.bills(spark, sf_dir).withColumn("status", O.bill_status(F.col("status_text"))).where(F.col("status").isin(*O.PENDING))
    order = F.array_position(F.array(*map(F.lit, O.PENDING)), F.col("status"))
    return b.select("file_no", "status", "introduced").orderBy(order, F.desc_nulls_last("introduced"), "file_no").limit(LISTED)


@query(f"""WITH {BILLS_SQL} SELECT file_no, status, introduced, (SELECT count(*) FROM states) AS total, (SELECT count(*) FROM states) > {LISTED} AS truncated FROM states ORDER BY introduced DESC NULLS LAST, file_no LIMIT {LISTED}""")
def newest_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest bills with the total that the listing cuts."""
    b = bridge.bills(spark, sf_dir).withColumn("status", O.bill_status(F.col("status_text"))).select("file_no", "status", "introduced")
    total = b.agg(F.count("*").alias("total"))
    return b.orderBy(F.desc_nulls_last("introduced"), "file_no").limit(LISTED).join(F.broadcast(total)).withColumn("truncated", F.col("total") > LISTED)  # one row


@query(f"""WITH {OUTCOMES_SQL}, k AS (SELECT file_no, section_id, CASE status WHEN 'anchored' THEN 'revised' WHEN 'added_section' THEN 'added' WHEN 'no_changes' THEN 'referenced_no_change' ELSE 'unclear' END AS kind, position FROM outcomes),
r AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY CASE kind WHEN 'added' THEN 0 WHEN 'revised' THEN 1 WHEN 'referenced_no_change' THEN 2 ELSE 3 END, section_id, position) AS place FROM k)
SELECT file_no, place, section_id, kind FROM r WHERE place <= 5""")
def impact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bill's foremost changes by kind, then section (top-k per bill)."""
    k = bridge.outcomes(spark, sf_dir).withColumn("kind", O.change_kind(F.col("status")))
    order = F.array_position(F.array(*map(F.lit, ("added", "revised", "referenced_no_change", "unclear"))), F.col("kind"))
    place = F.row_number().over(Window.partitionBy("file_no").orderBy(order, "section_id", "position")).cast("long")
    return k.withColumn("place", place).where("place <= 5").select("file_no", "place", "section_id", "kind")


#: Tokens of the palette query that the ranking answers.
TOKENS = ("1", "th")


@query(f"""WITH {SECTIONS_SQL}, f AS (SELECT doc_id, lower(section_id) AS num, lower(title) AS name, unnest(['{TOKENS[0]}', '{TOKENS[1]}']) AS t FROM sections),
s AS (SELECT doc_id, t, greatest(CASE WHEN num = t THEN 1000 WHEN starts_with(num, t) THEN 800 WHEN strpos(num, t) > 0 THEN 500 - (strpos(num, t) - 1) ELSE 0 END,
  CASE WHEN name = t THEN 400 WHEN starts_with(name, t) THEN 300 WHEN strpos(name, t) > 0 THEN 150 - (strpos(name, t) - 1) ELSE 0 END) AS score FROM f)
SELECT doc_id, max(score) AS best, CAST(sum(score) AS BIGINT) AS total FROM s GROUP BY doc_id HAVING min(score) > 0 ORDER BY best DESC, total DESC, doc_id LIMIT {LISTED}""")
def palette_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in which every token scores, ordered by best, then summed score; all in one projection."""
    num, name = F.lower("section_id"), F.lower("title")

    def score(t: str) -> F.Column:
        by_num = F.when(num == t, 1000).when(F.startswith(num, F.lit(t)), 800).when(F.instr(num, t) > 0, 500 - (F.instr(num, t) - 1)).otherwise(0)
        by_name = F.when(name == t, 400).when(F.startswith(name, F.lit(t)), 300).when(F.instr(name, t) > 0, 150 - (F.instr(name, t) - 1)).otherwise(0)
        return F.greatest(by_num, by_name)

    s = bridge.sections(spark, sf_dir).select("doc_id", F.array(*map(score, TOKENS)).alias("scores")).where(F.forall("scores", lambda x: x > 0))
    total = F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("doc_id", F.array_max("scores").cast("long").alias("best"), total.alias("total")).orderBy(F.desc("best"), F.desc("total"), "doc_id").limit(LISTED)


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, section_id, row_number() OVER (PARTITION BY module_id ORDER BY {natural_key_sql("section_id")}, section_id) AS place FROM sections""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of sections in natural order."""
    s = bridge.sections(spark, sf_dir).select("module_id", "section_id")
    return ordering.places(s, "module_id", natural_key(F.col("section_id")), "section_id", PAD)


@query("""SELECT k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) EXCEPT SELECT user_id FROM events""")
def kept_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of two key sets less a third (the purge of what is not kept)."""
    both = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()
    return both.join(table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).distinct(), "k", "left_anti")


@query("""SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def rewritten_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are both deleted and added (an intersection)."""
    deleted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return deleted.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")), "k", "left_semi").distinct()


def window_start(sizes: Column, high: int = 30, low: int = 20) -> Column:
    """How many whole turns have left the view: when the messages in it pass ``high``, the oldest turns go until there are ``low`` or fewer; the newest stays."""
    ends = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("long"), lambda a, n: a + n))
    ends = F.when(F.size(sizes) > 0, ends).otherwise(F.array().cast("array<long>"))

    def step(start: Column, k: Column) -> Column:
        count = lambda s: F.element_at(ends, k + 1) - F.when(s > 0, F.element_at(ends, s)).otherwise(0)
        first = F.filter(F.sequence(start, k), lambda s: count(s) <= low)
        return F.when(count(start) > high, F.when(F.size(first) > 0, F.array_min(first)).otherwise(k)).otherwise(start)

    return F.when(F.size(sizes) > 0, F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), F.lit(0), step)).otherwise(0)


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM t WHERE n <= 4 OR back <= 2 + (n - 5) % 3""")
def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that stay in view, each a message here: above 4 the oldest leave until 2 are left (limits 30 and 20 by default)."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    c = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("turns"))
    kept = F.slice("turns", window_start(F.transform("turns", lambda t: t["n"]), 4, 2) + 1, F.size("turns"))
    return c.select("conv_id", F.explode(kept).alias("t")).select("conv_id", "t.turn")

