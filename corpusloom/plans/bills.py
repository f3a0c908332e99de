"""Bills: clauses, titles, redlines, span arbitration and answers' sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import redline as R
from corpusloom.operators import spans as S
from corpusloom.plans.registry import Registry
from corpusloom.sources.bridge import table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

#: A title and a clause for every order.
TITLE = "CASE o_orderkey % 4 WHEN 0 THEN 'Ordinance amending the Planning Code to allow uses' WHEN 1 THEN 'Ordinance repealing the Health Code by order' WHEN 2 THEN 'Resolution urging action' ELSE 'Ordinance amending the Building, Fire and Housing Codes to align them' END"
CLAUSE = "CASE o_orderkey % 5 WHEN 0 THEN 'amended by deleting Section 12.' || o_custkey || ' and by adding Sections 3, 4 and 5.1, to read as follows' WHEN 1 THEN 'hereby amended by adding a new Section ' || o_custkey || '.' WHEN 2 THEN 'is hereby amended to read' WHEN 3 THEN 'by deleting Sections 7, ' || o_custkey || ' of the Code' ELSE 'no clause' END"


@query(f"""SELECT o_orderkey AS file_no, CASE o_orderkey % 5 WHEN 0 THEN 'composite' WHEN 1 THEN 'add' WHEN 2 THEN 'inline' WHEN 3 THEN 'delete' ELSE 'unknown' END AS kind,
 CASE o_orderkey % 5 WHEN 0 THEN '12.' || o_custkey WHEN 3 THEN '7' || CASE WHEN o_custkey = 7 THEN '' ELSE ',' || o_custkey END ELSE '' END AS deleted, CASE o_orderkey % 5 WHEN 0 THEN '3,4,5.1' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS added FROM orders""")
def action_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bill's clause does, and to which sections."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_no"), F.expr(CLAUSE).alias("action"))
    a = F.col("action")
    return o.select("file_no", R.action_kind(a).alias("kind"), F.array_join(R.clause_sections(a, R.DELETING), ",").alias("deleted"), F.array_join(R.clause_sections(a, R.ADDING), ",").alias("added"))


@query("""SELECT o_orderkey AS file_no, CASE o_orderkey % 4 WHEN 2 THEN 'B' ELSE 'A' END AS title_class, CASE o_orderkey % 4 WHEN 0 THEN 'Planning' WHEN 1 THEN 'Health' WHEN 2 THEN '' ELSE 'Building,Fire,Housing' END AS stubs FROM orders""")
def bill_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of bills by their titles, and the codes that they name."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_no"), F.expr(TITLE).alias("title"))
    return o.select("file_no", R.title_class(F.col("title")).alias("title_class"), F.array_join(R.title_stubs(F.col("title")), ",").alias("stubs"))


def redline_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs and lines made from line items: one run per item, on a page per order, marked by its return flag."""
    li = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(_order())
    rows = li.select(F.col("l_orderkey").alias("doc"), (n - 1).alias("run"), F.concat(F.lit("w"), (F.col("l_partkey") % 1000).cast("string")).alias("text"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    runs = rows.select("doc", "run", F.lit(1).alias("page"), F.lit(10.0).alias("x"), (700.0 - 15 * F.col("run")).alias("y"), F.lit(50.0).alias("width"), F.lit(10.0).alias("height"), "text", (F.col("flag") != "N").alias("italic_times"), "flag", "status")
    at = F.when(F.col("flag") == "A", F.col("y") - 2).otherwise(F.col("y") + 4)
    lines = runs.where("flag <> 'N'").select("doc", "page", F.lit(10.0).alias("gx"), F.when(F.col("status") == "F", 50.0).otherwise(25.0).alias("gw"), (at - 0.5).alias("gy"), F.lit(1.0).alias("gh"))
    return runs.drop("flag", "status"), lines


def _order():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey AS doc, CASE l_returnflag WHEN 'N' THEN 'context' WHEN 'A' THEN 'insert' ELSE 'delete' END AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def redline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the spans of each bill, from fonts and lines on its pages."""
    runs, lines = redline_tables(spark, sf_dir)
    return R.classified(runs, lines).groupBy("doc", "kind").agg(F.count("*").alias("n"))


@query()
def redline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amended texts put together from the spans of each bill; rows only."""
    runs, lines = redline_tables(spark, sf_dir)
    spans = R.spacing(R.classified(runs, lines).join(runs.select("doc", "run", "page", "x", "y", "width"), ["doc", "run"]))
    spans = spans.select(F.col("doc").alias("key"), F.struct("run", "part").alias("position"), "kind", "text", "before")
    baselines = runs.groupBy(F.col("doc").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), " ").alias("baseline"))
    return R.reconstructed(spans, baselines)


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS b, l_linenumber * 10 + l_quantity % 10 + 1 AS e FROM lineitem)
SELECT doc, count(DISTINCT b) AS n FROM s GROUP BY doc""")
def spans_without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that stay when overlapping ones go: here those of each start, the longest."""
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("int")
    span = F.struct(start.alias("start"), (start + (F.col("l_quantity") % 10).cast("int") + 1).alias("end"), F.lit("defined_term").alias("kind"))
    lists = li.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(span).alias("spans"))
    return lists.select("doc", F.size(S.without_overlaps(F.col("spans"))).cast("long").alias("n"))


@query()
def arbitrated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and terms of each bill after arbitration; rows only."""
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 7).cast("int")
    span = F.struct(start.alias("start"), (start + (F.col("l_quantity") % 20).cast("int") + 1).alias("end"), F.when(F.col("l_returnflag") == "R", "citation").otherwise("defined_term").alias("kind"))
    lists = li.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(span).alias("spans"))
    return lists.select("doc", F.posexplode(S.arbitrated(F.col("spans"))).alias("place", "s")).select("doc", "place", "s.*")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE 'section,bill' || CASE WHEN turn % 3 = 1 THEN ',unknown' ELSE '' END END AS kinds FROM conversations WHERE role = 'assistant'""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the sources that each answer lists at its end."""
    block = "CASE WHEN turn % 3 = 0 THEN text ELSE text || '\n## Sources\n- [src1 § 1.0] — title\n\n* [Bill #12345]\n' || CASE WHEN turn % 3 = 1 THEN '- [what is this]\n' ELSE 'Done.\n- [src2 § 2]' END END"
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", R.sources(F.expr(block)).alias("s"))
    return a.select("conv_id", "turn", F.coalesce(F.array_join(F.transform("s", lambda x: x["kind"]), ","), F.lit("")).alias("kinds"))


@query("""WITH h AS (SELECT user_id AS file_no, ts, event_type AS action, CASE event_type WHEN 'purchase' THEN 'enacted' WHEN 'error' THEN 'failed' END AS implied, CASE user_id % 2 WHEN 0 THEN 'enacted' ELSE 'failed' END AS mapped FROM events)
SELECT file_no, ts, action, implied, mapped FROM (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY ts, action) AS rn FROM h WHERE implied IS NOT NULL AND implied <> mapped) WHERE rn = 1""")
def status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first action of each matter that contradicts its mapped state."""
    e = table(spark, sf_dir, "events")
    history = e.select(F.col("user_id").alias("file_no"), "ts", F.col("event_type").alias("action"), F.when(F.col("user_id") % 2 == 0, "enacted").otherwise("failed").alias("mapped"))
    return R.history_audit(history, F.when(F.col("action") == "purchase", "enacted").when(F.col("action") == "error", "failed"))


@query(r"""WITH l AS (SELECT doc_id, regexp_extract_all('(a) Text ' || text || chr(10) || '(b)(1) Next (c) Not one' || chr(10) || ' (' || doc_id || ') Last', '(?:^|\n)\s*((?:\([A-Za-z0-9]+\))+)\s+[A-Z]', 1) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_labels, array_to_string(l, '|') AS labels FROM l""")
def subsection_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels at the starts of lines, of whole texts that are put in subsections."""
    text = F.concat(F.lit("(a) Text "), F.col("text"), F.lit("\n(b)(1) Next (c) Not one\n ("), F.col("doc_id").cast("string"), F.lit(") Last"))
    return table(spark, sf_dir, "documents").select("doc_id", S.labels(text).alias("l")).select("doc_id", F.size("l").alias("n_labels"), F.array_join("l", "|").alias("labels"))


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text || chr(10) || '7' || chr(10) || 'Page 3 of 9' || chr(10) || 'end', chr(10))) AS raw, generate_subscripts(string_split(text || chr(10) || '7' || chr(10) || 'Page 3 of 9' || chr(10) || 'end', chr(10)), 1) - 1 AS line FROM documents),
g AS (SELECT *, length(raw) + 1 AS n, regexp_matches(raw, '^ *([1-9]|1[0-9]|2[0-5]) *$') OR raw = 'Page 3 of 9' AS gone FROM t)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS old_start, CASE WHEN NOT gone THEN CAST(coalesce(sum(CASE WHEN gone THEN 0 ELSE n END) OVER w, 0) AS BIGINT) END AS new_start
FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chrome_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of lines before and after page numbers and feet are taken out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n7\nPage 3 of 9\nend")).alias("text"))
    return R.chrome_offsets(d)
