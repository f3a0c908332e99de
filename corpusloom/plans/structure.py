"""Bills' structure and texts whose spans survive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage
from corpusloom.operators import bill_structure as B
from corpusloom.operators import grammar as G
from corpusloom.operators import spantext
from corpusloom.plans.citations import places_sql
from corpusloom.plans.registry import Registry
from corpusloom.sources.bridge import table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

#: A bill per order: a preamble, then for each line item a group that amends a code (A, R) or a section of the group before it (N), and an end.
#: Each piece is a header line and a body of three paragraphs; some are followed by an article's line.
_CODES = "CASE l_suppkey % 3 WHEN 0 THEN 'Health' WHEN 1 THEN 'Public Works' ELSE 'Mayor''s' END"
_HEAD = "concat('SEC. ', l_partkey, '.', l_linenumber, CASE l_suppkey % 2 WHEN 0 THEN 'A' ELSE '' END, '. PERMITS & FEES – ', CASE l_partkey % 3 WHEN 0 THEN concat('PART ', l_partkey, '\\nOF THE WORK.') ELSE 'MAYOR''S OFFICE.' END)"
_BODY = "concat('\\n(a)  First, part ', l_partkey, '\\nwrapped.\\n\\nSecond  one.\\n', CASE l_suppkey % 3 WHEN 0 THEN '(2) \\n' ELSE '' END, '(b) Third ', l_suppkey, '\\n')"
_ACTION = f"concat('Section ', l_linenumber, '. The ', {_CODES}, ' Code is hereby amended by\\nrevising Section ', l_partkey, ', to read as follows:\\n\\n')"
_ARTICLE = "CASE l_suppkey % 4 WHEN 0 THEN concat('ARTICLE ', l_suppkey, ': FEES\\nnot of the section\\n') ELSE '' END"
_OPENS = "(l_returnflag <> 'N' OR k = 1)"
_PREAMBLE = "concat('[Codes - Order ', o_orderkey, ']\\nOrdinance amending codes\\nby adding Chapter ', o_orderkey, ';\\n\\nBe it ordained:\\n')"
_CLOSING = "concat('Section 99. Effective Date.  In force\\nat once.\\nAPPROVED AS TO FORM:\\nClerk ', o_custkey)"
_ORDER = "l_linenumber, l_partkey, l_suppkey"


def _sql(text: str) -> str:
    return text.replace("\\n", "' || chr(10) || '").replace("concat(", "concat(")


def _of_item(piece: str) -> str:
    """A line item's expression inside a list of them: its columns are fields of x, its number there is n."""
    return re.sub(r"\bl_(\w+)", r"x.l_\1", piece).replace("k = 1", "n = 0")


def bill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills' texts, dealt out by the shuffle that makes them: a broadcast of them would leave the work on them to the tasks that read the orders."""
    # numbers cross the network, texts are made where a bill's come together
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("items")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items)
    piece = F.expr(f"transform(items, (x, n) -> {_of_item(f"concat(CASE WHEN {_OPENS} THEN {_ACTION} ELSE '' END, {_HEAD}, {_BODY}, {_ARTICLE})")})")
    parts = li.select("l_orderkey", F.array_join(piece, "").alias("body"))
    o = table(spark, sf_dir, "orders")
    held = o.join(parts.hint("merge"), o.o_orderkey == parts.l_orderkey, "left")
    return held.select(F.col("o_orderkey").alias("file_no"), F.when(F.col("body").isNull(), F.expr(_PREAMBLE)).otherwise(F.concat(F.expr(_PREAMBLE), "body", F.expr(_CLOSING))).alias("text"))


_PIECES = f"""n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS k FROM lineitem),
p AS (SELECT *, {_OPENS} AS opens, {_sql(_HEAD)} AS head, {_sql(_BODY)} AS body, {_sql(_ARTICLE)} AS article, CASE WHEN {_OPENS} THEN {_sql(_ACTION)} ELSE '' END AS action, length({_sql(_PREAMBLE)}) AS pre, {_sql(_CLOSING)} AS closing FROM n JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT *, pre + coalesce(sum(length(action) + length(head) + length(body) + length(article)) OVER (PARTITION BY o_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY o_orderkey ORDER BY k) AS group_no FROM p),
b AS (SELECT *, pos + length(action) AS head_at, pos + length(action) + length(head) + length(body) AS body_end, pos + length(action) + length(head) + length(body) + length(article) AS piece_end, row_number() OVER (PARTITION BY o_orderkey, group_no ORDER BY k) AS header_no,
  regexp_replace(substr(head, strpos(head, 'PERMITS')), '\\s+', ' ', 'g') AS title, split_part(head, ' ', 2)[:-2] AS number FROM a)"""


@query(f"""WITH {_PIECES} SELECT o_orderkey AS file_no, 'header' AS kind, group_no, header_no, number, title AS name, head_at - CAST(opens AS INTEGER) AS start, head_at + length(head) AS after, body_end AS stop FROM b
UNION ALL SELECT o_orderkey, 'group', group_no, NULL, CAST(min(l_linenumber) FILTER (opens) AS VARCHAR), min({_CODES} || ' Code') FILTER (opens), min(pos), min(pos) + min(strpos(action, 'amended') + 6) FILTER (opens), max(piece_end) FROM b GROUP BY 1, 3
UNION ALL SELECT o_orderkey, 'preamble', NULL, NULL, NULL, NULL, 0, NULL, length({_sql(_PREAMBLE)}) FROM orders
UNION ALL SELECT o_orderkey, 'closing', NULL, NULL, NULL, NULL, max(piece_end), NULL, max(piece_end) + max(length(closing)) FROM b GROUP BY 1""")
def bill_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, disjoint ranges of every bill's whole text: codes that it amends, their sections, what comes before and after."""
    found = B.ranges(bill_texts(spark, sf_dir))
    longs = [F.col(c).cast("long").alias(a) for c, a in (("group_no", "group_no"), ("header_no", "header_no"), ("start", "start"), ("after", "after"), ("end", "stop"))]
    return found.select("file_no", "kind", "number", "name", *longs)


_FIRST = "'First, part ' || l_partkey || ' wrapped.'"


@query(f"""WITH {_PIECES}, x AS (SELECT o_orderkey AS file_no, group_no, header_no, title, l_partkey, l_suppkey, l_suppkey % 3 = 0 AS two FROM b)
SELECT file_no, group_no, header_no, 'code_section_header' AS kind, NULL AS marker, NULL AS subsection, title AS text FROM x
UNION ALL SELECT file_no, group_no, header_no, 'paragraph', '(a)', 1, 'First, part ' || l_partkey || ' wrapped.' FROM x UNION ALL SELECT file_no, group_no, header_no, 'paragraph', '(a)', 1, 'Second one.' FROM x
UNION ALL SELECT file_no, group_no, header_no, 'paragraph', '(2)', 2, NULL FROM x WHERE two UNION ALL SELECT file_no, group_no, header_no, 'paragraph', '(b)', CASE WHEN two THEN 3 ELSE 2 END, 'Third ' || l_suppkey FROM x
UNION ALL SELECT o_orderkey, group_no, NULL, 'action', NULL, NULL, trim(regexp_replace(action, '\\s+', ' ', 'g')) FROM b WHERE opens
UNION ALL SELECT o_orderkey, NULL, NULL, 'preamble', NULL, NULL, '[Codes - Order ' || o_orderkey || ']' || chr(10) || chr(10) || 'Ordinance amending codes by adding Chapter ' || o_orderkey || ';' || chr(10) || chr(10) || 'Be it ordained:' FROM orders
UNION ALL SELECT DISTINCT o_orderkey, NULL, NULL, 'closing', NULL, NULL, 'Section 99. Effective Date. In force at once.' || chr(10) || chr(10) || 'APPROVED AS TO FORM: Clerk ' || o_custkey FROM b""")
def bill_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every bill, after the gate on headers."""
    texts = bill_texts(spark, sf_dir)
    # both what is counted and what is given read the ranges; texts are cut as these are found
    found = stage(B.ranges(texts, raw=True), "bill-ranges")
    return B.gated(stage(B.blocks(texts, found), "bill-blocks"), found).select("file_no", F.col("group_no").cast("long"), F.col("header_no").cast("long"), "kind", "marker", "subsection", "text")


@query("SELECT o_orderkey AS file_no, 'by adding Chapter ' || o_orderkey AS action FROM orders")
def structural_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bill does to whole chapters."""
    return bill_texts(spark, sf_dir).select("file_no", B.structural_action(F.col("text")).alias("action"))


_WORDS = "(Orre|License|Ci|Und|And)"
_LOOSE = "replace(replace(text, ' o', chr(9) || ' ' || chr(160) || 'o'), '. ', '. ' || chr(10) || '  ' || chr(10) || ' ')"
_CLEAN = lambda t: f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


@query(f"""WITH t AS (SELECT doc_id, {_LOOSE} AS t FROM documents), f AS ({places_sql(rf"{_WORDS}[^.]*[.]")})
SELECT doc_id, CAST(length({_CLEAN("left(t, CAST(start AS BIGINT)) || 'x'")}) - 1 AS INTEGER) AS start, CAST(length({_CLEAN("left(t, CAST(start + length(raw) AS BIGINT))")}) AS INTEGER) AS stop, {_CLEAN("raw")} AS text FROM f JOIN t USING (doc_id)""")
def projected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where spans of whole texts go when white space is cleaned, and their text there."""
    loose = F.expr("replace(replace(text, ' o', concat('\\t ', char(160), 'o')), '. ', '. \\n  \\n ')")
    d = table(spark, sf_dir, "documents").select("doc_id", loose.alias("t"))
    places = F.transform(G.hits(F.col("t"), rf"{_WORDS}[^.]*[.]"), lambda h: F.named_struct(F.lit("start"), h["start"], F.lit("end"), h["start"] + F.length(h["whole"]), F.lit("format"), F.lit("bold")))
    moved = d.withColumn("spans", places).select("doc_id", spantext.clean_lines(F.col("t"), F.col("spans")).alias("x")).select("doc_id", "x.text", F.explode("x.spans").alias("s"))
    return moved.select("doc_id", "s.start", F.col("s.end").alias("stop"), F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


#: Runs of a page for every order: text, chrome of each kind, spaces before a line's end.
_RUN = """CASE l_linenumber % 7 WHEN 1 THEN concat('Section ', l_partkey, ' ') WHEN 2 THEN '12' WHEN 3 THEN concat('word', l_suppkey) WHEN 4 THEN concat('BOARD OF SUPERVISORS Page ', l_suppkey) WHEN 5 THEN concat('tail', l_partkey, '   ')
  WHEN 6 THEN concat('Supervisors Chan; Safai') ELSE 'NOTE: Additions' END"""
_KEPT = "CASE l_linenumber % 7 WHEN 1 THEN 'Section ' || l_partkey || chr(10) WHEN 3 THEN 'word' || l_suppkey || chr(10) WHEN 5 THEN 'tail' || l_partkey || chr(10) ELSE '' END"


@query(f"""WITH n AS (SELECT o.o_orderkey AS doc, l_linenumber, l_partkey, l_suppkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) JOIN orders o ON l_orderkey = o_orderkey
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) < 3)),
k AS (SELECT *, {_KEPT} AS kept, sum(length({_KEPT})) OVER (PARTITION BY doc ORDER BY l_linenumber) - length({_KEPT}) AS start, length(string_agg({_KEPT}, '') OVER (PARTITION BY doc)) AS whole FROM n)
SELECT doc, CAST(l_linenumber AS BIGINT) AS run, CAST(start AS INTEGER) AS start, CAST(start + length(rtrim(kept, chr(10))) AS INTEGER) AS stop, rtrim(kept, chr(10)) AS text FROM k WHERE kept <> ''""")
def run_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run of a bill's pages stands in its text without chrome."""
    from pyspark.sql import Window

    # dealt out by order once, for all that follows
    li = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    long = li.withColumn("m", F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))).where("m >= 3")
    runs = long.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("run"), F.expr(_RUN).alias("text"), F.lit(True).alias("has_eol"))
    made = spantext.run_texts(runs).select("doc", "text", F.explode("ranges").alias("r"))
    return made.select("doc", "r.run", "r.start", F.col("r.end").alias("stop"), F.substr("text", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("text"))


@query("""WITH w AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(w, lambda x: x <> '')) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS told, CAST(length(array_to_string(w, ' ')) - length(w[-1]) AS INTEGER) AS last_start FROM w WHERE w[1] <> ''""")
def normal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all normal texts and where the last one stands."""
    t = table(spark, sf_dir, "documents").select("doc_id", spantext.tokens(F.col("text")).alias("w")).where("size(w) > 0")
    return t.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join(F.transform("w", lambda x: x["token"]), " ")).alias("told"), F.element_at("w", -1)["start"].alias("last_start"))


@query("""WITH d AS (SELECT doc_id, doc_id // 7 AS block, doc_id % 7 AS k, text, left(text, 20) AS head FROM documents), p AS (SELECT *, regexp_matches(text, '[0-9A-Za-z]') AND k > 0 AS kept FROM d),
a AS (SELECT *, coalesce(sum(length(text) + 1) FILTER (kept) OVER (PARTITION BY block ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM p)
SELECT block AS page, CAST(base + 2 AS INTEGER) AS start, CAST(base + 9 AS INTEGER) AS stop, substr(text, 3, 7) AS text FROM a WHERE kept AND length(text) >= 9""")
def body_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of boxes in the bodies that the boxes are joined to, and their text there."""
    d = table(spark, sf_dir, "documents")
    span = F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("end"), F.lit("bold").alias("format")))
    boxes = d.select(F.expr("doc_id div 7").alias("page"), F.expr("doc_id % 7").alias("pos"), "text", F.when(F.length("text") >= 9, span).otherwise(F.array().cast(spantext.SPANS)).alias("spans"))
    made = spantext.bodies(boxes, "page", F.col("pos") == 0).select("page", "body", F.explode("spans").alias("s"))
    return made.select("page", "s.start", F.col("s.end").alias("stop"), F.substr("body", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))
