"""Joins: reverse graph, outbound references, siblings, binding, definitions, ranges, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import natural_key, natural_key_sql
from corpusloom.operators import references as R
from corpusloom.plans.registry import Registry
from corpusloom.sources import bridge
from corpusloom.sources.bridge import CITATIONS_SQL, SECTIONS_SQL, table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql


@query(f"WITH {CITATIONS_SQL} SELECT cited_id, count(DISTINCT citing_id) AS n_citing, min(citing_id) AS first_citing, max(citing_id) AS last_citing FROM citations GROUP BY cited_id")
def reverse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who cites each node: distinct pairs, then one row per node."""
    pairs = R.reverse_graph(bridge.citations(spark, sf_dir))
    return pairs.groupBy("cited_id").agg(F.count("*").alias("n_citing"), F.min("citing_id").alias("first_citing"), F.max("citing_id").alias("last_citing"))


@query(f"WITH {CITATIONS_SQL} SELECT citing_id, cited_id, min(citation_index) AS citation_index FROM citations GROUP BY citing_id, cited_id")
def outbound_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each node, each target once, at its first place."""
    return R.first_seen(bridge.citations(spark, sf_dir), ["citing_id", "cited_id"], ["citation_index"]).select("citing_id", "cited_id", "citation_index")


@query(f"""WITH {CITATIONS_SQL}, out AS (SELECT DISTINCT citing_id, cited_id FROM citations)
SELECT citing_id, count(*) AS n_refs, count(doc_id) AS n_installed FROM out LEFT JOIN documents ON doc_id = cited_id GROUP BY citing_id""")
def installed_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a node's references lead to a section that the corpus has (left outer join)."""
    out = bridge.citations(spark, sf_dir).select("citing_id", "cited_id").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return out.join(docs, F.col("cited_id") == F.col("doc_id"), "left").groupBy("citing_id").agg(F.count("*").alias("n_refs"), F.count("doc_id").alias("n_installed"))


@query(f"""WITH {SECTIONS_SQL}, n AS (SELECT module_id, article_id, count(*) AS n FROM sections GROUP BY 1, 2)
SELECT doc_id, module_id, article_id, n - 1 AS n_siblings FROM sections JOIN n USING (module_id, article_id)""")
def article_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other sections share a section's article; counts are joined back, so a large article is not paired with itself."""
    s = bridge.sections(spark, sf_dir).select("doc_id", "module_id", F.lower("article_id").alias("article_id"))
    n = s.groupBy("module_id", "article_id").agg(F.count("*").alias("n"))
    return s.join(n, ["module_id", "article_id"]).select("doc_id", "module_id", "article_id", (F.col("n") - 1).alias("n_siblings"))


@query("""SELECT l_partkey AS section_id, count(DISTINCT l_orderkey) AS n_bills, max(o_orderdate) AS last_introduced
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def bills_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index of the bills that touch each section, each bill once."""
    touched = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("section_id")).distinct()
    bills = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return touched.join(bills, "o_orderkey").groupBy("section_id").agg(F.count("*").alias("n_bills"), F.max("o_orderdate").alias("last_introduced"))


#: Display rules of the bridge's modules: prefix, extra prefixes, whether a final .0 may be missing.
RULES = {"p": ("p", ("g",), True)}


@query("""WITH anchors AS (SELECT DISTINCT source AS module_id, CASE doc_id % 3 WHEN 0 THEN 'p' || doc_id WHEN 1 THEN 'g' || doc_id ELSE doc_id || '.0' END AS anchor_id FROM documents),
refs AS (SELECT doc_id AS ref_id, source AS module_id, CAST(doc_id AS VARCHAR) AS r FROM documents),
cand AS (SELECT ref_id, module_id, 0 AS rank, 'p' || r AS anchor_id FROM refs UNION ALL SELECT ref_id, module_id, 1, r FROM refs UNION ALL SELECT ref_id, module_id, 2, 'g' || r FROM refs
 UNION ALL SELECT ref_id, module_id, 3, 'p' || r || '.0' FROM refs UNION ALL SELECT ref_id, module_id, 4, r || '.0' FROM refs UNION ALL SELECT ref_id, module_id, 5, 'g' || r || '.0' FROM refs),
hit AS (SELECT ref_id, arg_min(anchor_id, rank) AS anchor_id FROM cand JOIN anchors USING (module_id, anchor_id) GROUP BY ref_id)
SELECT ref_id, module_id, anchor_id FROM refs LEFT JOIN hit USING (ref_id)""")
def anchor_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bind references by their ordered candidates; the first that exists wins."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("module_id"))
    number = F.col("doc_id").cast("string")
    anchor = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p"), number)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("g"), number)).otherwise(F.concat(number, F.lit(".0")))
    prefix, extra, zero = RULES["p"]
    refs = d.select(F.col("doc_id").alias("ref_id"), "module_id", R.candidates(number, prefix, extra, zero).alias("candidates"))
    return R.bind_first(refs, d.select("module_id", anchor.alias("anchor_id"))).select("ref_id", "module_id", "anchor_id")


@query("""WITH anchors AS (SELECT DISTINCT source AS module_id, CAST(n_chars % 500 AS VARCHAR) AS anchor_id FROM documents),
refs AS (SELECT doc_id AS ref_id, source AS own, CAST(n_chars % 500 AS VARCHAR) AS anchor_id FROM documents),
hit AS (SELECT ref_id, module_id, anchor_id FROM refs JOIN anchors USING (anchor_id) WHERE module_id <> own)
SELECT ref_id, max(module_id) AS module_id, max(anchor_id) AS anchor_id FROM hit GROUP BY ref_id HAVING count(*) = 1""")
def sibling_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bind references to the one other module that has their anchor."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("module_id"), (F.col("n_chars") % 500).cast("string").alias("anchor_id"))
    refs = d.select(F.col("doc_id").alias("ref_id"), "module_id", F.array("anchor_id").alias("candidates"))
    return R.bind_sibling(refs, d.select("module_id", "anchor_id"))


@query("""WITH occ AS (SELECT doc_id AS occ_id, lang AS term, [source, lang, 'a' || doc_id % 7] AS h FROM documents),
defs AS (SELECT DISTINCT source || '/' || lang || '/' || doc_id % 3 AS def_id, lang AS term, doc_id % 3 AS k, source AS defined_in, [source, lang][1:doc_id % 3] AS prefix FROM documents),
met AS (SELECT occ_id, occ.term, def_id, CASE WHEN k = 0 THEN 'module' ELSE 'hierarchy' END AS scope_kind,
  row_number() OVER (PARTITION BY occ_id ORDER BY CASE WHEN k = 0 THEN 1 ELSE 0 END, k DESC, defined_in, def_id) AS rn, count(*) OVER (PARTITION BY occ_id) AS n
  FROM occ JOIN defs USING (term) WHERE k = 0 OR h[1:k] = prefix)
SELECT occ_id, term, def_id, scope_kind, n - 1 AS n_dropped FROM met WHERE rn = 1""")
def definition_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition in scope at each occurrence: an equality join on the term, a prefix test and a ranked pick."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    occ = d.select(F.col("doc_id").alias("occ_id"), F.col("lang").alias("term"), F.array("source", "lang", F.concat(F.lit("a"), (F.col("doc_id") % 7).cast("string"))).alias("hierarchy"))
    k = (F.col("doc_id") % 3).cast("int")
    prefix = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("source")).otherwise(F.array("source", "lang"))
    defs = d.select(
        F.concat_ws("/", "source", "lang", k.cast("string")).alias("def_id"), F.col("lang").alias("term"), F.when(k == 0, "module").otherwise("hierarchy").alias("scope_kind"), prefix.alias("scope_prefix"), F.col("source").alias("defined_in")
    ).distinct()
    return R.resolve_definitions(occ, defs)


@query("""WITH citing AS (SELECT doc_id AS cite_id, n_chars % 97 AS k, [source, lang, 'a' || doc_id % 7] AS h FROM documents),
fam AS (SELECT n_chars % 97 AS k, doc_id AS m, [source, lang, 'a' || doc_id % 7][1:1 + doc_id % 3] AS mh FROM documents),
met AS (SELECT cite_id, m, len(mh) AS depth FROM citing JOIN fam USING (k) WHERE h[1:len(mh)] = mh),
top AS (SELECT cite_id, m FROM (SELECT *, max(depth) OVER (PARTITION BY cite_id) AS d FROM met) WHERE depth = d),
one AS (SELECT cite_id, max(m) AS member_id FROM top GROUP BY cite_id HAVING count(*) = 1)
SELECT cite_id, member_id FROM citing LEFT JOIN one USING (cite_id)""")
def family_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of collision families chosen by the deepest shared hierarchy."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("family_key"), F.array("source", "lang", F.concat(F.lit("a"), (F.col("doc_id") % 7).cast("string"))).alias("hierarchy"))
    family = d.select("family_key", F.col("doc_id").alias("member_id"), F.slice("hierarchy", 1, (F.col("doc_id") % 3 + 1).cast("int")).alias("member_hierarchy"))
    return R.disambiguate(d.select(F.col("doc_id").alias("cite_id"), "family_key", "hierarchy"), family)


@query("""WITH ranges AS (SELECT l_orderkey AS doc, l_linenumber AS range_id, l_linenumber * 10 AS b, l_linenumber * 10 + 15 AS e FROM lineitem),
spans AS (SELECT o_orderkey AS doc, o_custkey AS span_id, CAST(o_custkey % 90 AS BIGINT) AS pos FROM orders)
SELECT doc, span_id, CAST(arg_min(range_id, b) AS BIGINT) AS range_id FROM spans JOIN ranges USING (doc) WHERE pos >= b AND pos < e GROUP BY doc, span_id""")
def span_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans dealt to the first range that holds their start (interval join on blocks)."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("long")
    ranges = li.select(F.col("l_orderkey").alias("doc"), n.alias("range_id"), (n * 10).alias("begin"), (n * 10 + 15).alias("end"))
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("span_id"), (F.col("o_custkey") % 90).alias("at"))
    return R.spans_in_ranges(spans, ranges)


@query("""WITH b AS (SELECT DISTINCT source AS s, lang AS k FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT DISTINCT source AS s, lang AS k FROM documents WHERE doc_id % 3 <> 1)
SELECT coalesce(b.s, c.s) AS section, coalesce(b.k, c.k) AS tag, CASE WHEN c.s IS NULL THEN 'dropped' ELSE 'added' END AS change
FROM b FULL JOIN c ON b.s = c.s AND b.k = c.k WHERE b.s IS NULL OR c.s IS NULL""")
def recall_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that one capture has and the other lacks, as two anti-joins."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section"), F.col("lang").alias("tag"))
    base, now = d.where("doc_id % 3 <> 0").select("section", "tag").distinct(), d.where("doc_id % 3 <> 1").select("section", "tag").distinct()
    keys = ["section", "tag"]
    return base.join(now, keys, "left_anti").withColumn("change", F.lit("dropped")).union(now.join(base, keys, "left_anti").withColumn("change", F.lit("added")))


@query(f"""WITH {CITATIONS_SQL}, {SECTIONS_SQL},
v AS (SELECT citing_id, citation_index, target_kind, s.doc_id, editorial_status FROM citations c LEFT JOIN sections s ON s.doc_id = c.cited_id)
SELECT citing_id, citation_index, CASE WHEN target_kind = 'vague' THEN 'unresolvable' WHEN doc_id IS NULL THEN CASE target_kind WHEN 'cross_module' THEN 'external' ELSE 'missing_section' END
 WHEN editorial_status = 'redesignated' THEN 'redirected' WHEN editorial_status = 'active' THEN 'resolved' ELSE 'inactive' END AS verdict FROM v""")
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each citation leads to, from one left join."""
    s = bridge.sections(spark, sf_dir).select(F.col("doc_id").alias("cited_id"), "editorial_status", F.lit(1).alias("found"))
    status, kind = F.col("editorial_status"), F.col("target_kind")
    missing = F.when(kind == "cross_module", "external").otherwise("missing_section")
    verdict = F.when(kind == "vague", "unresolvable").when(F.col("found").isNull(), missing).when(status == "redesignated", "redirected").when(status == "active", "resolved").otherwise("inactive")
    return bridge.citations(spark, sf_dir).join(s, "cited_id", "left").select("citing_id", "citation_index", verdict.alias("verdict"))


@query("""SELECT p.p_partkey AS section_id, p_name AS baseline, count(l_orderkey) AS n_outcomes FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY 1, 2""")
def baseline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline text of each section with the outcomes that need it; counts are taken before the join."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("section_id")).agg(F.count("*").alias("n"))
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("section_id"), F.col("p_name").alias("baseline"))
    return base.join(n, "section_id", "left").select("section_id", "baseline", F.coalesce("n", F.lit(0)).alias("n_outcomes"))


@query(f"""WITH {SECTIONS_SQL} SELECT module_id, chapter, first(doc_id ORDER BY {natural_key_sql("section_id")}, doc_id) AS first_section, count(*) AS n_sections FROM sections GROUP BY 1, 2""")
def structural_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section of every structural node, in natural order."""
    s = bridge.sections(spark, sf_dir)
    return s.groupBy("module_id", "chapter").agg(F.min_by("doc_id", F.struct(natural_key(F.col("section_id")), "doc_id")).alias("first_section"), F.count("*").alias("n_sections"))

