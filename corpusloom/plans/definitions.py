"""Queries on definitions; whole documents are turned into defining prose by a fixed replacement that both engines make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import definitions as D
from corpusloom.plans.registry import Registry
from corpusloom.sources.bridge import table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

#: Replacements, in order, that put definitions of every way into prose.
_TURNS = ((" the ", ' "the one" means '), (" of ", ' " of\n" shall  mean '), (" and ", " “and” means "), (" en ", ' "En" is defined as '), (" der ", ' "der" are\ndefined as '), (" to ", " “to” shall mean "))
_TEXT = "text"
for _old, _new in _TURNS:
    _TEXT = f"replace({_TEXT}, '{_old}', '{_new}')"
_SECTIONS = "s AS (SELECT doc_id, coalesce(source, 'none') AS module_id, CAST(doc_id AS VARCHAR) AS section_id, [lang, CAST(doc_id % 3 AS VARCHAR)] AS hierarchy, " + _TEXT.replace("\n", "' || chr(10) || '") + " AS t FROM documents)"


def _found_sql(way: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{way}' AS way, w[k] AS whole, m[k] AS term, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x))), 0) AS pos
FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', 1) AS m, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS k FROM s)"""


_TERMS = "f AS (" + " UNION ALL ".join(_found_sql(w, p) for w, p in D.PATTERNS.items()) + """),
d AS (SELECT doc_id, term, way, CAST(pos + strpos(whole, term) - 1 AS BIGINT) AS start, CAST(pos + strpos(whole, term) - 1 + length(term) AS BIGINT) AS stop, CAST(pos + length(whole) AS BIGINT) AS match_end FROM f)"""
_RECORDS = r"""n AS (SELECT *, trim(regexp_replace(term, '[ \t\n]+', ' ', 'g')) AS canonical FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, canonical ORDER BY start, way) AS k FROM n),
e AS (SELECT s.*, o.term, o.canonical, way, start, stop, match_end, length(term) - length(ltrim(term, chr(10) || ' ')) AS lead, length(term) - length(rtrim(term, chr(10) || ' ')) AS tail FROM o JOIN s USING (doc_id) WHERE k = 1),
h AS (SELECT *, start - length(string_split(left(t, start), chr(10))[-1]) AS b, match_end + length(string_split(substr(t, match_end + 1), chr(10))[1]) AS q, start + lead + length(string_split(substr(t, start + lead + 1), chr(10))[1]) AS q2 FROM e),
defs AS (SELECT module_id || '/' || section_id || '#' || left(sha256(canonical), 8) AS def_id, module_id, canonical AS term, section_id AS defined_in, start + lead AS begin, stop - tail AS stop, regexp_replace(substr(t, b + 1, q - b), '^\s+|\s+$', '', 'g') AS raw, doc_id % 50 = 0 AS wide, hierarchy, way, b AS place_begin, q2 AS place_end FROM h)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.col("text")
    for old, new in _TURNS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return d.select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("none")).alias("module_id"), F.col("doc_id").cast("string").alias("section_id"), F.array("lang", F.expr("string(doc_id % 3)")).alias("hierarchy"), text.alias("text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of all documents; those whose number ends in 00 or 50 define for their whole module."""
    s = sections(spark, sf_dir)
    return D.definitions(s, D.defined_terms(s, id_col="key"), definers=F.col("key") % 50 == 0)


@query(f'WITH {_SECTIONS}, {_TERMS} SELECT doc_id, term, way, start, stop AS "end", match_end FROM d')
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term that whole texts define, with its place."""
    found = D.defined_terms(sections(spark, sf_dir), id_col="key")
    return found.select(F.col("key").alias("doc_id"), "term", "way", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "match_end")))


@query(f"""WITH {_SECTIONS}, {_TERMS}, {_RECORDS} SELECT def_id, term, defined_in, begin, stop AS "end", CASE WHEN length(raw) > 500 THEN left(raw, 499) || '…' ELSE raw END AS excerpt,
CASE WHEN wide THEN 'module' ELSE 'hierarchy' END AS scope_kind, CASE WHEN NOT wide THEN array_to_string(hierarchy, '/') END AS scope_prefix, CASE WHEN wide THEN 'manifest:declared-global' ELSE 'amlegal:pattern:' || way END AS source, place_begin, place_end FROM defs""")
def definition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every definition: anchor, excerpt, scope."""
    longs = {c: F.col(c).cast("long") for c in ("begin", "end", "place_begin", "place_end")}
    return records(spark, sf_dir).withColumns(longs).withColumn("scope_prefix", F.when(F.col("scope_prefix").isNotNull(), F.array_join("scope_prefix", "/"))).drop("module_id")


_USES = "CASE s_suppkey % 4 WHEN 0 THEN ' The  One ' WHEN 1 THEN 'AND' WHEN 2 THEN 'en' ELSE s_name END"


@query(f"""WITH {_SECTIONS}, {_TERMS}, {_RECORDS}, u AS (SELECT s_suppkey AS section_key, {_USES} AS term FROM supplier), k AS (SELECT lower(term) AS t, module_id, defined_in FROM defs)
SELECT section_key, u.term, module_id, defined_in FROM u LEFT JOIN k ON k.t = lower(trim(regexp_replace(u.term, '\\s+', ' ', 'g')))""")
def terms_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in use with the sections of all modules that define them."""
    uses = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section_key"), F.expr(_USES).alias("term"))
    return D.terms_defined(uses, records(spark, sf_dir))


_HITS_SQL = """w AS (SELECT doc_id, list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * 5 AS pos, k, unnest([1, 2]) AS part, hierarchy FROM (SELECT doc_id, hierarchy, string_split(t, '“and”') AS g, unnest(range(1, len(string_split(t, '“and”')))) AS k FROM s)),
occ AS (SELECT doc_id || '.' || k || '.' || part AS occ_id, CAST(doc_id AS VARCHAR) AS section_id, CASE part WHEN 1 THEN 'and' ELSE 'the one' END AS term, pos + 1 AS start, pos + 4 AS stop, hierarchy FROM w)"""


@query(f"""WITH {_SECTIONS}, {_TERMS}, {_RECORDS}, {_HITS_SQL},
c AS (SELECT occ_id, occ.term, def_id, defined_in, place_begin, place_end, occ.section_id, occ.start, occ.stop, count(*) OVER (PARTITION BY occ_id) AS n, row_number() OVER (PARTITION BY occ_id ORDER BY wide, defined_in, def_id) AS k
  FROM occ JOIN defs ON defs.term = occ.term AND (wide OR defs.hierarchy = occ.hierarchy)),
z AS (SELECT occ.occ_id, occ.term, CASE WHEN def_id IS NULL THEN 'unresolved' WHEN defined_in = occ.section_id AND occ.start >= place_begin AND occ.stop <= place_end THEN 'suppressed' ELSE 'kept' END AS fate, def_id, n - 1 AS n_dropped FROM occ LEFT JOIN c ON c.occ_id = occ.occ_id AND k = 1)
SELECT occ_id, term, fate, CASE WHEN fate = 'kept' THEN def_id END AS def_id, CASE WHEN fate = 'kept' THEN n_dropped END AS n_dropped FROM z""")
def resolved_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the uses of two terms in all texts."""
    s = sections(spark, sf_dir)
    found = s.select("key", "section_id", "hierarchy", F.posexplode(D.hits(F.col("text"), "“and”")).alias("k", "h"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))
    named = found.select(F.concat_ws(".", "key", F.col("k") + 1, "part").alias("occ_id"), "section_id", F.when(F.col("part") == 1, "and").otherwise("the one").alias("term"), (F.col("h.start") + 1).alias("start"), (F.col("h.start") + 4).alias("end"), "hierarchy")
    return D.resolved(named, records(spark, sf_dir))


_TAG = "concat('m', p_size % 3, '/', p_partkey % 7, CASE p_size % 11 WHEN 0 THEN '' ELSE '#' END, p_partkey % 90)"
_TAG_TERM = "CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) ELSE concat('É', p_name) END"


@query(f"SELECT DISTINCT p_partkey % 7 AS section_key, {_TAG} AS def_id FROM part WHERE {_TAG} NOT IN (SELECT concat('m', s_suppkey % 3, '/', s_suppkey % 7, '#', s_suppkey % 90) FROM supplier)")
def gate_unknown_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition ids in sections that no module has."""
    known = table(spark, sf_dir, "supplier").select(F.expr("concat('m', s_suppkey % 3, '/', s_suppkey % 7, '#', s_suppkey % 90)").alias("def_id"))
    return D.unknown_ids(table(spark, sf_dir, "part").select(F.expr("p_partkey % 7").alias("section_key"), F.expr(_TAG).alias("def_id")), known)


@query(f"""SELECT p_partkey, definer, capital, NOT capital AND coalesce(definer <> CAST(p_partkey % 5 AS VARCHAR), true) AS lost_outside
FROM (SELECT p_partkey, CASE WHEN {_TAG} LIKE '%#%' THEN split_part(split_part({_TAG}, '#', 1), '/', 2) END AS definer, ascii({_TAG_TERM}) BETWEEN 65 AND 90 AS capital FROM part)""")
def recall_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definers of tags, capitals, and which losses would fail the gate."""
    tags = table(spark, sf_dir, "part").select("p_partkey", F.expr("string(p_partkey % 5)").alias("section_key"), F.expr(_TAG).alias("def_id"), F.expr(_TAG_TERM).alias("term"))
    return D.recall_keys(tags).select("p_partkey", "definer", "capital", "lost_outside")
