"""Queries on the grammar of citations, over references that are made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import grammar as G
from corpusloom.plans.registry import Registry
from corpusloom.sources.bridge import table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

_A, _B = "l_partkey", "l_linenumber"
#: How line items are written as citations, by a key: pieces that both engines join.
_FORMS = (
    f"'§ ', {_A}, '.', {_B}", f"' §§', {_A}, '.', {_B}, '-', {_A}, '.', {_B} + 1, ' '", f"'Section ', {_A}, 'A.', {_B}, ' to ', {_A}, 'A.', {_B} + 2",
    f"'sections  ', {_A}, '.', {_B}, '-2'", f"'Sec. ', {_A}, '(a)(', {_B}, ')'", f"'Article ', l_suppkey", f"'Chapters ', l_suppkey, '.', {_B}", "'ARTICLE XIV'",
    f"'subsection (b)(', {_B}, ')'", "'Subdivisions (B)'", f"'Division. ', l_suppkey, 'a'", f"'Clause ', {_A}", f"'Section A', {_A}, '.', {_B}, '—A', {_A} + 1, '.1'", f"'SECTION ', {_A}, '.', {_B}, '.0B(C)'", f"'Sec ', {_A}, ' and'", f"'Title ', {_A}, ' '",
)
_CITE = f"CASE (l_orderkey + l_linenumber * 5) % {len(_FORMS)} " + " ".join(f"WHEN {k} THEN concat({f})" for k, f in enumerate(_FORMS)) + " END"
_KEY = "concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey)"
_MODULE = "CASE WHEN l_suppkey % 3 = 0 THEN concat('m', l_suppkey % 5) END"
_NOW = "CASE WHEN l_partkey % 4 > 0 THEN concat(l_suppkey, '.1') END"
_REFS_SQL = f"r AS (SELECT DISTINCT {_KEY} AS ref_id, {_CITE} AS cite, {_MODULE} AS module, {_NOW} AS now FROM lineitem)"
_E = lambda x, p, k: f"nullif(regexp_extract({x}, '{p}', {k}), '')"
_DOTS = lambda x: f"(length({x}) - length(replace({x}, '.', '')))"
_PARSED = f"""p AS (SELECT *, trim(cite) AS t, CASE WHEN trim(cite) LIKE '§%' THEN '§' ELSE lower(regexp_extract(trim(cite), '^([A-Za-z]+)\\.?\\s+.', 1)) END AS w,
  CASE WHEN trim(cite) LIKE '§%' THEN trim(ltrim(trim(cite), '§')) ELSE {_E("trim(cite)", "^[A-Za-z]+\\.?\\s+(.+)$", 1)} END AS n0 FROM r),
q AS (SELECT *, CASE WHEN w IN ('§', 'sec', 'section', 'sections') THEN 'section' WHEN w IN ('subsection', 'subsections', 'subdivision', 'subdivisions') THEN 'subsection'
  WHEN rtrim(w, 's') IN ('article', 'chapter', 'division', 'title') THEN rtrim(w, 's') END AS k FROM p),
g AS (SELECT ref_id, cite, module, now, k AS prefix_kind, CASE WHEN k IS NOT NULL THEN n0 END AS number, CASE WHEN k IS NOT NULL THEN n0 END AS n FROM q),
x AS (SELECT *, {_E("n", G.RANGE, 1)} AS r1, {_E("n", G.RANGE, 2)} AS r2, {_E("n", G.HYPHENS, 1)} AS h1, {_E("n", G.HYPHENS, 2)} AS h2, {_E("n", G.SINGLE, 1)} AS s1, {_E("n", G.SINGLE, 2)} AS s2, {_E("n", G.LABELS, 1)} AS l1, {_E("n", G.PART, 1)} AS p1 FROM g),
y AS (SELECT *, CASE WHEN prefix_kind = 'section' THEN CASE WHEN r1 IS NOT NULL THEN 'range' WHEN h1 IS NOT NULL AND {_DOTS("h1")} = {_DOTS("h2")} THEN 'hyphen' WHEN s1 IS NOT NULL THEN 'single' END
  WHEN prefix_kind = 'subsection' THEN CASE WHEN l1 IS NOT NULL AND now IS NOT NULL THEN 'label' END WHEN p1 IS NOT NULL THEN 'part' END AS how FROM x)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"ref_id": _KEY, "cite": _CITE, "module": _MODULE, "now": _NOW}
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in named.items()]).distinct()


@query(f"""WITH {_REFS_SQL}, {_PARSED} SELECT ref_id, prefix_kind, number, CASE WHEN how IN ('range', 'hyphen', 'single') THEN CASE WHEN module IS NULL THEN 'internal' ELSE 'cross_module' END WHEN how = 'label' THEN 'internal' WHEN how = 'part' THEN 'structural' END AS kind,
  CASE WHEN how = 'part' THEN prefix_kind END AS level, CASE WHEN how IN ('range', 'hyphen', 'single') THEN module END AS module_id,
  CASE how WHEN 'range' THEN lower(r1) WHEN 'hyphen' THEN lower(h1) WHEN 'single' THEN lower(s1) WHEN 'label' THEN now WHEN 'part' THEN p1 END AS section_id,
  CASE how WHEN 'range' THEN lower(r2) WHEN 'hyphen' THEN lower(h2) END AS range_to, CASE how WHEN 'single' THEN s2 WHEN 'label' THEN l1 END AS subsection FROM y""")
def citation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, number and target of every citation."""
    r = refs(spark, sf_dir).withColumns({"p": G.prefix(F.col("cite")), "t": G.target(F.col("cite"), F.col("module"), F.col("now"))})
    return r.select("ref_id", F.col("p.kind").alias("prefix_kind"), "p.number", "t.kind", "t.level", "t.module_id", "t.section_id", "t.range_to", "t.subsection")


@query("""SELECT p_partkey, unnest(f) AS candidate, generate_subscripts(f, 1) AS rank FROM (SELECT p_partkey, [b, 'p' || b, 'g' || b] AS f FROM
(SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a' || p_partkey ELSE 'a' || p_partkey || '.' || p_size % 3 END AS b FROM part))""")
def bill_id_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section ids that numbers in bills may mean."""
    raw = F.expr("concat('A', p_partkey, '.', p_size % 3)")
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(G.bill_candidates(raw, "p", ("g",), strip_zero=True)).alias("place", "candidate"))
    return found.select("p_partkey", "candidate", (F.col("place") + 1).cast("long").alias("rank"))


_CODES = {"src0": "of the", "src1": "it is", "src2": "und", "src3": "que le"}


def _phrases_sql(module: str, title: str) -> str:
    pattern = rf"(?i)\b{title}\b"
    return f"""SELECT doc_id, '{module}' AS module_id, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * {len(title)} AS BIGINT) AS start
FROM (SELECT doc_id, g, unnest(range(1, len(g))) AS k FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g FROM documents WHERE text IS NOT NULL AND (source IS NULL OR source <> '{module}')))"""


@query("SELECT doc_id, module_id, start, start + CASE module_id " + " ".join(f"WHEN '{m}' THEN {len(t)}" for m, t in _CODES.items()) + ' END AS "end" FROM (' + " UNION ALL ".join(_phrases_sql(m, t) for m, t in _CODES.items()) + ")")
def code_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where whole texts name the codes of other modules."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "module_id")
    return G.code_phrases(docs, _CODES).withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


#: A registry of modules outside the corpus, in order.
_OUTSIDE = {"standard-code": [r"\bstandard\b", "economic plan"], "middle-code": ["^medium$"], "size-code": ["(?:large|small|um)$", "^ec"]}


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)\bstandard\b|economic plan') THEN 'standard-code' WHEN regexp_matches(p_type, '(?i)^medium$') THEN 'middle-code' WHEN regexp_matches(p_type, '(?i)(?:large|small|um)$|^ec') THEN 'size-code' END AS module_id FROM part""")
def external_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first module outside the corpus whose patterns a phrase fits."""
    return table(spark, sf_dir, "part").select("p_partkey", G.external_module(F.col("p_type"), _OUTSIDE).alias("module_id"))


_NAMES = "CASE p_size % 4 WHEN 0 THEN concat(p_brand, ' Code ') WHEN 1 THEN upper(p_brand) WHEN 2 THEN concat(p_brand, '  charter') ELSE concat('Building Inspection ', CASE p_partkey % 2 WHEN 0 THEN 'Code' ELSE 'Codes' END) END"


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part), m AS (SELECT lower(p_brand) AS stub, min('m-' || lower(replace(p_brand, '#', '-'))) AS module_id FROM part WHERE p_brand NOT LIKE '%5' GROUP BY 1 UNION ALL SELECT 'building inspection', 'sf-building')
SELECT p_partkey, name, module_id FROM n LEFT JOIN m ON stub = regexp_replace(lower(trim(name)), '\\s+(code|charter)$', '')""")
def code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules of the codes that bills name, by their stubs and an alias."""
    p = table(spark, sf_dir, "part")
    modules = p.where("p_brand not like '%5'").select(F.expr("concat('m-', lower(replace(p_brand, '#', '-')))").alias("module_id"), F.concat("p_brand", F.lit(" Code")).alias("code_title")).distinct()
    return G.named_modules(p.select("p_partkey", F.expr(_NAMES).alias("name")), modules)


_REF = "CASE p_size % 5 WHEN 0 THEN concat('sf-m', p_size, '::', p_partkey, '.1-2') WHEN 1 THEN concat('SF::', p_partkey) WHEN 2 THEN concat('m', p_size, ':', p_partkey) WHEN 3 THEN concat('m', p_size, '::', p_partkey, '::x') ELSE concat('m-1::a', p_partkey, '_b') END"


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 4) THEN split_part(r, '::', 1) END AS module_id, CASE WHEN p_size % 5 IN (0, 4) THEN split_part(r, '::', 2) END AS section_id FROM (SELECT p_partkey, p_size, {_REF} AS r FROM part)")
def corpus_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module and section of serialised references; null where a part is no id."""
    return table(spark, sf_dir, "part").select("p_partkey", G.corpus_ref(F.expr(_REF)).alias("r")).select("p_partkey", "r.module_id", "r.section_id")


_ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX")
_ROMAN = "CASE p_size % 20 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_ROMANS[1:] + _ROMANS[:1], 2) if k < 20) + " WHEN 0 THEN 'XX' ELSE 'I' END"
_LABEL = f"concat(CASE p_partkey % 2 WHEN 0 THEN 'ARTICLE ' ELSE 'CHAPTER ' END, CASE p_partkey % 3 WHEN 0 THEN {_ROMAN} ELSE concat(p_size % 20 + CASE p_size % 20 WHEN 0 THEN 20 ELSE 0 END) END, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ': ' ELSE ' ' END, CASE p_partkey % 5 WHEN 0 THEN '' ELSE p_brand END)"
_NODES = {"module_id": "concat('m', p_partkey % 7)", "label": _LABEL, "a": "p_partkey % 11", "b": "p_partkey", "first_section": "CASE WHEN p_partkey % 13 > 0 THEN concat(p_partkey, '.1') END"}
_ASKED = {"ref_id": "s_suppkey", "module_id": "concat('m', s_suppkey % 8)", "level": "CASE s_suppkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'chapter' ELSE 'title' END", "num": "s_nationkey % 22"}


@query(f"""WITH n AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _NODES.items())} FROM part), a AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _ASKED.items())} FROM supplier),
x AS (SELECT ref_id, first_section, row_number() OVER (PARTITION BY ref_id ORDER BY n.a DESC, n.b DESC) AS k FROM a JOIN n ON n.module_id = a.module_id AND first_section IS NOT NULL
  AND (regexp_matches(label, '^' || upper(level) || ' ' || num || '([: ]|$)') OR (num BETWEEN 1 AND 20 AND regexp_matches(label, '^' || upper(level) || ' ' || {list(_ROMANS)}[num] || '([: ]|$)'))))
SELECT a.ref_id, a.module_id, level, CAST(num AS VARCHAR) AS number, first_section AS section_id FROM a LEFT JOIN x ON x.ref_id = a.ref_id AND k = 1""")
def structural_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sections of the articles and chapters that references name."""
    nodes = table(spark, sf_dir, "part").select(*[F.expr(e).alias(c) for c, e in _NODES.items()]).withColumn("path", F.array("a", "b"))
    asked = table(spark, sf_dir, "supplier").select(*[F.expr(e).alias(c) for c, e in _ASKED.items()]).withColumn("number", F.col("num").cast("string")).drop("num")
    return G.structural_places(asked, nodes)
