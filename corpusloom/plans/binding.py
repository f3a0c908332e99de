"""Queries on binding, over references that are made from line items and sections that are made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import binding as B
from corpusloom.plans.registry import Registry
from corpusloom.sources.bridge import table

_registry = Registry()
query, QUERIES, SQL = _registry.query, _registry.queries, _registry.sql

_ID = """CASE p_partkey % 9 WHEN 0 THEN concat(p_partkey div 9, '.1-', p_size) WHEN 1 THEN concat(p_partkey div 9, '.1') WHEN 2 THEN concat(p_partkey div 9, '.0') WHEN 3 THEN concat('article', p_size, 'appendixb.', p_partkey div 9)
ELSE concat(p_partkey div 9, '.', p_partkey % 9) END"""
_ID_SQL = _ID.replace("p_partkey div 9", "p_partkey // 9")
#: Sections, further anchors and references with DuckDB, as the functions below make them.
_BASE = f"""s AS (SELECT concat('m', p_size % 5) AS module_id, {_ID_SQL} AS section_id FROM part),
toc AS (SELECT concat('m', p_size % 5) AS module_id, concat('T', p_partkey, '.1') AS anchor FROM part WHERE p_partkey % 4 = 0),
anchors AS (SELECT module_id, section_id AS anchor_id FROM s UNION SELECT module_id, lower(anchor) FROM toc),
r AS (SELECT DISTINCT concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey, l_returnflag, CAST(l_quantity AS INTEGER)) AS ref_id, concat('m', l_suppkey % 5) AS module_id, CASE l_returnflag WHEN 'R' THEN 'cross_module' WHEN 'A' THEN 'internal' ELSE CASE l_linenumber % 2 WHEN 0 THEN 'vague' ELSE 'internal' END END AS kind,
  concat('m', l_partkey % 7) AS target_module, CASE l_linenumber % 4 WHEN 0 THEN concat('T', l_partkey, '.1') WHEN 1 THEN concat(l_partkey // 9, '.1') WHEN 2 THEN CAST(l_partkey // 9 AS VARCHAR) ELSE concat(l_partkey // 9, '.', l_partkey % 9) END AS raw,
  CASE WHEN l_quantity < 10 THEN concat(l_partkey // 9, '.0') WHEN l_quantity < 20 THEN concat('X', l_partkey) END AS range_to FROM lineitem)"""
_FAMILIES = r"""k AS (SELECT module_id, section_id, nullif(regexp_extract(section_id, '^(?:[Aa]rticle|[Cc]hapter)[0-9A-Za-z]+[Aa]ppendix[A-Za-z]+\.(.+)$', 1), '') AS leaf FROM s),
e AS (SELECT module_id, section_id, leaf IS NOT NULL AS appendix, regexp_replace(section_id, '-[0-9]+[A-Za-z]?$', '') AS family FROM k UNION ALL SELECT module_id, section_id, true, regexp_replace(leaf, '-[0-9]+[A-Za-z]?$', '') FROM k WHERE leaf IS NOT NULL),
families AS (SELECT module_id, family, section_id FROM (SELECT *, count(*) OVER (PARTITION BY module_id, family) AS n, max(appendix) OVER (PARTITION BY module_id, family) AS a FROM e) WHERE n > 1 OR a)"""
_FORMS = "[lower({c}), CASE WHEN ends_with(lower({c}), '.0') THEN left(lower({c}), length({c}) - 2) ELSE lower({c}) || '.0' END]"
_BOUND = f"""c AS (SELECT *, CASE kind WHEN 'internal' THEN module_id ELSE target_module END AS own, unnest({_FORMS.format(c="raw")}) AS form, generate_subscripts({_FORMS.format(c="raw")}, 1) AS rank FROM r WHERE kind IN ('internal', 'cross_module')),
o AS (SELECT ref_id, min(own) AS bound_module, arg_min(form, rank) AS anchor_id FROM c JOIN anchors a ON a.module_id = own AND a.anchor_id = form GROUP BY ref_id),
g AS (SELECT ref_id, a.module_id, arg_min(form, rank) AS anchor_id FROM c JOIN anchors a ON a.anchor_id = form AND a.module_id <> own WHERE kind = 'internal' AND ref_id NOT IN (SELECT ref_id FROM o) GROUP BY 1, 2),
sib AS (SELECT ref_id, min(module_id) AS bound_module, min(anchor_id) AS anchor_id FROM g GROUP BY 1 HAVING count(*) = 1),
hit AS (SELECT * FROM o UNION ALL SELECT * FROM sib),
told AS (SELECT r.*, CASE WHEN hit.anchor_id IS NOT NULL THEN 'section-ref' WHEN kind = 'cross_module' AND target_module NOT IN (SELECT module_id FROM anchors) THEN kind WHEN kind = 'vague' THEN kind ELSE 'vague' END AS new_kind, bound_module, anchor_id FROM r LEFT JOIN hit USING (ref_id)),
ends AS (SELECT ref_id, arg_min(form, rank) AS end_anchor FROM (SELECT ref_id, bound_module, unnest({_FORMS.format(c="range_to")}) AS form, generate_subscripts({_FORMS.format(c="range_to")}, 1) AS rank FROM told WHERE anchor_id IS NOT NULL AND range_to IS NOT NULL) x JOIN anchors a ON a.module_id = bound_module AND a.anchor_id = form GROUP BY 1),
b AS (SELECT told.*, CASE WHEN anchor_id IS NOT NULL THEN coalesce(end_anchor, range_to) END AS bound_to, CASE WHEN new_kind = 'vague' AND kind <> 'vague' THEN kind END AS source_kind FROM told LEFT JOIN ends USING (ref_id))"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr("concat('m', p_size % 5)").alias("module_id"), F.expr(_ID).alias("section_id"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.expr("concat('m', p_size % 5)").alias("module_id"), F.expr("concat('T', p_partkey, '.1')").alias("anchor"))
    return B.anchor_index(sections(spark, sf_dir), toc)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "CASE l_returnflag WHEN 'R' THEN 'cross_module' WHEN 'A' THEN 'internal' ELSE CASE l_linenumber % 2 WHEN 0 THEN 'vague' ELSE 'internal' END END"
    raw = "CASE l_linenumber % 4 WHEN 0 THEN concat('T', l_partkey, '.1') WHEN 1 THEN concat(l_partkey div 9, '.1') WHEN 2 THEN string(l_partkey div 9) ELSE concat(l_partkey div 9, '.', l_partkey % 9) END"
    to = "CASE WHEN l_quantity < 10 THEN concat(l_partkey div 9, '.0') WHEN l_quantity < 20 THEN concat('X', l_partkey) END"
    named = {"ref_id": "concat(l_orderkey, '.', l_linenumber, '.', l_partkey, '.', l_suppkey, l_returnflag, int(l_quantity))", "module_id": "concat('m', l_suppkey % 5)", "kind": kind, "target_module": "concat('m', l_partkey % 7)", "raw": raw, "range_to": to}
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in named.items()]).distinct()


@query(f"WITH {_BASE} SELECT module_id, anchor_id FROM anchors")
def anchor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section ids and further anchors of each module."""
    return anchors(spark, sf_dir)


@query(f"WITH {_BASE}, {_FAMILIES} SELECT module_id, family, section_id FROM families")
def collision_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that a bare reference could mean, by their ids without ordinals and containers."""
    return B.collision_families(sections(spark, sf_dir))


@query(f"WITH {_BASE}, {_BOUND} SELECT ref_id, kind, raw, new_kind, bound_module, anchor_id, bound_to, source_kind FROM b")
def bound_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every reference binds to, by its kind, with the ends of ranges."""
    return B.bound(refs(spark, sf_dir), anchors(spark, sf_dir)).drop("module_id", "target_module", "range_to")


@query(f"""WITH {_BASE}, {_BOUND}, {_FAMILIES}, f AS (SELECT DISTINCT module_id, lower(family) AS raw FROM families)
SELECT b.module_id, CASE WHEN source_kind IS NULL THEN 'external' WHEN f.raw IS NOT NULL THEN 'collision_unresolvable' ELSE 'no_anchor' END AS reason, count(*) AS n FROM b LEFT JOIN f ON f.module_id = b.module_id AND f.raw = lower(b.raw) WHERE new_kind = 'vague' GROUP BY 1, 2""")
def vague_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why references are vague, by the families of the ids in their module."""
    return B.vague_reasons(B.bound(refs(spark, sf_dir), anchors(spark, sf_dir)), B.collision_families(sections(spark, sf_dir)))


@query(f"""WITH {_BASE}, {_BOUND}, later AS (SELECT * FROM anchors WHERE length(anchor_id) % 3 <> 0), x AS (SELECT * FROM b WHERE new_kind = 'section-ref' AND bound_module IN (SELECT module_id FROM later)),
p AS (SELECT ref_id, bound_module, unnest([array_to_string(string_split(anchor_id, '.')[1:n], '.') FOR n IN range(1, len(string_split(anchor_id, '.')) + 1)]) AS parent FROM x)
SELECT ref_id, bound_module || '/' || anchor_id AS raw_text FROM x WHERE ref_id NOT IN (SELECT ref_id FROM p JOIN later l ON l.module_id = bound_module AND l.anchor_id = parent)""")
def gate_lost_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound references whose anchors, and their parents, a later build no longer has."""
    a = anchors(spark, sf_dir)
    return B.unresolved(B.bound(refs(spark, sf_dir), a), a.where("length(anchor_id) % 3 <> 0"))
