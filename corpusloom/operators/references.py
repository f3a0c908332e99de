"""Joins over citations, definitions and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reverse_graph(citations: DataFrame) -> DataFrame:
    """Each cited node with the nodes that cite it, one row per pair; a range cites its two ends.

    ``citations``: citing_id, cited_id and optionally range_to.
    """
    ends = F.array("cited_id", "range_to") if "range_to" in citations.columns else F.array("cited_id")
    return citations.select("citing_id", F.explode(ends).alias("cited_id")).where("cited_id is not null").distinct()


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order`` (first wins, nulls come last). Rows that ``order`` leaves open come by ``arrival``, if they have it; it is not given back."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order), *(c for c in rows.columns if c == "arrival"))
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place", "arrival")


def candidates(ref: Column, prefix: str | None, extra: tuple[str, ...] = (), strip_zero: bool = False, override: str | None = None) -> Column:
    """Anchor candidates of a reference, best first: per form the prefixed, the bare and the extra-prefixed one.

    Forms are the reference in lower case and, with ``strip_zero``, the same without or with a
    final ``.0``. A pattern's first group is a last candidate.
    """
    base = F.lower(ref)
    forms = [base]
    if strip_zero:
        forms.append(F.when(F.endswith(base, F.lit(".0")), F.left(base, F.length(base) - 2)).otherwise(F.concat(base, F.lit(".0"))))
    out = []
    for form in forms:
        out += [F.concat(F.lit(prefix), form)] if prefix else []
        out += [form, *(F.concat(F.lit(x), form) for x in extra)]
    if override:
        out.append(F.nullif(F.lower(F.regexp_extract(base, f"(?i){override}", 1)), F.lit("")))
    return F.when(ref != "", F.array_distinct(F.array_compact(F.array(*out)))).otherwise(F.array())


def bind_first(refs: DataFrame, anchors: DataFrame, key: str = "ref_id") -> DataFrame:
    """Bind each reference (key, module_id, candidates) to the first candidate that is an anchor of its module.

    ``anchors``: module_id, anchor_id. References without one keep a null anchor_id.
    """
    probe = refs.select(key, "module_id", F.posexplode("candidates").alias("rank", "anchor_id"))
    hits = probe.join(anchors.distinct(), ["module_id", "anchor_id"], "left_semi").groupBy(key).agg(F.min_by("anchor_id", "rank").alias("anchor_id"))
    return refs.join(hits, key, "left")


def bind_sibling(refs: DataFrame, anchors: DataFrame, key: str = "ref_id") -> DataFrame:
    """Bind each reference to another module, if exactly one other module has one of its candidates."""
    probe = refs.select(key, F.col("module_id").alias("own"), F.posexplode("candidates").alias("rank", "anchor_id"))
    hits = probe.join(anchors.distinct(), "anchor_id").where("module_id <> own").groupBy(key, "module_id").agg(F.min_by("anchor_id", "rank").alias("anchor_id"))
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.max("module_id").alias("module_id"), F.max("anchor_id").alias("anchor_id")).where("n = 1").drop("n")


def in_scope(kind: Column, prefix: Column, hierarchy: Column) -> Column:
    """Whether a definition's scope holds at a place: module always, cross_module never, hierarchy by prefix."""
    return F.when(kind == "module", True).when(kind == "hierarchy", F.slice(hierarchy, 1, F.greatest(F.size(prefix), F.lit(1))) == prefix).otherwise(False)


def prefixes(hierarchy: Column) -> Column:
    """All prefixes of a hierarchy, from its first level to the whole."""
    whole = F.when(F.size(hierarchy) > 0, F.sequence(F.lit(1), F.size(hierarchy))).otherwise(F.array().cast("array<int>"))
    return F.transform(whole, lambda n: F.slice(hierarchy, 1, n))


def resolve_definitions(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """The definition that holds at each occurrence, and how many others were in scope.

    ``occurrences``: occ_id, term, hierarchy; ``definitions``: def_id, term, scope_kind,
    scope_prefix, defined_in. A hierarchy scope beats a module scope, a longer prefix a shorter
    one, then the smaller defined_in. Occurrences without a definition in scope are left out.
    The prefix test is an equality join: an occurrence meets a definition on one of its prefixes,
    or on the empty one for a whole module.
    """
    empty = F.array().cast("array<string>")
    places = occurrences.select("occ_id", "term", F.explode(F.concat(F.array(empty), prefixes(F.col("hierarchy")))).alias("scope"))
    scoped = definitions.where(F.col("scope_kind").isin("module", "hierarchy")).withColumn("scope", F.when(F.col("scope_kind") == "module", empty).otherwise(F.col("scope_prefix")))
    # the definitions of one scope are counted first, so that an occurrence meets one row per scope, however many define its term
    order = F.struct(F.when(F.col("scope_kind") == "hierarchy", 0).otherwise(1).alias("rank"), (-F.size("scope")).alias("depth"), "defined_in", "def_id")
    firsts = scoped.where("scope_kind = 'module' or size(scope) > 0").groupBy("term", "scope").agg(F.min(order).alias("o"), F.count("*").alias("n"))
    found = places.join(firsts, ["term", "scope"])
    kind = F.when(F.col("o.rank") == 0, "hierarchy").otherwise("module")
    return found.groupBy("occ_id", "term").agg(F.min("o").alias("o"), (F.sum("n") - 1).alias("n_dropped")).select("occ_id", "term", "o.def_id", kind.alias("scope_kind"), "n_dropped")


def disambiguate(citing: DataFrame, family: DataFrame) -> DataFrame:
    """Pick a member of a collision family by the longest hierarchy prefix that it shares as its whole.

    ``citing``: cite_id, family_key, hierarchy; ``family``: family_key, member_id, member_hierarchy.
    At the greatest depth there must be one member, else the reference is ambiguous (null).
    Members of one place are counted first, so a reference meets one row per depth.
    """
    members = family.where("size(member_hierarchy) > 0").groupBy("family_key", F.col("member_hierarchy").alias("scope")).agg(F.count("*").alias("n"), F.max("member_id").alias("member_id"))
    places = citing.select("cite_id", "family_key", F.explode(prefixes(F.col("hierarchy"))).alias("scope"))
    deepest = places.join(members, ["family_key", "scope"]).groupBy("cite_id").agg(F.max_by(F.struct("n", "member_id"), F.size("scope")).alias("top"))
    picked = deepest.where("top.n = 1").select("cite_id", "top.member_id")
    return citing.select("cite_id").join(picked, "cite_id", "left")


def spans_in_ranges(spans: DataFrame, ranges: DataFrame, width: int = 4096) -> DataFrame:
    """Range join: each span with the first range that holds its start.

    ``spans``: doc, span_id, at; ``ranges``: doc, range_id, begin, end (half open). Both sides meet
    on blocks of ``width`` characters, so a document's spans never meet all of its ranges.
    """
    r = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))))
    s = spans.withColumn("block", F.floor(F.col("at") / width))
    met = s.join(r, ["doc", "block"]).where((F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")))
    return met.groupBy("doc", "span_id").agg(F.min_by("range_id", F.struct("begin", "range_id")).alias("range_id"))
