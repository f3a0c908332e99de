"""Binding of citations to anchors: the anchor index, the decision per kind, ranges, collision families and their gates.

References have ref_id, module_id (of the citing section), kind (internal, cross_module or another), target_module (of
a cross_module one), raw (the cited id), range_to (null if it is no range) and display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.staging import stage

#: A section id's ordinal suffix, and the container in front of an appendix section's number.
ORDINAL, APPENDIX = r"-[0-9]+[A-Za-z]?$", r"^(?:[Aa]rticle|[Cc]hapter)[0-9A-Za-z]+[Aa]ppendix[A-Za-z]+\.(.+)$"


def anchor_index(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """module_id, anchor_id: all section ids, and the anchors of the table of contents in lower case, each once."""
    return sections.select("module_id", F.col("section_id").alias("anchor_id")).union(toc.select("module_id", F.lower("anchor").alias("anchor_id"))).distinct()


def stem(id_: Column) -> Column:
    """An id without its ordinal suffix: 16.9-29A belongs to 16.9."""
    return F.regexp_replace(id_, ORDINAL, "")


def leaf(id_: Column) -> Column:
    """The number of an appendix section without its container; null for other ids."""
    return F.nullif(F.regexp_extract(id_, APPENDIX, 1), F.lit(""))


def collision_families(sections: DataFrame) -> DataFrame:
    """Members of families of ids that a bare reference could mean: module_id, family, section_id.

    A section belongs to its stem's family, an appendix section to its leaf's too. A family has several
    members, or one that is an appendix section.
    """
    inner = leaf(F.col("section_id"))
    keys = F.array_compact(F.array(stem(F.col("section_id")), stem(inner)))
    members = sections.select("module_id", "section_id", inner.isNotNull().alias("appendix"), F.explode(keys).alias("family"))
    kept = members.groupBy("module_id", "family").agg(F.count("*").alias("n"), F.max("appendix").alias("any")).where("n > 1 or `any`")
    return members.join(kept, ["module_id", "family"], "left_semi").select("module_id", "family", "section_id")


def bound(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``refs`` with what they bind to: new_kind, bound_module, anchor_id, bound_to and source_kind (of one that became vague).

    An internal reference binds in its own module, else in the only other module that has it, else it
    becomes vague. A cross-module one binds in its target module, stays as it is where that module
    is not in the build, else it becomes vague. Other kinds pass. The end of a bound range is the first of its
    forms that is an anchor, or else what was written.
    """
    internal, cross = F.col("kind") == "internal", F.col("kind") == "cross_module"
    index = _keyed(anchors)
    asked = refs.withColumn("_own", F.when(internal, F.col("module_id")).when(cross, F.col("target_module")))
    held = _met(asked, index, "raw", internal | cross, "_hits")
    modules = anchors.agg(F.collect_set("module_id").alias("_built"))
    held = held.crossJoin(F.broadcast(modules))
    own = _first(F.col("_hits"), F.col("raw"), lambda h: h["module_id"] == F.col("_own"))
    others = F.filter("_hits", lambda h: internal & (h["module_id"] != F.col("_own")))
    siblings = F.array_distinct(F.transform(others, lambda h: h["module_id"]))
    held = held.withColumns({"_anchor": own, "_sibling": F.when(own.isNull() & (F.size(siblings) == 1), F.get(siblings, F.lit(0)))})
    anchor = F.coalesce("_anchor", _first(F.col("_hits"), F.col("raw"), lambda h: h["module_id"] == F.col("_sibling")))
    # without a known module of its own a cross-module one stays as it is
    unbuilt = cross & ~F.coalesce(F.array_contains("_built", F.col("_own")), F.lit(False))
    held = held.withColumns({
        "anchor_id": anchor,
        "new_kind": F.when(~F.coalesce(internal | cross, F.lit(False)), F.col("kind")).when(anchor.isNotNull(), "section-ref").when(unbuilt, "cross_module").otherwise("vague"),
        "bound_module": F.when(internal | cross, F.when(F.col("_anchor").isNotNull(), F.col("_own")).otherwise(F.col("_sibling"))),
    }).drop("_hits", "_built", "_anchor", "_sibling", "_own")
    out = _met(held, index, "range_to", F.col("anchor_id").isNotNull(), "_ends")
    end = _first(F.col("_ends"), F.col("range_to"), lambda h: h["module_id"] == F.col("bound_module"))
    became = (F.col("new_kind") == "vague") & (F.col("kind") != "vague")
    return out.select(refs.columns + ["new_kind", "bound_module", "anchor_id"] + [F.when(F.col("anchor_id").isNotNull(), F.coalesce(end, "range_to")).alias("bound_to"), F.when(became, F.col("kind")).alias("source_kind")])


def _key(id_: Column) -> Column:
    """What the two forms of an id, with and without a final ``.0``, share; null for an empty one, which has no forms."""
    low = F.lower(id_)
    return F.when(id_ != "", F.when(low.endswith(".0"), F.left(low, F.length(low) - 2)).otherwise(low))


def _keyed(anchors: DataFrame) -> DataFrame:
    """Anchors by the keys of the ids that may mean them: _key, hits (anchor_id, module_id)."""
    id_ = F.col("anchor_id")
    keys = F.array_compact(F.array(id_, F.when(id_.endswith(".0"), F.left(id_, F.length(id_) - 2))))
    return anchors.select(F.explode(keys).alias("_key"), F.struct("anchor_id", "module_id").alias("hit")).groupBy("_key").agg(F.collect_set("hit").alias("hits"))


def _met(refs: DataFrame, index: DataFrame, id_col: str, asked: Column, name: str) -> DataFrame:
    """``refs`` with the anchors that an id may mean, in any module, as ``name``; those that do not ask are dealt out over all tasks."""
    key = F.when(asked, _key(F.col(id_col)))
    rows = refs.withColumn("_key", key).withColumns({"_spread": F.when(F.col("_key").isNull(), F.pmod(F.xxhash64("ref_id"), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")), "_key": F.coalesce("_key", F.lit(""))})
    known = index.select("_key", F.lit(0).cast("long").alias("_spread"), F.col("hits").alias(name))
    return rows.join(known, ["_key", "_spread"], "left").drop("_key", "_spread")


def _first(hits: Column, id_: Column, fits) -> Column:
    """Of the anchors that fit the id as it is written (in lower case), else its other form; null if none does."""
    mine = F.transform(F.filter(hits, fits), lambda h: h["anchor_id"])
    return F.when(F.array_contains(mine, F.lower(id_)), F.lower(id_)).otherwise(F.get(mine, F.lit(0)))


def vague_reasons(rows: DataFrame, families: DataFrame) -> DataFrame:
    """Of vague references of :func:`bound` how many were vague from the start, could mean several sections, or name no anchor: module_id, reason, n."""
    some = families.select("module_id", F.lower("family").alias("raw_key"), F.lit(True).alias("family")).distinct()
    vague = rows.where("new_kind = 'vague'").withColumn("raw_key", F.lower("raw")).join(some, ["module_id", "raw_key"], "left")
    reason = F.when(F.col("source_kind").isNull(), "external").when(F.col("family"), "collision_unresolvable").otherwise("no_anchor")
    return vague.groupBy("module_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def unresolved(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Bound references whose anchor no longer stands in a module of the build, nor any of its parents (ids cut at dots): ref_id, raw_text."""
    bound = rows.where("new_kind = 'section-ref'").select("ref_id", F.col("bound_module").alias("module_id"), F.col("anchor_id").alias("whole"))
    bound = stage(bound, "bound-references")
    # each anchor is looked for once, however many references are bound to it
    pairs = bound.select("module_id", "whole").distinct().join(anchors.select("module_id").distinct(), "module_id", "left_semi")
    parts = F.split("whole", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    probe = pairs.select("module_id", "whole", F.explode(parents).alias("anchor_id"))
    hit = probe.join(anchors, ["module_id", "anchor_id"], "left_semi").select("module_id", "whole").distinct()
    lost = pairs.join(hit, ["module_id", "whole"], "left_anti")
    return bound.join(lost, ["module_id", "whole"], "left_semi").select("ref_id", F.concat_ws("/", "module_id", "whole").alias("raw_text"))
