"""Composable predicates, and lookups of references in what a corpus holds."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import references as R


def all_of(*predicates: Column) -> Column:
    """Whether all predicates hold; none given, they do."""
    return functools.reduce(operator.and_, predicates, F.lit(True))


def any_of(*predicates: Column) -> Column:
    """Whether one of the predicates holds; none given, it does."""
    return functools.reduce(operator.or_, predicates) if predicates else F.lit(True)


def still_there(saved: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Saved references whose sections the corpus still has."""
    return saved.join(sections.select(*keys), keys, "left_semi")


def section_definitions(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """The definitions that each section uses, each once. ``uses``: section_key, def_id; reading a use of an unknown definition fails."""
    known = definitions.withColumn("_known", F.lit(True))
    out = uses.select("section_key", "def_id").distinct().join(known, "def_id", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown definition "), F.col("def_id").cast("string"))).cast("string")
    return out.where(F.coalesce(F.col("_known").cast("string"), unknown) == "true").drop("_known")


def bill_sections(refs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Where the sections that bills name are: in the bill's module, or, as orphans, in the first other module that has one of their forms.

    ``refs``: ref_id, module_id, raw; ``anchors``: module_id, anchor_id. Returns ref_id, place (own, orphan or missing), found_module, anchor_id.
    """
    asked = refs.select("ref_id", "module_id", R.candidates(F.col("raw"), None, strip_zero=True).alias("candidates"))
    own = R.bind_first(asked, anchors)
    probe = own.where("anchor_id is null").select("ref_id", F.col("module_id").alias("own"), F.posexplode("candidates").alias("rank", "anchor_id"))
    best = F.min(F.struct(F.col("module_id").alias("m"), "rank", F.col("anchor_id").alias("a"))).alias("x")
    orphans = probe.join(anchors.distinct(), "anchor_id").where("module_id <> own").groupBy("ref_id").agg(best).select("ref_id", F.col("x.m").alias("other"), F.col("x.a").alias("other_anchor"))
    place = F.when(F.col("anchor_id").isNotNull(), "own").when(F.col("other").isNotNull(), "orphan").otherwise("missing")
    return own.join(orphans, "ref_id", "left").select("ref_id", place.alias("place"), F.when(F.col("anchor_id").isNotNull(), F.col("module_id")).otherwise(F.col("other")).alias("found_module"), F.coalesce("anchor_id", "other_anchor").alias("anchor_id"))


def with_diffs(outcomes: DataFrame, chunks: DataFrame, bills: DataFrame) -> DataFrame:
    """Bills (section_id, file_no) that show a diff for a section: its first outcome in the bill changes or adds it, the bill's diff has
    chunks of it, and the bill is more than a body.

    ``outcomes``: file_no, section_id, position, status and, to tell rows at one position apart, arrival; ``chunks``: file_no, section_id; ``bills``: file_no, parse_status.
    An outcome without a position is never the first; sections without an id are one, bills without a number none.
    """
    order = F.when(F.col("position").isNotNull(), F.struct("position", "arrival")) if "arrival" in outcomes.columns else F.col("position")
    first = outcomes.where("file_no is not null").groupBy("file_no", "section_id").agg(F.min_by("status", order).alias("status")).where("status in ('anchored', 'added_section')")
    held = chunks.select(F.col("file_no").alias("_file"), F.col("section_id").alias("_section")).distinct()
    shown = first.join(held, F.col("file_no").eqNullSafe(F.col("_file")) & F.col("section_id").eqNullSafe(F.col("_section")), "left_semi")
    return shown.join(bills.where("parse_status = 'body_only'").select("file_no"), "file_no", "left_anti").select("section_id", "file_no")
