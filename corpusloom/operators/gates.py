"""Invariants of a corpus as plans: each gate turns a rule into a table of the rows that break it.

A gate names the tables that it reads; :func:`violations` runs those whose tables are there. A rule holds if its
plan has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import outcomes as O

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Gate:
    name: str
    reads: tuple[str, ...]
    plan: Callable[..., DataFrame]


GATES: list[Gate] = []


def gate(name: str, *reads: str):
    def keep(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        GATES.append(Gate(name, reads, plan))
        return plan

    return keep


def violations(tables: Tables) -> DataFrame | None:
    """Rows that break a gate: gate, subject, detail; None if no gate's tables are there."""
    out = None
    for g in GATES:
        if all(t in tables for t in g.reads):
            rows = g.plan(*(tables[t] for t in g.reads)).select(F.lit(g.name).alias("gate"), F.col("subject").cast("string"), F.col("detail").cast("string"))
            out = rows if out is None else out.unionByName(rows)
    return out


def _told(rows: DataFrame, subject: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(subject.alias("subject"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _repeated(rows: DataFrame, *keys: Column) -> DataFrame:
    named = rows.select(*(k.alias(f"k{n}") for n, k in enumerate(keys)))
    twice = named.groupBy(*named.columns).agg(F.count("*").alias("n")).where("n > 1")
    return _told(twice, F.concat_ws("/", *named.columns), F.col("n"))


@gate("body_is_text", "texts", "segments")
def body_is_text(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments (doc_id, seg_index, raw), joined, are the text (doc_id, text)."""
    flat = segments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "raw"))), lambda x: x["raw"]), "").alias("flat"))
    return _told(texts.join(flat, "doc_id", "left").where("coalesce(flat, '') <> coalesce(text, '')"), F.col("doc_id"))


@gate("citation_index", "segments", "cited")
def citation_index(segments: DataFrame, cited: DataFrame) -> DataFrame:
    """A citation's segment (kind, ref, raw) names one of its section's (doc_id, citation_index, display), with its words."""
    own = segments.where("kind = 'citation'").select("doc_id", F.col("ref").cast("int").alias("citation_index"), "raw")
    met = own.join(cited, ["doc_id", "citation_index"], "left").where("display is null or display <> raw")
    return _told(met, F.concat_ws("#", "doc_id", "citation_index"), F.col("raw"))


@gate("range_start", "targets")
def range_start(targets: DataFrame) -> DataFrame:
    """A range begins with the section that its target (ref_id, section_id, range_from) names."""
    return _told(targets.where("range_from is not null and not range_from <=> section_id"), F.col("ref_id"), F.col("range_from"))


@gate("definition_anchor", "definitions")
def definition_anchor(definitions: DataFrame) -> DataFrame:
    """A definition's anchor does not end before it starts."""
    return _told(definitions.where("begin > end"), F.concat_ws("/", "module_id", "def_id"))


@gate("definition_ids", "definitions")
def definition_ids(definitions: DataFrame) -> DataFrame:
    """A module has a definition's id once."""
    return _repeated(definitions, F.col("module_id"), F.col("def_id"))


@gate("parse_status", "bills", "outcomes")
def parse_status(bills: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A bill's parse_status is the one that its outcomes, and whether it is structural, give."""
    held = bills.select("file_no", "parse_status", "structural").join(O.outcome_summary(outcomes, "file_no").drop("parse_status"), "file_no", "left").fillna(0, ["n", "n_renderable", "n_absorbed"])
    derived = O.parse_status(F.col("n"), F.col("n_renderable"), F.col("n_absorbed"), F.coalesce("structural", F.lit(False)))
    return _told(held.withColumn("derived", derived).where("not parse_status <=> derived"), F.col("file_no"), F.concat_ws(" is not ", "parse_status", "derived"))


#: Outcomes that change a section.
CHANGED = ("anchored", "added_section")


@gate("has_chunks", "outcomes", "chunks")
def has_chunks(outcomes: DataFrame, chunks: DataFrame) -> DataFrame:
    """A bill that changes or adds a section has a diff."""
    shown = outcomes.where(F.col("status").isin(*CHANGED)).select("file_no").distinct()
    return _told(shown.join(chunks.select("file_no").distinct(), "file_no", "left_anti"), F.col("file_no"))


@gate("new_bodies", "outcomes", "bodies")
def new_bodies(outcomes: DataFrame, bodies: DataFrame) -> DataFrame:
    """The sections with a new body are those that a bill changes or adds."""
    a = outcomes.where(F.col("status").isin(*CHANGED)).select("file_no", "section_id").distinct()
    b = bodies.select("file_no", "section_id").distinct()
    subject = F.concat_ws("/", "file_no", "section_id")
    return _told(a.exceptAll(b), subject, F.lit("no body")).unionByName(_told(b.exceptAll(a), subject, F.lit("no outcome")))


@gate("structural_scope", "bills")
def structural_scope(bills: DataFrame) -> DataFrame:
    """A bill has a structural scope if, and only if, its status says so."""
    return _told(bills.where("(structural_change_scope is not null) <> (coalesce(parse_status, '') = 'structural_change')"), F.col("file_no"), F.col("structural_change_scope"))


@gate("module_ids", "modules")
def module_ids(modules: DataFrame) -> DataFrame:
    """Modules have ids of their own, and titles of their own whatever their case."""
    return _repeated(modules, F.col("id")).unionByName(_repeated(modules, F.lower("code_title")))


@gate("jurisdiction", "jurisdictions")
def jurisdiction(jurisdictions: DataFrame) -> DataFrame:
    """A jurisdiction with bills has a session, one that starts before it ends; one whose source is of anchors has an anchor for every module."""
    rules = {
        "bills without a session": "bill_source is not null and (session_start is null or session_end is null)", "a session that ends before it starts": "session_start >= session_end",
        "a module without an anchor": "source_format = 'amlegal-html' and exists(jd_anchors, a -> a is null)",
    }
    broken = F.explode(F.array_compact(F.array(*(F.when(F.expr(r), F.lit(name)) for name, r in rules.items()))))
    return _told(jurisdictions.select("jurisdiction", broken.alias("rule")), F.col("jurisdiction"), F.col("rule"))


@gate("history_items", "history")
def history_items(history: DataFrame) -> DataFrame:
    """Items of a file of ordinances or resolutions are of its kind, and their ids begin with their year."""
    wrong = history.where("not instrument_kind <=> file_kind or not startswith(id, concat(year, '-'))")
    return _told(wrong, F.col("id"), F.col("instrument_kind"))


@gate("source_path", "sources")
def source_path(sources: DataFrame) -> DataFrame:
    """A source lies under its manifest: its path is relative and never goes up."""
    return _told(sources.where(F.col("path").isNull() | F.col("path").rlike(r"^(?:/|[A-Za-z]:|\\)") | F.exists(F.split("path", r"[/\\]"), lambda p: p == "..")), F.col("jurisdiction"), F.col("path"))
