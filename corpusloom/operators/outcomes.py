"""Aggregations and rules over bills' section outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that a reader can see, and the one that means another module took it.
RENDERABLE = ("anchored", "added_section", "no_changes")
ABSORBED = "absorbed_external"
#: Bill states in workflow order; the first five are pending, the last four terminal.
PENDING = ("filed", "committee", "engrossed", "floor", "enrolled")
TERMINAL = ("enacted", "vetoed", "withdrawn", "failed")
#: Status texts, the first that matches wins.
STATUS_RULES = (
    (r"awaiting\s+(the\s+)?mayor", "enrolled"),
    (r"vetoed?|veto\s+sustained", "vetoed"),
    (r"withdrawn|rescinded", "withdrawn"),
    (r"failed|defeated|tabled", "failed"),
    (r"signed\s+by\s+(the\s+)?mayor|mayor['’]?s?\s+signature|effective|enacted|approved\s+by\s+(the\s+)?mayor", "enacted"),
    (r"enrolled", "enrolled"),
    (r"board\s+(vote|reading)|floor|second\s+reading", "floor"),
    (r"engross[A-Za-z]*|passed\s+committee", "engrossed"),
    (r"committee|hearing|continued", "committee"),
    (r"filed|introduced|pending", "filed"),
)


def bill_status(text: Column) -> Column:
    """A bill's state from its free status text; ``filed`` if nothing matches or it is null."""
    out = None
    for pattern, status in STATUS_RULES:
        hit = F.rlike(text, F.lit(rf"(?i)(?<![0-9A-Za-z_])({pattern})(?![0-9A-Za-z_])"))
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out.otherwise("filed")


def parse_status(n: Column, renderable: Column, absorbed: Column, structural: Column) -> Column:
    """A bill's parse status from counts of its outcomes."""
    return (
        F.when(structural, "structural_change").when(n == 0, "body_only").when(absorbed == n, "absorbed_external").when(renderable == n, "ok").when(renderable > 0, "partial").otherwise("manual_review")
    )


def outcome_summary(outcomes: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Per bill: outcomes, renderable and absorbed ones, and the parse status; combined before the shuffle."""
    s = F.col(status)
    counts = outcomes.groupBy(key).agg(F.count("*").alias("n"), F.count_if(s.isin(*RENDERABLE)).alias("n_renderable"), F.count_if(s == ABSORBED).alias("n_absorbed"))
    return counts.withColumn("parse_status", parse_status(F.col("n"), F.col("n_renderable"), F.col("n_absorbed"), F.lit(False)))


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text, "[ \t\n]+"), lambda w: w != ""))


def change_kind(status: Column) -> Column:
    return F.when(status == "anchored", "revised").when(status == "added_section", "added").when(status == "no_changes", "referenced_no_change").otherwise("unclear")


def in_session(introduced: Column, status: Column, start: str, end: str) -> Column:
    """Whether a bill belongs to a session: without a date, dated inside it, or carried over while pending."""
    return introduced.isNull() | introduced.between(F.lit(start), F.lit(end)) | ((introduced < F.lit(start)) & status.isin(*PENDING))
