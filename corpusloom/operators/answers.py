"""Verification of answers: claims about bills, the verdict and what to say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.extract import BILL, QUALIFIED

#: Verbs that claim an effect, and words that deny or report one.
VERB = r"(?i)\b(?:amends?|adds?|repeals?|changes?|modifies|modify|revises?|rewrites?|deletes?|strikes?|touches|affects?)\b"
GUARD = r"(?i)\b(?:claims?|asserts?|alleges?|suggests?|says|stated?|states|does\s+not|doesn'?t|not|never|incorrect\w*|erroneous\w*|wrong\w*|mistaken\w*|omits?|omitted|fails?\s+to)\b"
LONGEST_SENTENCE = 320
#: Verdicts, the first that applies wins, and their messages.
MESSAGES = (
    ("no_citations", "The answer cites nothing."),
    ("block_missing", "The answer lists no sources."),
    ("not_in_block", "The answer cites what its sources do not list."),
    ("not_fetched", "The answer cites what was not read."),
    ("claim_unsupported", "The answer says that a bill changes what it does not."),
)


def sentences(body: Column) -> Column:
    """Sentences of a text without its fenced code and its quoted lines, those that begin with ``>``."""
    plain = F.regexp_replace(body, r"(?s)```.*?(?:```|$)", "\n")
    plain = F.regexp_replace(plain, r"(?m)^[ \t]*>[^\n]*", "")
    return F.filter(F.split(plain, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def claims(body: Column) -> Column:
    """Claims that a bill changes a section: struct(file_no, module_id, section_id), each once.

    A sentence claims if it cites a bill and a section after it, is not longer than
    LONGEST_SENTENCE, has a verb of change and no guard between the two.
    """
    section = r"(?i)\[([a-z][a-z0-9-]*) *§ *([a-z0-9][a-z0-9._-]*)\]"
    between = r"(?s)\[Bill +#[0-9]{3,12}\](.*?)\[[a-z][a-z0-9-]* *§"
    claiming = F.filter(sentences(body), lambda s: (F.length(s) <= LONGEST_SENTENCE) & F.rlike(s, F.lit(between)) & F.rlike(F.regexp_extract(s, between, 1), F.lit(VERB)) & ~F.rlike(F.regexp_extract(s, between, 1), F.lit(GUARD)))

    def of(s: Column) -> Column:
        tail = F.regexp_extract(s, r"(?s)\[Bill +#[0-9]{3,12}\](.*)$", 1)
        cites = F.regexp_extract_all(tail, F.lit(QUALIFIED), F.lit(0))
        return F.transform(cites, lambda c: F.struct(F.regexp_extract(s, BILL, 1).alias("file_no"), F.lower(F.regexp_extract(c, section, 1)).alias("module_id"), F.lower(F.regexp_extract(c, section, 2)).alias("section_id")))

    return F.array_distinct(F.flatten(F.transform(claiming, of)))


def verdict(n_cited: Column, has_block: Column, n_unlisted: Column, n_unfetched: Column, n_unsupported: Column) -> Column:
    """The first failure of an answer, or valid."""
    tests = (n_cited == 0, ~has_block, n_unlisted > 0, n_unfetched > 0, n_unsupported > 0)
    out = None
    for (name, _), failed in zip(MESSAGES, tests, strict=True):
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise("valid")


def message(verdict: Column) -> Column:
    """What to say about a verdict; empty for a valid answer."""
    out = F.when(verdict == "valid", "")
    for name, text in MESSAGES:
        out = out.when(verdict == name, text)
    return out


def harvested(calls: DataFrame) -> DataFrame:
    """What a turn's calls fetched: turn_id, kind (bill or section), module_id, key, fetched.

    ``calls``: turn_id, path, ok. A bill counts as fetched from any path below it, a section from
    its own; a failed call leaves what it asked for as probed only. Each thing stands once.
    """
    bill = F.nullif(F.regexp_extract("path", r"^/?bills/([0-9]+)(?:/|$)", 1), F.lit(""))
    pattern = r"^/?modules/([^/]+)/sections/([^/]+)(?:/|$)"
    module, section = F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")), F.nullif(F.lower(F.regexp_extract("path", pattern, 2)), F.lit(""))
    asked = calls.select("turn_id", F.when(bill.isNotNull(), "bill").when(section.isNotNull(), "section").alias("kind"), module.alias("module_id"), F.coalesce(bill, section).alias("key"), "ok")
    return asked.where("kind is not null").groupBy("turn_id", "kind", "module_id", "key").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("fetched"))
