"""Text expressions that several plans share, with the DuckDB form of each beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters shown on either side of a hit, and digits to which numbers are padded in sort keys.
MARGIN = 80
PAD = 40


def natural_key(id_: Column) -> Column:
    """A sort key in which runs of digits compare as numbers and punctuation sorts below digits.

    Digits are padded with zeros and each run is then cut to its last PAD digits.
    """
    ordered = F.translate(id_, "_-.", '!"#')
    padded = F.regexp_replace(ordered, "([0-9]+)", "0" * PAD + "$1")
    return F.regexp_replace(padded, "0*([0-9]{" + str(PAD) + "})", "$1")


def natural_key_sql(expr: str) -> str:
    padded = f"regexp_replace(translate({expr}, '_-.', '!\"#'), '([0-9]+)', '{'0' * PAD}\\1', 'g')"
    return f"regexp_replace({padded}, '0*([0-9]{{{PAD}}})', '\\1', 'g')"


def snippet(text: Column, needle: str, margin: int = MARGIN) -> Column:
    """The text around the first hit with white space collapsed, with dots where it was cut."""
    at = F.instr(F.lower(text), F.lit(needle.lower()))
    begin = F.greatest(at - margin, F.lit(1))
    end = F.least(at + len(needle) + margin, F.length(text) + 1)
    body = F.trim(F.regexp_replace(F.substr(text, begin, end - begin), "[ \t\n]+", " "))
    return F.concat(F.when(begin > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise(""))


def snippet_sql(text: str, needle: str, margin: int = MARGIN) -> str:
    at = f"strpos(lower({text}), '{needle.lower()}')"
    begin = f"greatest({at} - {margin}, 1)"
    end = f"least({at} + {len(needle) + margin}, length({text}) + 1)"
    body = f"trim(regexp_replace(substr({text}, {begin}, {end} - {begin}), '[ \\t\\n]+', ' ', 'g'))"
    return f"(CASE WHEN {begin} > 1 THEN '…' ELSE '' END || {body} || CASE WHEN {end} <= length({text}) THEN '…' ELSE '' END)"


def normal_term(term: Column) -> Column:
    """A term as it is looked up: trimmed, in lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(term, r"\s+", " ")))


def canonical_number(number: Column) -> Column:
    """A section number as it is compared: in lower case, without section signs and spaces."""
    return F.regexp_replace(F.lower(number), r"[§\s]", "")


def root_label(jurisdiction: Column) -> Column:
    """A jurisdiction's short name."""
    return F.regexp_replace(jurisdiction, "^City and County of ", "")
