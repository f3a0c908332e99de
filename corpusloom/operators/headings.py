"""Headings, hierarchy and anchors of a code's boxes, as expressions and windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.html import section_id

#: Acronyms that keep their letters, and words that stay small inside a title.
ACRONYMS = ("CEQA", "NEPA", "DNA", "HIV", "AIDS", "SFMTA", "BART", "CCSF", "EIR", "EPA", "OSHA", "ADA", "LGBT", "LGBTQ", "MOU", "U.S.")
SMALL = ("a", "an", "and", "at", "by", "for", "in", "of", "or", "the", "to", "with")
#: Fixed value: how a heading names its section.
HEADING = r"(?i)SEC(?:TION)?\.?\s+((?:[0-9A-Za-z*-]|\.(?=[0-9A-Za-z*-]))+(?:\s+art\s+[0-9.A-Za-z]+)?)"


def hierarchy_marker(label: Column) -> Column:
    """struct(id, title) of an article's or chapter's label, null if it has no id.

    A colon parts id and title; without one the id is the leading token, less a capitalised word
    that hangs on it by a dot or a hyphen, and stars are dropped.
    """
    rest = F.trim(F.regexp_replace(label, r"(?i)^\s*(?:Article|Chapter)\s+", ""))
    bare = lambda x: F.trim(F.regexp_replace(x, r"\*+$", ""))
    by_colon = bare(F.trim(F.regexp_extract(rest, r"^([^:]*):", 1)))
    token = F.regexp_extract(rest, r"^([A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*)", 1)
    hangs = r"^(.+?)[.\-]([A-Z][a-z].*)$"
    word = F.regexp_extract(token, hangs, 2)
    short = F.when(word != "", F.regexp_extract(token, hangs, 1)).otherwise(token)
    tail = F.trim(F.substr(rest, F.length(token) + 1))
    title = F.trim(F.when(word != "", F.concat_ws(" ", word, F.nullif(tail, F.lit("")))).otherwise(tail))
    with_colon = F.when(by_colon != "", F.struct(by_colon.alias("id"), F.trim(F.regexp_extract(rest, r"^[^:]*:(.*)$", 1)).alias("title")))
    without = F.when(token != "", F.struct(bare(short).alias("id"), F.trim(F.regexp_replace(title, r"^\*+\s*", "")).alias("title")))
    return F.when(label.rlike(r"(?i)^\s*(?:Article|Chapter)\s+\S"), F.coalesce(with_colon, without))


def carried(boxes: DataFrame, module: str = "module_id", order: str = "pos") -> DataFrame:
    """Boxes with the division, chapter and article that hold at each: a marker clears what lies below it.

    ``boxes`` has level (division, chapter, article or null) and marker (its id). A level's group
    is numbered by a running sum of the markers that reset it; its value is carried inside that.
    """
    w = Window.partitionBy(module).orderBy(order)
    level = F.col("level")
    resets = {"division": (), "chapter": ("division",), "article": ("division", "chapter")}
    out = boxes
    for name, above in resets.items():
        out = out.withColumn(f"_{name}", F.sum(level.isin(*above).cast("int") if above else F.lit(0)).over(w))
    for name in resets:
        inner = Window.partitionBy(module, f"_{name}").orderBy(order)
        out = out.withColumn(name, F.last(F.when(level == name, F.col("marker")), ignorenulls=True).over(inner))
    return out.drop(*(f"_{n}" for n in resets))


def heading_number(heading: Column) -> Column:
    return F.nullif(F.regexp_extract(heading, HEADING, 1), F.lit(""))


def anchor_title(title: Column) -> Column:
    """An anchor's title without an editor's note number."""
    return F.regexp_replace(title, r"(?i)\s+Note\s*[0-9]*\s*\*?$", "")


def chosen_id(inner: Column, shared: Column, anchor: Column, name: Column, heading: Column) -> Column:
    """A section's id: the first of its sources that is not empty; a tombstone without an anchor gets -orig."""
    sources = [F.nullif(F.trim(c), F.lit("")) for c in (inner, F.when(shared, heading_number(heading)), anchor_title(anchor), name, heading_number(heading))]
    own = section_id(F.coalesce(*sources))
    dead = heading.rlike(r"(?i)\b(?:redesignated|repealed|reserved)\b") & F.nullif(F.trim(name), F.lit("")).isNull()
    return F.when(dead, F.concat(own, F.lit("-orig"))).otherwise(own)


def editorial_status(by_class: Column, heading: Column, body: Column) -> Column:
    """A status that the box's class calls inactive, refined by heading and body."""
    has = lambda c, w: c.rlike(rf"(?i)\b{w}\b")
    refined = F.when(has(heading, "repealed"), "repealed").when(has(heading, "redesignated") | has(body, "redesignated"), "redesignated").when(has(heading, "reserved") | has(body, "reserved"), "reserved").otherwise(by_class)
    return F.when(by_class == "active", by_class).otherwise(refined)


def tombstone_text(status: Column, text: Column) -> Column:
    """The text of an inactive section without one."""
    name = F.concat(F.lit("["), F.initcap(status), F.lit(".]"))
    return F.when((status != "active") & (F.trim(F.coalesce(text, F.lit(""))) == ""), name).otherwise(text)


def section_title(heading: Column, label: Column) -> Column:
    """A heading without its number and final dot."""
    numbered = F.regexp_replace(heading, rf"^\s*{HEADING}\.?\s*", "")
    own = F.when(F.startswith(heading, F.concat(label, F.lit(" "))), F.substr(heading, F.length(label) + 2)).otherwise(numbered)
    return F.regexp_replace(F.trim(own), r"\.$", "")


#: Fixed value: a word of a title, with dots inside.
_WORD = re.compile(r"[^\W\d_](?:(?:[^\W\d_]|\.)*[^\W\d_])?\.?")
_KNOWN = {a.upper(): a for a in ACRONYMS}


def title_case(raw: str) -> str:
    """Words that are all capitals in title case; acronyms and mixed words as they are, small words small inside."""
    spans = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for k, (a, b) in enumerate(spans):
        word = raw[a:b]
        if word.upper() in _KNOWN:
            word = _KNOWN[word.upper()]
        elif word == word.upper():
            low = word.lower()
            word = low if low in SMALL and 0 < k < len(spans) - 1 else low[0].upper() + low[1:]
        out += [raw[at:a], word]
        at = b
    return "".join(out) + raw[at:]


def module_slices(anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where each module lies in an export: from its anchor to the next module's. ``anchors``: doc, name, offset; ``wanted``: name, module_id.

    A module whose anchor is missing or stands more than once has no slice and a reason.
    """
    found = wanted.join(anchors, "name", "left").withColumn("n", F.count("offset").over(Window.partitionBy("module_id")))
    end = F.lead("offset").over(Window.partitionBy("doc").orderBy("offset"))
    good = found.where("n = 1").select("module_id", "doc", F.col("offset").alias("begin"), end.alias("end"), F.lit(None).cast("string").alias("reason"))
    bad = found.where("n <> 1").select("module_id", F.lit(None).cast(anchors.schema["doc"].dataType).alias("doc"), F.lit(None).cast(anchors.schema["offset"].dataType).alias("begin"), F.lit(None).cast(anchors.schema["offset"].dataType).alias("end"), F.when(F.col("n") == 0, "missing").otherwise("repeated").alias("reason")).distinct()
    return good.union(bad)


def redirects(sections: DataFrame, renamed: DataFrame) -> DataFrame:
    """Redirects to ids that were qualified: rewritten where the old id has exactly one new one. ``renamed``: module_id, old_id, new_id."""
    one = renamed.distinct().groupBy("module_id", "old_id").agg(F.count("*").alias("n"), F.max("new_id").alias("new_id")).where("n = 1")
    joined = sections.join(one.select("module_id", F.col("old_id").alias("redirect_to"), "new_id"), ["module_id", "redirect_to"], "left")
    return joined.withColumn("redirect_to", F.coalesce("new_id", "redirect_to")).drop("new_id")


def link_edges(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges between codes: links (page, link) joined to the anchors (anchor, module_id) that they name; unknown ones have a null target."""
    named = links.withColumn("anchor", F.nullif(F.regexp_extract("link", r"#(?:JD_)?(.+)$", 1), F.lit("")))
    return named.where("anchor is not null").join(anchors, "anchor", "left")
