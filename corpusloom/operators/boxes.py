"""A code's boxes: their kind by class and anchor, passes over a module's boxes, and audits of both.

Boxes have module_id, pos, class, anchor_name, anchor_title (null without an anchor) and heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import running_sums
from corpusloom.operators.headings import HEADING
from corpusloom.operators.html import section_id

#: Classes of sections, and anchor titles of histories, appendices and paragraphs.
SECTION = "^(?:level-)?(?:Section|Subsection|SubSection)(?:-NewOrd|-Deleted)?$"
DELETED = "^(?:level-)?(?:Section|Subsection|SubSection)-Deleted$"
SUBSECTION = "^(?:level-)?Sub[Ss]ection"
ORDINANCES, RESOLUTIONS = r"(?i)^([0-9]{4})\s+ordinances$", r"(?i)^([0-9]{4})\s+resolutions$"
APPENDIX = r"(?i)^(article|ch\.|chapter)\s+([0-9]+|[a-z]+)\s*,?\s*appendix\s+([a-z]+)$"
PARAGRAPH = r"^[0-9]+\([a-z]\)$"
#: Fixed value: a valid section id.
VALID = r"^[a-z0-9]+(?:[._-][a-z0-9]+)*$"
#: Headings of boxes without anchor and number, by name, in the order in which they are tried.
CHROME = {
    "New Ordinance/Legislation/Resolution Notice": r"(?i)new\s+(?:ordinance|legislation|resolution)",
    "Bracketed caption": r"^\[[^\]]+\]$",
    "Year label / Ordinances": r"(?i)^[0-9]{4}\s*(?:ordinances?|>?)",
    "Map-sheet header": r"(?i)zoning|use district|map",
    "Appendix label": r"(?i)^appendix\s+",
    "ARTICLE label": r"(?i)^article\s+",
    "CHAPTER label": r"(?i)^chapter\s+",
    "DIVISION label": r"(?i)^division\s+",
}


def _any(tokens: Column, pattern: str) -> Column:
    return F.exists(tokens, lambda c: c.rlike(pattern))


def kind(classes: Column, anchor_name: Column, anchor_title: Column, heading: Column) -> Column:
    """struct(kind, level, year, parent_kind, parent_number, letter, status) of a box.

    Kinds: hierarchy_marker, section, appendix, ordinance_history, resolution_history and
    consumed_by_parent. A section-classed box without anchor and number is consumed; a deleted
    class makes a section reserved until its heading tells more.
    """
    tokens = F.filter(F.split(F.coalesce(classes, F.lit("")), r"\s+"), lambda c: c != "")
    title = F.trim(F.coalesce(anchor_title, F.lit("")))
    level = F.coalesce(*(F.when(_any(tokens, f"^(?:level-)?{name}(?:-|$)"), F.lit(name)) for name in ("Article", "Chapter", "Division")))

    def made(name: str, **more: Column) -> Column:
        types = {"level": "string", "year": "int", "parent_kind": "string", "parent_number": "string", "letter": "string", "status": "string"}
        return F.struct(F.lit(name).alias("kind"), *(more.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))

    consumed = made("consumed_by_parent")
    parent = F.when(F.lower(F.regexp_extract(title, APPENDIX, 1)) == "article", "article").otherwise("chapter")
    number = F.regexp_extract(title, APPENDIX, 2)
    plain = F.when(number.rlike("^[0-9]+$"), F.regexp_replace(number, "^0+(?=[0-9])", "")).otherwise(F.lower(number))
    chrome = anchor_name.isNull() & ~F.coalesce(heading.rlike(HEADING), F.lit(False))
    return (
        F.when(level.isNotNull(), made("hierarchy_marker", level=level))
        .when(~_any(tokens, SECTION) | chrome, consumed)
        .when(title.rlike(ORDINANCES), made("ordinance_history", year=F.nullif(F.regexp_extract(title, ORDINANCES, 1), F.lit(""))))
        .when(title.rlike(RESOLUTIONS), made("resolution_history", year=F.nullif(F.regexp_extract(title, RESOLUTIONS, 1), F.lit(""))))
        .when(title.rlike(APPENDIX), made("appendix", parent_kind=parent, parent_number=plain, letter=F.lower(F.regexp_extract(title, APPENDIX, 3))))
        .when(title.rlike(PARAGRAPH), consumed)
        .otherwise(made("section", status=F.when(_any(tokens, DELETED), "reserved").otherwise("active")))
    )


def classified(boxes: DataFrame) -> DataFrame:
    """``boxes`` with the columns of :func:`kind`."""
    return boxes.withColumn("_k", kind(*(F.col(c) for c in ("class", "anchor_name", "anchor_title", "heading")))).select(*boxes.columns, "_k.*")


def demoted(rows: DataFrame, span: int = 4096) -> DataFrame:
    """Classified boxes with subsections consumed whose title is no section id, outside an appendix.

    An appendix lasts from its box to the next marker. A module's boxes are looked at in stretches of
    ``span`` places, so a large module is no single group; what a stretch inherits is one row each.
    """
    marks = F.when(F.col("kind") == "appendix", True).when(F.col("kind") == "hierarchy_marker", False)
    cut = rows.withColumns({"_stretch": F.floor(F.col("pos") / span), "_mark": marks})
    last = cut.groupBy("module_id", "_stretch").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("pos"))).alias("_last"))
    held = F.expr("last(_last, true) over (partition by module_id order by _stretch rows between unbounded preceding and 1 preceding)")
    before = last.select("module_id", "_stretch", held.alias("_before"))
    inside = F.coalesce(F.expr("last(_mark, true) over (partition by module_id, _stretch order by pos)"), "_before", F.lit(False))
    flagged = cut.join(before, ["module_id", "_stretch"]).withColumn("_in", inside)
    title = F.trim(F.coalesce("anchor_title", F.lit("")))
    odd = (title != "") & ~section_id(title).rlike(VALID) & _any(F.split("class", r"\s+"), SUBSECTION)
    gone = (F.col("kind") == "section") & ~F.col("_in") & odd
    return flagged.withColumns({"kind": F.when(gone, "consumed_by_parent").otherwise(F.col("kind")), "status": F.when(~gone, F.col("status"))}).select(*rows.columns)


def anchor_key(name: Column, title: Column) -> Column:
    """An anchor's title, else its name, in lower case; null without either."""
    named = F.when(F.trim(name).startswith("JD_"), F.lower(F.substr(F.trim(name), F.lit(4))))
    return F.nullif(F.coalesce(F.nullif(F.lower(F.trim(title)), F.lit("")), named), F.lit(""))


def with_shared(rows: DataFrame) -> DataFrame:
    """Classified boxes with ``shared``: whether several sections of the module have the same anchor."""
    keyed = rows.withColumn("_anchor", anchor_key(F.col("anchor_name"), F.col("anchor_title")))
    many = keyed.where("kind = 'section' and _anchor is not null").groupBy("module_id", "_anchor").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("shared", F.lit(True)).drop("_n")
    return keyed.join(many, ["module_id", "_anchor"], "left").select(*rows.columns, (F.coalesce("shared", F.lit(False)) & (F.col("kind") == "section")).alias("shared"))


def accounting(rows: DataFrame, records: DataFrame, least: DataFrame) -> DataFrame:
    """Modules that must not be built: module_id, reason (too_few_sections or boxes_lost), seen, accounted.

    ``rows``: classified boxes; ``records``: module_id, kind of what was made of them (section, appendix, a history or
    skipped); ``least``: module_id, min_sections (null: none). Boxes are accounted for by records, and by those consumed or markers.
    """
    seen = rows.groupBy("module_id").agg(F.count("*").alias("seen"), F.count_if(F.col("kind").isin("consumed_by_parent", "hierarchy_marker")).alias("_aside"))
    made = records.groupBy("module_id").agg(F.count("*").alias("_made"), F.count_if(F.col("kind") == "section").alias("_sections"))
    met = seen.join(made, "module_id", "full").join(least, "module_id", "left").na.fill(0, ["seen", "_aside", "_made", "_sections"])
    told = met.withColumn("accounted", F.col("_aside") + F.col("_made"))
    reason = F.when(F.col("_sections") < F.col("min_sections"), "too_few_sections").when(F.col("seen") != F.col("accounted"), "boxes_lost")
    return told.withColumn("reason", reason).where("reason is not null").select("module_id", "reason", "seen", "accounted")


def toc_anchors(anchors: DataFrame, renamed: DataFrame) -> DataFrame:
    """Anchors (module_id, name) of a build's table of contents without JD_, less the old ids (module_id, old_id) that were rewritten."""
    named = anchors.where(F.col("name").rlike("^JD_.")).select("module_id", F.substr("name", F.lit(4)).alias("anchor")).distinct()
    old = renamed.select("module_id", F.explode(F.array("old_id", F.lower("old_id"))).alias("anchor")).distinct()
    return named.join(old, ["module_id", "anchor"], "left_anti")


def paragraph_breaks(text: Column) -> Column:
    """Places of the line feeds of a section's text, from 0."""
    parts = F.split(text, "\n", -1)
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part: F.length(part) + 1)
    return F.transform(running_sums(lengths), lambda end: end - 1)


def line_number(text: Column, offset: Column) -> Column:
    """The line, from 1, that a place (from 0) in a text lies in."""
    return F.length(F.regexp_replace(F.left(text, offset), "[^\n]", "")) + 1


def audit(boxes: DataFrame) -> DataFrame:
    """Section-classed boxes by what tells their id: bucket (anchor, number, or the name of the chrome they look like, else unclassified), heading of the latter, n."""
    tokens = F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: c != "")
    heading = F.coalesce("heading", F.lit(""))
    named = F.coalesce(*(F.when(heading.rlike(p), F.lit(n)) for n, p in CHROME.items()), F.lit("unclassified"))
    bucket = F.when(F.col("anchor_name").isNotNull(), "anchor").when(heading.rlike(HEADING), "number").otherwise(named)
    sure = bucket.isin("anchor", "number")
    return boxes.where(_any(tokens, SECTION)).groupBy(bucket.alias("bucket"), F.when(~sure, heading).alias("heading")).agg(F.count("*").alias("n"))


def disagreements(sections: DataFrame) -> DataFrame:
    """Sections whose id is not the number of their label, by shape: module_id, anchor, heading, n."""
    number = F.regexp_extract("display_label", r"^[0-9A-Za-z*-]+(?:\.[0-9A-Za-z*-]+)*", 0)
    named = sections.withColumn("heading", section_id(F.nullif(number, F.lit("")))).where("heading is not null and heading <> section_id")
    return named.groupBy("module_id", F.col("section_id").alias("anchor"), "heading").agg(F.count("*").alias("n"))
