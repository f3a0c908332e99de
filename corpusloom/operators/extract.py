"""Extraction from text: citations, labels, ordinance references, terms, answers' cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How section references are written; groups: sign, first number, second number.
CITATION = r"(§§?|Sections?|Sec[.])[ ]+([0-9]+[a-z]?(?:[.][0-9]+[a-z]?)*)(?:[ ]+to[ ]+([0-9]+[a-z]?(?:[.][0-9]+[a-z]?)*))?"
#: Ordinance references with their file number and dates.
ORDINANCE = r"Ord[.] ([0-9]+-[0-9]{2,4})(?:[^A-Za-z]*File No[.] ([0-9]+))?(?:[^A-Za-z]*App[.] ([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}))?"
#: Cites in answers, qualified and of bills.
QUALIFIED = r"\[([a-z][a-z0-9-]*) *§ *([a-z0-9][a-z0-9._-]*)\]"
BILL = r"\[Bill +#([0-9]{3,12})\]"


def citations(text: Column) -> Column:
    """All references of a text in order, as struct(display, first, last)."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    return F.transform(found, lambda x: F.struct(x.alias("display"), F.regexp_extract(x, CITATION, 2).alias("first"), F.nullif(F.regexp_extract(x, CITATION, 3), F.lit("")).alias("last")))


def target_kind(first: Column, last: Column) -> Column:
    """range if the ends have equally many dots, else the first number alone."""
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return F.when(last.isNotNull() & (dots(first) == dots(last)), "range").otherwise("single")


def ordinance_year(number: Column) -> Column:
    """Year of an ordinance number such as 193-23; two digits from 90 on are of the last century."""
    y = F.regexp_extract(number, "-([0-9]+)$", 1)
    n = F.when(y != "", y.cast("int"))
    return F.when(F.length(y) == 4, n).when(n >= 90, n + 1900).otherwise(n + 2000)


def iso_date(date: Column, year: Column) -> Column:
    """M/D/Y as an ISO date; two-digit years take the century of ``year``; null if month or day are out of range."""
    m, d, y = (F.nullif(F.split_part(date, F.lit("/"), F.lit(k)), F.lit("")).cast("int") for k in (1, 2, 3))
    whole = F.when(y < 100, F.floor(year / 100).cast("int") * 100 + y).otherwise(y)
    ok = m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.concat(whole.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")))


def canonical_term(term: Column) -> Column:
    """White space trimmed and collapsed."""
    return F.trim(F.regexp_replace(term, r"\s+", " "))


def definition_id(module: Column, section: Column, term: Column) -> Column:
    """module/section#hash, from the first eight digits of the canonical term's SHA-256."""
    return F.concat(module, F.lit("/"), section, F.lit("#"), F.left(F.sha2(canonical_term(term), 256), F.lit(8)))


def preview(text: Column, limit: int = 180, back: int = 40) -> Column:
    """The text's start: cut at the last space within ``back`` of the limit, else at the limit."""
    flat = F.trim(F.regexp_replace(text, "[ \t\n]+", " "))
    head = F.left(flat, F.lit(limit))
    space = limit - F.instr(F.reverse(head), " ")
    cut = F.when(space >= limit - back, F.left(head, space)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999, else null."""
    digits = (("M", "", ""), ("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X"))
    out = []
    for power, (one, five, ten) in zip((1000, 100, 10, 1), digits, strict=True):
        d = F.floor(n / power) % 10
        form = F.repeat(F.lit(one), d.cast("int"))
        if five:
            form = F.when(d == 9, one + ten).when(d >= 5, F.concat(F.lit(five), F.repeat(F.lit(one), (d - 5).cast("int")))).when(d == 4, one + five).otherwise(form)
        out.append(form)
    return F.when(n.between(1, 3999), F.concat(*out))


def recognise(texts: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of the terms of one glossary (see ``operators.recogniser``): id, start, term."""
    from corpusloom.operators import recogniser

    spark = texts.sparkSession
    glossary = spark.createDataFrame([("", t) for t in terms], "module_id string, term string")
    found = recogniser.recognised(texts.withColumn("_module", F.lit("")), glossary, id_col, text_col, "_module")
    return found.select(F.col("key").alias(id_col), "start", "term")


def tile(occurrences: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments that flatten back to each text: the occurrences and the text between them, in order.

    Returns id, seg_index, kind (text or term), raw. Gaps come from the previous occurrence's end;
    occurrences of one text do not overlap.
    """
    spans = occurrences.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("start"), (F.col("start") + F.length("term")).alias("end")))).alias("spans"))
    joined = texts.join(spans, id_col, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text_col)))
    gaps = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit("text").alias("kind")))
    terms = F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.lit("term").alias("kind")))
    parts = F.filter(F.array_sort(F.concat(gaps, terms)), lambda x: x["a"] < x["b"])
    rows = joined.select(id_col, text_col, F.posexplode(parts).alias("seg_index", "part"))
    return rows.select(id_col, "seg_index", "part.kind", F.substr(text_col, F.col("part.a") + 1, F.col("part.b") - F.col("part.a")).alias("raw"))
