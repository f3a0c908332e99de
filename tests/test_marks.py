"""Bills' markers, ranges and paragraphs: one pass over a text finds what its patterns find one by one."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import anchoring, bill_structure, grammar
from corpusloom.plans import catalog, structure

WORDS = [
    "Section 1. The Health Code is hereby amended by", "SEC. 4. WIDE", "SECTION 5A-1. SECOND.", "Section 3. SCOPE", "ARTICLE 7: OTHER", "ARTICLE 9B:", "APPROVED AS TO FORM", "Section", "SEC.",
    "Section 2. Articles of the Mayor's Charter are amended", "TITLES, AND", "(a) One.", "(2) ", "text", "12", "12 ", "3\n", "\n", "\n\n", "\r\n", "\r", " ", "\x85", " ", "　", "\t", "é",
]


def texts(n):
    r = random.Random(11)
    return ["".join(r.choices(WORDS, k=r.randint(0, 14))) for _ in range(n)]


def test_marks_against_each_pattern(spark):
    rows = spark.createDataFrame(list(enumerate(texts(3000))), "id long, text string")
    patterns = {"group": bill_structure.AMEND, "header": bill_structure.HEADER, "article": bill_structure.ARTICLE, "closing": bill_structure.CLOSING}
    found = rows.select("text", *(grammar.hits(F.col("text"), p).alias(k) for k, p in patterns.items())).collect()
    for row in found:
        got = bill_structure._marks(row["text"])
        for kind in patterns:
            assert [(m.start(), m[0]) for m in got[kind]] == [(h["start"], h["whole"]) for h in row[kind]], (kind, row["text"])


def test_paragraphs_against_a_plain_version(spark):
    label = bill_structure.LABEL
    short = label.removeprefix(f"(?i)^[{bill_structure.WHITE}]*")
    rows = spark.createDataFrame(list(enumerate(texts(1500))), "id long, text string")
    raw = rows.select("id", "text", F.posexplode(bill_structure.paragraphs(F.col("text"), f"(?i:{short})")).alias("k", "p"))
    want: dict = {}
    for r in raw.select("id", "k", F.regexp_extract("p", label, 1).alias("own"), bill_structure._squeezed(F.regexp_replace("p", label, "")).alias("t")).collect():
        if r["own"] or r["t"]:
            want.setdefault(r["id"], []).append((r["k"], r["own"], r["t"]))
    for k, text in enumerate(texts(1500)):
        marker, n, told = None, 0, []
        for place, own, t in sorted(want.get(k, [])):
            marker, n = (own, n + 1) if own else (marker, n)
            told.append((place + 1, marker, n or None, t or None))
        assert bill_structure._cut(text) == told, text


def test_blocks_of_raw_ranges(spark):
    r = random.Random(12)
    bills = spark.createDataFrame([(k, "".join(r.choices(WORDS[:8], k=6)) + "\n" + "\n".join(r.choices(WORDS[:14], k=12))) for k in range(300)] + [(-1, None), (-2, "")], "file_no long, text string").cache()
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    apart, at_once = bill_structure.blocks(bills, bill_structure.ranges(bills)), bill_structure.blocks(bills, bill_structure.ranges(bills, raw=True))
    assert rows(apart) == rows(at_once) and apart.where("kind = 'paragraph'").count() > 100
    made = anchoring.given_texts(bill_structure.sections(bill_structure.ranges(bills, raw=True)))
    assert rows(made) == rows(anchoring.section_texts(apart)) and made.count() > 100


def test_texts_are_read_where_they_are_made(spark, sf_dir):
    plan = catalog.QUERIES["bill_ranges"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "regexp_extract_all" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 1
    plan = catalog.QUERIES["added_texts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(file_no") == 1 and plan.count("ArrowEvalPython") == 1


def test_a_path_reads_its_bill_only(spark, sf_dir):
    bills = structure.bill_texts(spark, sf_dir).where("file_no = 3")
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderkey,3\)", bills._jdf.queryExecution().executedPlan().toString())
