"""Bills' structure, offset maps and texts whose spans survive."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import offsets
from corpusloom.operators import bill_structure as B
from corpusloom.operators import spantext as S


def ranges(spark, text):
    rows = B.ranges(spark.createDataFrame([(1, text), (2, None)], "file_no long, text string")).collect()
    return {(r["kind"], r["group_no"], r["header_no"]): r for r in rows}


BILL = """[Code - Title]
Ordinance amending the Port Code
Be it ordained

Section 1. Chapter 2 of the Port Code is hereby amended by revising Section 4, to read:
 SEC. 4. WIDE
 TITLES, AND MORE.
(a) One.
ARTICLE 7: OTHER
not a body
SECTION 5A-1. SECOND.
Text of Section 9. Not a header.
Section 2. Articles 1 and 2 of the Mayor's Charter is are hereby amended:
Section 3. Scope. Nothing.
APPROVED AS TO FORM:
"""


def test_ranges_are_nested_and_disjoint(spark):
    got = ranges(spark, BILL)
    assert set(got) == {("preamble", None, None), ("group", 1, None), ("group", 2, None), ("header", 1, 1), ("header", 1, 2), ("closing", None, None)}
    cut = lambda k, a="start", b="end": BILL[got[k][a] : got[k][b]]
    assert (got["group", 1, None]["name"], got["group", 2, None]["name"]) == ("Port Code", "Mayor's Charter")
    assert (got["header", 1, 1]["number"], got["header", 1, 1]["name"]) == ("4", "WIDE TITLES, AND MORE.") and got["header", 1, 2]["number"] == "5A-1"
    assert cut(("header", 1, 1), "after") == "\n(a) One.\n" and cut(("header", 1, 2), "after") == "\nText of Section 9. Not a header.\n"
    assert cut(("closing", None, None)) == "Section 3. Scope. Nothing.\nAPPROVED AS TO FORM:\n" and cut(("preamble", None, None)).rstrip().endswith("ordained")
    ends = sorted((r["start"], r["end"]) for k, r in got.items() if k[0] != "header")
    assert [a for a, _ in ends] == [0] + [b for _, b in ends][:-1] and ends[-1][1] == len(BILL)


def test_bill_without_groups(spark):
    (got,) = ranges(spark, "Resolution urging action.\nSection 1. Title.").values()
    assert (got["kind"], got["start"], got["end"]) == ("preamble", 0, 43)


def test_gate_on_headers(spark):
    bills = spark.createDataFrame([(1, BILL)], "file_no long, text string")
    found = B.ranges(bills)
    made = B.blocks(bills, found)
    assert B.gated(made, found).count() == made.count()
    with pytest.raises(Exception, match="bill 1: 2 headers found, 1 in blocks"):
        B.gated(made.where("kind <> 'code_section_header' or header_no = 1"), found).collect()


def test_reflow_and_actions(spark):
    one = lambda text: spark.createDataFrame([(text,)], "t string").select(B.reflowed(F.col("t")).alias("r"), B.structural_action(F.col("t")).alias("a")).first()
    assert one("a\n b\n\n\n c\n(1) d\ne\n(x)\nSEC. 5 f\nBe it ordained g\n  [h")["r"] == "a b\n\nc\n\n(1) d e (x)\n\nSEC. 5 f\n\nBe it ordained g\n\n[h"
    assert one("")["r"] == "" and one("Chapter 2 Is  Hereby repealed in its entirety")["a"] == "Is  Hereby repealed in its entirety"
    assert one("by amending")["a"] is None


def brute(text):
    """The clean text and where each character went."""
    out, where = "", {}
    at = 0
    for line in text.split("\n"):
        kept = [(k, " " if c in " \t " else c) for k, c in enumerate(line) if not (c in " \t " and k and line[k - 1] in " \t ")]
        while kept and kept[0][1] == " ":
            kept.pop(0)
        while kept and kept[-1][1] == " ":
            kept.pop()
        if kept:
            out += "\n" if out else ""
            for k, c in kept:
                where[at + k] = len(out)
                out += c
        at += len(line) + 1
    return out, where


def test_clean_lines_project_spans():
    pick = random.Random(2)
    for _ in range(400):
        text = "".join(pick.choices("ab \t \n", k=pick.randint(0, 25)))
        m, (clean, where) = offsets.clean_lines(text), brute(text)
        assert m.text == clean
        for _ in range(6):
            a, b = sorted(pick.choices(range(len(text) + 1), k=2))
            left = [where[k] for k in range(a, b) if k in where]
            assert m.span(a, b) == ((left[0], left[-1] + 1) if left else None)


def test_maps_compose():
    pick = random.Random(3)
    for _ in range(300):
        text = "".join(pick.choices("abcde", k=30))
        one = offsets.without(text, re.compile(pick.choice(["a+", "bc?", "(?<=a)b"])))
        two = offsets.edited(one.text, [(m.start(), m.end(), "x" * pick.randint(0, 2), False) for m in re.finditer("c+", one.text)])
        both = one.then(two)
        assert both.text == two.text
        for o, n, size in zip(both.old, both.new, both.size):
            assert text[o : o + size] == two.text[n : n + size]
        assert sum(both.size) == sum(c not in "c" for c in one.text)


def test_chrome_and_runs(spark):
    rows = [(1, 0, "FILE NO. 26 ORDINANCE NO. 1", True), (1, 1, "The ", False), (1, 2, "cat", False), (1, 3, "sat  ", True), (1, 4, "7", True), (1, 5, "26", True), (1, 6, "on it Supervisors Chan; Safai", True), (1, 7, "Mayor Lee;", True),
            (1, 8, "", True), (1, 9, "", True), (1, 10, "", True), (1, 11, "end", None), (2, 0, None, True)]
    got = {r["doc"]: r for r in S.run_texts(spark.createDataFrame(rows, "doc long, run long, text string, has_eol boolean")).collect()}
    text = got[1]["text"]
    assert text == "The cat sat\n26\non it\n\nend" and (got[2]["text"], got[2]["ranges"]) == ("", [])
    assert [(r["run"], text[r["start"] : r["end"]]) for r in got[1]["ranges"]] == [(1, "The "), (2, "cat"), (3, "sat"), (5, "26"), (6, "on it"), (11, "end")]


def test_normal_text_is_stable(spark):
    df = spark.createDataFrame([("  é a  b \n",), ("",), (None,)], "t string")
    once = df.select(S.normal(F.col("t")).alias("t"))
    assert [r[0] for r in once.collect()] == ["é a b", "", None] == [r[0] for r in once.select(S.normal(F.col("t"))).collect()]
    assert [r[0] for r in df.select(S.tokens(F.col("t"))).collect()] == [[(0, "é"), (2, "a"), (4, "b")], [], None]
