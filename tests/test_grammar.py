"""Citations' grammar, definitions and boxes on small cases with nulls, ties and repeats."""

from pyspark.sql import functions as F

from corpusloom.operators import boxes, definitions, grammar, redline


def _targets(spark, cites, module=None, current=None):
    rows = spark.createDataFrame([(k, c, module, current) for k, c in enumerate(cites)], "k int, c string, m string, s string")
    return [tuple(r.t) if r.t else None for r in rows.select("k", grammar.target(F.col("c"), F.col("m"), F.col("s")).alias("t")).orderBy("k").collect()]


def test_targets(spark):
    cites = ["§ 10A.4", "§§16.9-2", "Sections 1.2-1.4", "Sec. 5(a)(1)", "Article IV", "Title 3.1", "subsection (b)", "Rule 4", "", None, "§", "Section 4 to"]
    got = _targets(spark, cites, current="7.1")
    assert got[0] == ("internal", None, None, "10a.4", None, None)
    assert got[1] == ("internal", None, None, "16.9-2", None, None)
    assert got[2] == ("internal", None, None, "1.2", "1.4", None)
    assert got[3] == ("internal", None, None, "5", None, "(a)(1)")
    assert got[5] == ("structural", "title", None, "3.1", None, None)
    assert got[6] == ("internal", None, None, "7.1", None, "(b)")
    assert [k for k, t in enumerate(got) if t is None] == [4, 7, 8, 9, 10, 11]
    assert _targets(spark, ["§ 2", "subsection (b)"], module="m") == [("cross_module", None, "m", "2", None, None), None]


def test_hits_and_phrases(spark):
    rows = spark.createDataFrame([(1, "m1", "Fire code, fire codes; FIRE CODE"), (2, "m2", None), (3, "m1", ""), (4, None, "the a+b code"), (5, "fire", "fire code")], "doc_id int, module_id string, text string")
    got = {(r.doc_id, r.module_id, r.start, r.end) for r in grammar.code_phrases(rows, {"fire": "Fire Code", "ab": "A+B Code", "none": ""}).collect()}
    assert got == {(1, "fire", 0, 9), (1, "fire", 23, 32), (4, "ab", 4, 12)}


def test_named_modules_and_refs(spark):
    names = spark.createDataFrame([("Fire Code",), ("fire  charter",), ("Code",), ("building inspection",), (None,)], "name string")
    modules = spark.createDataFrame([("m-fire", "Fire Code"), ("m-code", "Code")], "module_id string, code_title string")
    got = {r.name: r.module_id for r in grammar.named_modules(names, modules).collect()}
    assert got == {"Fire Code": "m-fire", "fire  charter": "m-fire", "Code": "m-code", "building inspection": "sf-building", None: None}
    refs = spark.createDataFrame([("sf-a::1.2",), ("::1",), ("a:1",), ("A::1",), (None,)], "r string").select(grammar.corpus_ref(F.col("r")).alias("r")).collect()
    assert [tuple(r.r) if r.r else None for r in refs] == [("sf-a", "1.2"), None, None, None, None]


def test_structural_places_take_the_last_sibling(spark):
    nodes = spark.createDataFrame([("m", "CHAPTER 1: A", [0], "1.1"), ("m", "CHAPTER I", [2], "3.1"), ("m", "CHAPTER 1 B", [2, 5], "3.5"), ("m", "CHAPTER 10", [3], "9.1"), ("m", "CHAPTER 2", [4], None)], "module_id string, label string, path array<int>, first_section string")
    refs = spark.createDataFrame([(1, "m", "chapter", "1"), (2, "m", "chapter", "2"), (3, "m", "article", "1"), (4, "x", "chapter", "1"), (5, "m", "chapter", None)], "ref_id int, module_id string, level string, number string")
    assert {r.ref_id: r.section_id for r in grammar.structural_places(refs, nodes).collect()} == {1: "3.1", 2: None, 3: None, 4: None, 5: None}


def test_definitions(spark):
    text = 'X.\n"\nTax " means a tax. “Tax” means it.\nThe Tax and "Fee" shall mean.'
    rows = spark.createDataFrame([(1, "m", "1.1", text, ["a"]), (2, "m", "1.2", None, ["a"]), (3, "m", "1.3", "", None)], "key int, module_id string, section_id string, text string, hierarchy array<string>")
    found = definitions.defined_terms(rows, id_col="key")
    assert {(r.term, r.way, text[r.start : r.end]) for r in found.collect()} == {("\nTax ", "quoted-means", "\nTax "), ("Tax", "curly-quoted-means", "Tax"), ("Fee", "shall-mean", "Fee")}
    made = definitions.definitions(rows, found, ["1.9"])
    got = {r.term: r for r in made.collect()}
    assert set(got) == {"Tax", "Fee"} and text[got["Tax"].begin : got["Tax"].end] == "Tax"
    assert got["Tax"].excerpt.startswith('"') and got["Fee"].excerpt == 'The Tax and "Fee" shall mean.'
    assert definitions.repeated_ids(made).count() == 0 and definitions.repeated_ids(made.union(made)).count() == 2
    at = text.index("Tax and")
    uses = [(1, "1.1", "Tax", at, at + 3, ["a"]), (2, "1.1", "Fee", text.index("Fee"), text.index("Fee") + 3, ["a"]), (3, "1.5", "Tax", 0, 3, ["b"])]
    fates = definitions.resolved(spark.createDataFrame(uses, "occ_id int, section_id string, term string, start int, end int, hierarchy array<string>"), made)
    assert {r.occ_id: r.fate for r in fates.collect()} == {1: "kept", 2: "suppressed", 3: "unresolved"}


def test_boxes(spark):
    rows = [("m", 1, "Section", None, None, "[Map]"), ("m", 2, "Section", "JD_1", " 2019 ordinances", ""), ("m", 3, None, None, None, None), ("m", 4, "SubSection", "JD_x", "Interp. Sec. 1", ""), ("m", 5, "Section", "JD_A", "Article 10, Appendix B", ""), ("m", 9, "SubSection", "JD_x", "Interp. Sec. 1", ""), ("m", 10, "Chapter", None, None, "")]
    made = boxes.classified(spark.createDataFrame(rows, "module_id string, pos int, class string, anchor_name string, anchor_title string, heading string"))
    assert [r.kind for r in made.orderBy("pos").collect()] == ["consumed_by_parent", "ordinance_history", "consumed_by_parent", "section", "appendix", "section", "hierarchy_marker"]
    for span in (1, 2, 4096):
        assert {r.pos: r.kind for r in boxes.demoted(made, span).where("pos in (4, 9)").collect()} == {4: "consumed_by_parent", 9: "section"}
    assert {r.pos for r in boxes.with_shared(made).where("shared").collect()} == {4, 9}


def test_places_of_feeds(spark):
    rows = spark.createDataFrame([("a\n\nb",), ("",), ("\n",), (None,), ("x",)], "t string")
    assert [r.p for r in rows.select(boxes.paragraph_breaks(F.col("t")).alias("p")).collect()] == [[1, 2], [], [0], None, []]
    assert rows.limit(1).select(boxes.line_number(F.col("t"), F.lit(3)).alias("n")).first().n == 3


def test_split_answers(spark):
    rows = spark.createDataFrame([("Text.\n\n## Sources\n- [Bill #123]\n\nMore",), ("No list",), (None,)], "a string")
    got = [tuple(r.s) if r.s else None for r in rows.select(redline.split_answer(F.col("a")).alias("s")).collect()]
    assert got == [("Text.", "## Sources\n- [Bill #123]\n"), ("No list", ""), None]
