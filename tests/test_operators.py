"""Operators on small cases with results that can be read off."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.text import natural_key, snippet
from corpusloom.operators import diff, extract, html, outcomes, references
from corpusloom.plans.api import BadInput, Corpus, NotFound
from corpusloom.sources import corpus
from corpusloom.streaming import ingest


@given(st.text("ab \n.", max_size=30), st.text("ab \n.", max_size=30))
@settings(max_examples=200, deadline=None)
def test_diff_makes_both_texts(a, b):
    runs = diff.edit_script(diff.TOKEN.findall(a), diff.TOKEN.findall(b))
    assert "".join(t for o, t in runs if o != "insert") == a
    assert "".join(t for o, t in runs if o != "delete") == b


def test_white_space_changes_keep_the_old():
    assert diff.word_diff("a b", "a\nb") == [("equal", "a b")]
    assert diff.word_diff("the old law", "the new law") == [("equal", "the "), ("delete", "old"), ("insert", "new"), ("equal", " law")]
    assert diff.word_diff(None, None) == []


def test_smooth_and_slug():
    assert diff.smooth("A\nThe first\npart, and\n, more.\nNext") == "The first part, and, more.\nNext"
    assert diff.slug("  Été  Codé ") == "ete-code"
    assert diff.slug("CON") == "con-x"
    assert diff.slug("§") is None


def test_natural_key_orders_numbers(spark):
    ids = ["a10", "1.10", "a2", "10A.4", "1.2", "10.100"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(natural_key(F.col("id")))
    assert [r[0] for r in rows.collect()] == ["1.2", "1.10", "10.100", "10A.4", "a2", "a10"]


def test_snippet_marks_cuts(spark):
    row = spark.createDataFrame([("x" * 50 + " Needle\n here",)], "t string").select(snippet(F.col("t"), "needle", 10)).first()
    assert row[0] == "…xxxxxxxxx Needle here"


@pytest.mark.parametrize(
    ("text", "status"),
    [("Awaiting Mayor's signature", "enrolled"), ("Signed by Mayor", "enacted"), ("Vetoed", "vetoed"), ("Pending Committee Hearing", "committee"), ("Engrossed", "engrossed"), ("Pending", "filed"), ("odd", "filed"), (None, "filed")],
)
def test_bill_status(spark, text, status):
    assert spark.createDataFrame([(text,)], "t string").select(outcomes.bill_status(F.col("t"))).first()[0] == status


def test_citations_and_dates(spark):
    row = spark.createDataFrame([("See §§ 1.2 to 1.4 and Sec. 9a.",)], "t string").select(extract.citations(F.col("t")).alias("c")).first()
    assert [(c["first"], c["last"]) for c in row["c"]] == [("1.2", "1.4"), ("9a", None)]
    dates = spark.createDataFrame([("9/5/23", 2023), ("13/1/2020", 2020), ("5/25/93", 1993)], "d string, y int").select(extract.iso_date(F.col("d"), F.col("y")))
    assert [r[0] for r in dates.collect()] == ["2023-09-05", None, "1993-05-25"]


def test_recogniser_takes_the_longest_and_tiles_back(spark):
    d = spark.createDataFrame([(1, "the Planning Code and the Code"), (2, None), (3, "")], "doc_id long, text string")
    found = extract.recognise(d, ["Code", "Planning Code"])
    assert [(r["start"], r["term"]) for r in found.orderBy("start").collect()] == [(4, "Planning Code"), (26, "Code")]
    segments = extract.tile(found, d).where("doc_id = 1").orderBy("seg_index").collect()
    assert "".join(r["raw"] for r in segments) == "the Planning Code and the Code"


def test_candidates_and_binding(spark):
    refs = spark.createDataFrame([(1, "m", "10.0"), (2, "m", "7"), (3, "m", "")], "ref_id long, module_id string, ref string")
    refs = refs.withColumn("candidates", references.candidates(F.col("ref"), "p", ("g",), True))
    assert refs.where("ref_id = 1").first()["candidates"] == ["p10.0", "10.0", "g10.0", "p10", "10", "g10"]
    anchors = spark.createDataFrame([("m", "10"), ("m", "g10.0"), ("n", "7")], "module_id string, anchor_id string")
    bound = {r["ref_id"]: r["anchor_id"] for r in references.bind_first(refs, anchors).collect()}
    assert bound == {1: "g10.0", 2: None, 3: None}
    assert [(r["ref_id"], r["module_id"]) for r in references.bind_sibling(refs, anchors).collect()] == [(2, "n")]


def test_html_boxes(spark):
    page = '<h1>One</h1><p class="x y">a <b>bold</b> <a name="JD_1" href="#t">link</a></p><script>no</script>'
    rows = html.boxes(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("pos").collect()
    assert [r["tag"] for r in rows] == ["h1", "p"]
    assert rows[1]["text"] == "a bold link" and rows[1]["anchors"] == ["JD_1"] and rows[1]["links"] == ["#t"] and rows[1]["classes"] == ["x", "y"]
    assert [(s["start"], s["end"], s["format"]) for s in rows[1]["spans"]] == [(2, 6, "bold")]
    ids = spark.createDataFrame([("Sec 12**.",), (" 4A. ",), ("1 2*",)], "t string").select(html.section_id(F.col("t")))
    assert [r[0] for r in ids.collect()] == ["sec-12**", "4a", "1-2-fn1"]


def test_corpus_round_trip(spark, tmp_path):
    root = tmp_path / "corpus" / "alpha" / "sections"
    root.mkdir(parents=True)
    (root / "1.json").write_text('{"kind": "section", "id": "1.1", "text": "t", "hierarchy": ["a"]}')
    (tmp_path / "corpus" / "alpha" / "corpus-meta.json").write_text('{"module_id": "alpha", "schema_version": 4}')
    rows = corpus.read_sections(spark, str(tmp_path / "corpus"))
    assert [(r["module_id"], r["id"]) for r in rows.collect()] == [("alpha", "1.1")]
    with pytest.raises(Exception, match="schema version"):
        corpus.read_metadata(spark, str(tmp_path / "corpus")).collect()
    table = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "module_id string, section_id string")
    out = str(tmp_path / "live")
    for _ in range(2):
        refused = corpus.write_modules(table, out)
        assert [(r["module_id"], r["reason"]) for r in refused.collect()] == [("b", "duplicate_ids")]
    assert spark.read.parquet(out).count() == 2
    assert not os.path.exists(out + ".old")


def test_paths(spark, sf_dir):
    c = Corpus.of(spark, sf_dir)
    assert [r[0] for r in c.read("/").collect()] == ["bills", "definitions", "modules", "ordinances"]
    assert c.read("bills").count() == 50
    assert c.search("tion").first()["total_hits"] > 25
    with pytest.raises(NotFound):
        c.read("/nothing")
    with pytest.raises(BadInput):
        c.search("")


def test_stream_ingest(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    out = str(tmp_path / "out")
    ingest.ingest(stream, out, str(tmp_path / "state"), ["event_id"]).awaitTermination(60)
    assert spark.read.parquet(out).count() == source.select("event_id").distinct().count()
    assert ingest.action_counts(source).agg(F.sum("n")).first()[0] == source.count()


def test_redline_glyphs_and_text():
    from corpusloom.operators import redline

    marks = [(0.0, 30.0, "delete"), (30.0, 60.0, "insert")]
    assert redline.glyph_kinds("(3)(2)", 0.0, 60.0, marks) == [("(3)", "delete"), ("(2)", "insert")]
    assert redline.glyph_kinds("ab", 0.0, 20.0, []) == [("ab", "ambiguous")]
    assert redline.glyph_kinds("ab", 0.0, 20.0, [(0.0, 20.0, "delete"), (0.0, 20.0, "insert")]) == [("ab", "ambiguous")]
    baseline = "Alpha beta gamma. Middle part stays. Omega end."
    spans = [("context", "Alpha", ""), ("delete", "beta", ""), ("insert", "new", " "), ("context", "gamma.", " "), ("elision", "* * *", ""), ("context", "Omega", ""), ("context", "end.", " ")]
    assert redline.new_text(spans, baseline) == "Alpha new gamma. Middle part stays. Omega end."


def test_phrases_take_the_nearest_free_reference():
    from corpusloom.operators import spans

    text = "Section 102 of the Building Code and Section 50"
    phrase = (text.index("Building"), text.index(" and"), "building")
    cites = [(0, 11), (text.index("Section 50"), len(text))]
    assert spans.assign(text, [phrase], cites) == {0: "building"}
    assert spans.assign("See Section 1. It ends. The Fire Code says", [(28, 37, "fire")], [(4, 13)]) == {}
    assert spans.assign("Fire Code § 21", [(0, 9, "fire")], [(10, 14)]) == {0: "fire"}


def test_extents_of_capitalised_names():
    from corpusloom.operators import spans

    text = "The Board of the City and County. City Planning Code"
    at = text.index("City and")
    assert text[slice(*spans.extent(text, at, at + 4))] == "Board of the City"
    at = text.index("Planning")
    assert not spans.standing_alone(text, at, at + 8, {"Planning"})
    assert spans.standing_alone(text, at, at + 8, {"City Planning Code"})


def test_arbitration(spark):
    from corpusloom.operators import spans

    rows = [[(0, 5, "defined_term"), (3, 9, "citation"), (4, 6, "defined_term"), (9, 12, "defined_term"), (10, 11, "paragraph_break"), (11, 14, "subsection_label")]]
    df = spark.createDataFrame([(r,) for r in rows], f"s array<{spans.SPAN}>")
    got = [tuple(x) for x in df.select(spans.arbitrated(F.col("s")).alias("s")).first()["s"]]
    assert got == [(3, 9, "citation"), (9, 12, "defined_term"), (11, 14, "subsection_label")]
    kept = [tuple(x)[:2] for x in df.select(spans.without_overlaps(F.col("s")).alias("s")).first()["s"]]
    assert kept == [(0, 5), (9, 12)]


def test_grids(spark):
    from corpusloom.operators import grids

    head = "<thead><tr><th>File&nbsp;#</th><th>Type</th><th>Status</th><th>Title</th></tr></thead>"
    row = '<tr><td><a href="Detail.aspx?ID=12&GUID=AB">250001</a></td><td>Ordinance</td><td>Pending</td><td>A  title</td></tr>'
    page = f'<table class="rgMasterTable">{head}<tbody>{row}<tr><td colspan=4>x</td></tr></tbody></table>'
    pages = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in grids.grid_rows(pages).collect()}
    assert (got[1]["file_no"], got[1]["short_title"], got[1]["problem"]) == ("250001", "A title", None)
    assert got[2]["problem"] == got[3]["problem"] == "no grid"
    one = spark.range(1).select(
        grids.url_parameter(F.lit("x?ID=12&GUID=AB"), "guid"), grids.us_date(F.lit("9/5/2023")), grids.us_date(F.lit("soon")), grids.sponsor(F.lit(" - ")), grids.absolute_url(F.lit("/a"), "https://e.org/"),
        grids.next_page(F.lit("<a class=\"rgCurrentPage\"><span>2</span></a><a href=\"javascript:__doPostBack('g','Page$1')\"></a><a href=\"javascript:__doPostBack('g','Page$3')\"></a>")),
    ).first()
    assert tuple(one) == ("AB", "2023-09-05", None, None, "https://e.org/a", "Page$3")
    files = spark.createDataFrame([([("Leg Ver 1", "a"), ("Leg Ver 3", "b"), ("Leg Ver 3", "c")],), ([("Leg Digest", "d"), ("Memo", "e")],)], "f array<struct<name:string,url:string>>")
    assert [r[0]["url"] for r in files.select(grids.latest_version(F.col("f"))).collect()] == ["b", "d"]


def test_titles_and_slices(spark):
    from corpusloom.operators import headings

    assert headings.title_case("HARBOR-FRONT TRADERS' STALLS [REMOVED.]") == "Harbor-Front Traders' Stalls [Removed.]"
    assert headings.title_case("ROOF WORK UNDER SECTION 4.2(b)") == "Roof Work Under Section 4.2(b)"
    anchors = spark.createDataFrame([(1, "JD_A", 0), (1, "JD_B", 50), (1, "JD_C", 70), (1, "JD_C", 80)], "doc int, name string, offset int")
    wanted = spark.createDataFrame([("JD_A", "a"), ("JD_B", "b"), ("JD_C", "c"), ("JD_X", "x")], "name string, module_id string")
    got = {r["module_id"]: (r["begin"], r["end"], r["reason"]) for r in headings.module_slices(anchors, wanted).collect()}
    assert got == {"a": (0, 50, None), "b": (50, None, None), "c": (None, None, "repeated"), "x": (None, None, "missing")}
    sections = spark.createDataFrame([("m", "1", "old"), ("m", "2", "two")], "module_id string, id string, redirect_to string")
    renamed = spark.createDataFrame([("m", "old", "p.old"), ("m", "two", "p.two"), ("m", "two", "q.two")], "module_id string, old_id string, new_id string")
    assert {r["id"]: r["redirect_to"] for r in headings.redirects(sections, renamed).collect()} == {"1": "p.old", "2": "two"}


def test_verdicts(spark):
    from corpusloom.operators import answers

    rows = [(0, True, 0, 0, 0), (1, False, 1, 1, 1), (1, True, 0, 1, 1), (1, True, 0, 0, 1), (1, True, 0, 0, 0)]
    df = spark.createDataFrame(rows, "a int, b boolean, c int, d int, e int")
    v = answers.verdict(*(F.col(c) for c in "abcde"))
    assert [r[0] for r in df.select(v).collect()] == ["no_citations", "block_missing", "not_fetched", "claim_unsupported", "valid"]
    assert [r[0] != "" for r in df.select(answers.message(v)).collect()] == [True, True, True, True, False]


def test_order_inside_a_large_group(spark):
    from corpusloom.operators import ordering

    rows = spark.createDataFrame([("m", f"{k % 7}.{k}") for k in range(60)] + [("n", "1.1")], "g string, id string")
    ids = sorted((f"{k % 7}.{k}" for k in range(60)), key=lambda x: tuple(map(int, x.split("."))))
    key = natural_key(F.col("id"))
    got = {(r["g"], r["id"]): (r["previous"], r["following"]) for r in ordering.neighbours(rows, "g", key, "id", 12).collect()}
    assert got == {**{("m", x): (a, b) for a, x, b in zip([None, *ids], ids, [*ids[1:], None])}, ("n", "1.1"): (None, None)}
    assert {r["id"]: r["place"] for r in ordering.places(rows.where("g = 'm'"), "g", key, "id", 12).collect()} == {x: k for k, x in enumerate(ids, 1)}
    values = spark.createDataFrame([("a", float(v)) for v in [5, 1, 1, 9, 3, 100]] + [("b", 2.0), ("c", None)], "g string, v double")
    assert {r["g"]: r["value"] for r in ordering.value_at(values, "g", "v", 0.5).collect()} == {"a": 5.0, "b": 2.0}


def test_scopes(spark):
    occurrences = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", []), (3, "u", ["a"])], "occ_id int, term string, hierarchy array<string>")
    rows = [("m", "t", "module", None, "1"), ("h1", "t", "hierarchy", ["a"], "2"), ("h2", "t", "hierarchy", ["a", "b"], "3"), ("x", "t", "cross_module", None, "0"), ("e", "t", "hierarchy", [], "0")]
    definitions = spark.createDataFrame(rows, "def_id string, term string, scope_kind string, scope_prefix array<string>, defined_in string")
    got = {r["occ_id"]: (r["def_id"], r["n_dropped"]) for r in references.resolve_definitions(occurrences, definitions).collect()}
    assert got == {1: ("h2", 2), 2: ("m", 0)}


def test_nested_formats(spark):
    from corpusloom.operators import spans

    def flat(nodes):
        return "".join(n["text"] if "text" in n else flat(n["children"]) for n in nodes)

    tree = spans.nest("one two three", [(0, 13, "list"), (4, 7, "bold"), (5, 6, "italic")])
    assert tree == [{"style": "list", "children": [{"text": "one "}, {"style": "bold", "children": [{"text": "t"}, {"style": "italic", "children": [{"text": "w"}]}, {"text": "o"}]}, {"text": " three"}]}]
    for formats in ([], [(0, 2, "bold"), (2, 4, "bold")], [(1, 5, "bold"), (3, 8, "italic")], [(9, 99, "bold")]):
        assert flat(spans.nest("one two three", formats)) == "one two three"
    df = spark.createDataFrame([("ab", [(0, 1, "bold")]), (None, None)], "t string, f array<struct<start:int,end:int,format:string>>")
    assert [r[0] for r in df.select(spans.nested_json(F.col("t"), F.col("f"))).collect()] == ['[{"style": "bold", "children": [{"text": "a"}]}, {"text": "b"}]', "[]"]


def test_harvest(spark):
    from corpusloom.operators import answers

    calls = [(1, "/bills/25/impact", True), (1, "bills/25", False), (1, "/modules/m/sections/1.A", False), (1, "/modules/m", True), (2, None, True)]
    got = answers.harvested(spark.createDataFrame(calls, "turn_id int, path string, ok boolean")).collect()
    assert {(r["turn_id"], r["kind"], r["module_id"], r["key"], r["fetched"]) for r in got} == {(1, "bill", None, "25", True), (1, "section", "m", "1.a", False)}


def test_diffs_keep_what_thousands_of_changes_share():
    a = [x for k in range(2_100) for x in (f"s{k}", " ", f"a{k}", " ")]
    b = [x for k in range(2_100) for x in (f"s{k}", " ", f"b{k}", " ")]
    runs = diff.edit_script(a, b)
    assert "".join(t for o, t in runs if o != "insert") == "".join(a) and "".join(t for o, t in runs if o != "delete") == "".join(b)
    kept = "".join(t for o, t in runs if o == "equal").split()
    assert kept == [f"s{k}" for k in range(2_100)]


def test_window_of_whole_turns(spark):
    from corpusloom.plans.ordered import window_start

    def plain(sizes, high, low):
        start = count = 0
        for k, n in enumerate(sizes):
            count += n
            if count > high:
                while start < k and count > low:
                    count -= sizes[start]
                    start += 1
        return start

    cases = [[], [40], [2] * 15, [2] * 16, [10, 25, 1], [1, 40, 1, 1], [2] * 40, [31, 31], [7, 9, 3, 12, 5, 8, 30, 2]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, sizes array<long>")
    got = {r["k"]: r["s"] for r in rows.select("k", window_start(F.col("sizes")).alias("s")).collect()}
    assert got == {k: plain(c, 30, 20) for k, c in enumerate(cases)}
