"""Steps that are made once, not once for each that reads them, and work that is dealt out."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import matcher, offsets
from corpusloom.operators import citations, definitions, external, redline, segments
from corpusloom.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cut_bodies_are_written(spark, sf_dir):
    for name in ("body_texts", "overlaid_bodies"):
        plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
        assert "documents" not in plan and "MapInArrow" not in plan, name


def plain_fits(cut, formats):
    whole = [x for x in cut if x[2] != "text"]
    return [f for f in formats if f[0] < f[1] and all(f[1] <= s or e <= f[0] or (f[0] <= s and e <= f[1]) for s, e, _, _ in whole)]


def test_formats_against_a_plain_version():
    r = random.Random(3)
    for _ in range(300):
        at, cut = 0, []
        while at < 30:
            end = min(30, at + r.randint(1, 5))
            cut.append((at, end, r.choice(["text", "citation", "defined_term"]), None))
            at = end
        formats = [(a, a + r.randint(0, 9), str(k)) for k, a in enumerate(r.choices(range(26), k=6))]
        text = "".join(r.choices("abc\n", k=30))
        assert segments.nested(text, cut, formats) == segments.nested(text, cut, plain_fits(cut, formats))


def test_formats_meet_few_leaves():
    class Counted(int):
        seen = 0

        def __le__(self, other):
            Counted.seen += 1
            return int(self) <= int(other)

    n = 400
    cut = [(Counted(k), Counted(k + 1), "citation", None) for k in range(n)]
    segments.nested("x" * n, cut, [(Counted(k), Counted(k + 1), "bold") for k in range(n)])
    assert Counted.seen < 40 * n


def test_a_common_term_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(definitions, "EACH", 8, raising=False)
    rows = spark.range(100).select(F.lit("The  One").alias("term"), F.lit("m").alias("module_id"), F.col("id").cast("string").alias("defined_in"))
    uses = spark.createDataFrame([(1, " the one"), (2, "other"), (3, None), (4, "THE ONE")], "section_key long, term string")
    made = definitions.terms_defined(uses, rows)
    got = sorted((r["section_key"], r["defined_in"] or "") for r in made.collect())
    assert got == sorted([(k, str(n)) for k in (1, 4) for n in range(100)] + [(2, ""), (3, "")])
    assert "_part" in plan_of(made)


def test_references_are_read_once(spark, sf_dir):
    assert plan_of(catalog.QUERIES["bound_citations"](spark, sf_dir)).count("l_suppkey#") and plan_of(catalog.QUERIES["bound_citations"](spark, sf_dir)).count("Relation [l_orderkey") == 1
    assert "Relation [l_orderkey" not in plan_of(catalog.QUERIES["gate_lost_anchors"](spark, sf_dir))


def test_beginnings():
    assert matcher.beginnings(citations.PATTERNS[0]) == {"§", "section", "sec."}
    assert matcher.beginnings(r"\bC\.?V\.?C\.?\b") == {"cvc", "c.vc", "cv.c", "c.v.c"}
    assert matcher.beginnings(r"[ab]c") == matcher.beginnings(r"a[bc]") == matcher.beginnings(r"x*ab") == set()


def test_matches_at_beginnings_against_a_plain_version():
    patterns = [*citations.PATTERNS, *(p for _, _, ps in external.REGISTRY for p in ps), r"(?:ab|abc|[xy])d", r"(a)?bc", r"É+t", "aa"]
    m = matcher.Matcher(patterns)
    assert not matcher.Matcher(citations.PATTERNS).always
    r = random.Random(5)
    words = ["§", "§§ ", "Section ", "SECTIONS 1.2", "sec. 3", "7A.1(b)", " 12-13", "C.V.C.", "cvc", "USC", "U.S.C.", "Cal. Civ. Code", "civil  code", "Article 5", "subsection (a)(2)", "İ", "K", "ſection 1", "ÉÉt", "abc", "abd", "aaaa", "bc", "xd", " ", "\n", "and ", "to ", "Bus. & Prof. Code"]
    for _ in range(600):
        text = "".join(r.choices(words, k=r.randint(0, 12)))
        want = [(k, x.span()) for k, rule in enumerate(m.rules) for x in re.finditer(rule, text)]
        assert [(k, x.span()) for k, x in m.find(text)] == want, text


def test_letters_against_a_pattern():
    r = random.Random(7)
    for _ in range(2000):
        text, part = "".join(r.choices("ab \n ", k=r.randint(0, 14))), "".join(r.choices("ab \t", k=r.randint(0, 3)))
        start, letters = r.randint(0, len(text)), "".join(part.split())
        m = re.compile(r"\s*".join(re.escape(c) for c in letters)).search(text, start)
        assert redline.Letters(text).find(part, start) == ((start, start) if not letters else m and m.span()), (text, part, start)


def test_named_sections_are_written(spark, sf_dir):
    for name in ("section_chunks", "section_outcomes", "section_bodies"):
        plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
        assert "l_orderkey" not in plan, name
    assert plan_of(catalog.QUERIES["section_chunks"](spark, sf_dir)).count("ArrowEvalPython") == 2


def test_runs_are_dealt_out_once(spark, sf_dir):
    plan = catalog.QUERIES["run_ranges"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_an_edit_that_changes_nothing_leaves_a_map():
    m = offsets.without("a bb c", re.compile("b+"))
    assert m.then(offsets.without(m.text, re.compile("x"))) is m


def test_terms_are_found_in_one_pass(spark):
    r = random.Random(13)
    words = ['"a" means', '"a" ', "“B c” means", "”", "“", '"', " shall\nmean", " means", " is defined as", " means", "\x0bmeans", "x", '"x x"', "😀", " are\t defined  as", "\n"]
    rows = spark.createDataFrame([(k, "".join(r.choices(words, k=r.randint(0, 12)))) for k in range(800)] + [(-1, None), (-2, "")], "key long, text string")
    made = definitions.defined_terms(rows, id_col="key")
    plan = plan_of(made)
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
    want = set()
    for way, p in definitions.PATTERNS.items():
        hit = rows.select("key", F.explode_outer(definitions.hits(F.col("text"), p, 1)).alias("h")).where("h is not null")
        for x in hit.select("key", "h.*", F.expr("instr(h.whole, h.found)").alias("i")).collect():
            at = x["start"] + x["i"] - 1
            want.add((x["key"], x["found"], at, at + len(x["found"]), way, x["start"] + len(x["whole"])))
    got = [tuple(x) for x in made.collect()]
    assert set(got) == want and len(got) == len(want) > 300


def test_pairs_decide_how_many_tasks_make_them(spark, monkeypatch):
    monkeypatch.setattr(definitions, "PAIRS", 1000, raising=False)
    monkeypatch.setattr(definitions, "EACH", 50, raising=False)
    rows = spark.range(2000).select(F.lit("one").alias("term"), F.lit("m").alias("module_id"), F.col("id").cast("string").alias("defined_in"))
    uses = spark.range(30).select(F.col("id").alias("section_key"), F.lit("One").alias("term"))
    made = definitions.terms_defined(uses, rows)
    assert made.groupBy(F.spark_partition_id()).count().count() > 12 and made.count() == 60000


def test_bodies_are_walked_in_one_chain(spark):
    rows = [(1, '[{"kind":"text","text":"a"},{"kind":"format","style":"list","children":[{"kind":"text","text":"b"},{"kind":"format","style":"bold","children":[{"kind":"citation","text":"c","ref":"0"}]}]}]'), (2, "[]"), (3, '[{"kind":"text","text":"children: ARRAY"}]'), (4, None)]
    nodes = segments.walked(spark.createDataFrame(rows, "doc_id long, j string").select("doc_id", F.parse_json("j").alias("body")))
    assert "Union" not in plan_of(nodes) and plan_of(nodes).count("Relation [") == 1
    got = sorted(map(tuple, nodes.select("doc_id", "path", "kind", "style", "text", "ref", "depth").collect()))
    assert got == [
        (1, [0], "text", None, "a", None, 0), (1, [1], "format", "list", None, None, 0), (1, [1, 0], "text", None, "b", None, 1), (1, [1, 1], "format", "bold", None, None, 1),
        (1, [1, 1, 0], "citation", None, "c", "0", 2), (3, [0], "text", None, "children: ARRAY", None, 0),
    ]
    assert sorted(map(tuple, segments.flattened(nodes).collect())) == [(1, "abc"), (3, "children: ARRAY")]


def test_places_are_found_in_one_pass(spark):
    from corpusloom.operators import grammar

    r = random.Random(17)
    rows = spark.createDataFrame([(k, "".join(r.choices(["(a)", "(1)", "\n", " ", "\t", "A", "b", "Ab c", "😀", "\x0b", "\xa0"], k=r.randint(0, 12)))) for k in range(600)] + [(-1, None)], "doc_id long, text string")
    for pattern, group in ((segments.LABEL, 1), ("\n", 0), ("[^\n]+", 0), ("[A-Z][a-z]+ [a-z]+", 0)):
        made = grammar.places(rows, pattern, group)
        assert "regexp_extract_all" not in plan_of(made)
        want = rows.select("doc_id", F.explode_outer(grammar.hits(F.col("text"), pattern, group)).alias("h")).where("h is not null").select("doc_id", "h.*")
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())), pattern
