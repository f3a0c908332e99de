"""Gates run where their tables are, and tell what breaks them."""

from corpusloom.operators import gates


def test_gates_without_tables(spark):
    assert gates.violations({}) is None
    modules = spark.createDataFrame([("m1", "Port Code"), ("m2", "PORT CODE"), ("m3", "Fire Code")], "id string, code_title string")
    assert [tuple(r) for r in gates.violations({"modules": modules}).collect()] == [("module_ids", "port code", "2")]


def test_citations_name_their_words(spark):
    segments = spark.createDataFrame([(1, 0, "§ 1", "citation", "0"), (1, 1, " and ", "text", None), (1, 2, "§ 2", "citation", "1"), (1, 3, "§ 9", "citation", "7")], "doc_id long, seg_index int, raw string, kind string, ref string")
    cited = spark.createDataFrame([(1, 0, "§ 1"), (1, 1, "§ 3")], "doc_id long, citation_index int, display string")
    assert sorted(r["subject"] for r in gates.citation_index(segments, cited).collect()) == ["1#1", "1#7"]


def test_every_gate_is_listed_once():
    names = [g.name for g in gates.GATES]
    assert len(names) == len(set(names)) == 13 and all(g.plan.__doc__ for g in gates.GATES)
