"""Joins that meet one row per scope or number, whatever their number of definitions and parts: compared with plain versions."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import definitions, grammar, references


def _largest_join(df):
    """Most rows that any join of a plan gave, by running it."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            found = max(found, node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_definitions_of_one_scope_meet_as_one(spark):
    rng = random.Random(7)
    occ = [(k, rng.choice(["a", "b", "c"]), [rng.choice("xy"), rng.choice("12")]) for k in range(150)]
    defs = [(f"d{rng.randrange(90)}", rng.choice(["a", "b"]), *rng.choice([("module", None), ("hierarchy", ["x"]), ("hierarchy", ["x", "1"]), ("hierarchy", []), ("other", ["x"])]), f"s{rng.randrange(9)}") for _ in range(200)]
    want = {}
    for k, term, at in occ:
        fits = [(0 if kind == "hierarchy" else 1, -len(p or []), s, d) for d, t, kind, p, s in defs if t == term and (kind == "module" or (kind == "hierarchy" and p and at[: len(p)] == p))]
        if fits:
            want[k] = (min(fits)[3], "hierarchy" if min(fits)[0] == 0 else "module", len(fits) - 1)
    got = references.resolve_definitions(spark.createDataFrame(occ, "occ_id long, term string, hierarchy array<string>"), spark.createDataFrame(defs, "def_id string, term string, scope_kind string, scope_prefix array<string>, defined_in string"))
    assert {r["occ_id"]: (r["def_id"], r["scope_kind"], r["n_dropped"]) for r in got.collect()} == want
    assert _largest_join(got) <= 3 * len(occ)


def test_parts_of_one_number_meet_as_one(spark):
    nodes = spark.createDataFrame([("m", "ARTICLE 4: X", [k % 5, k], f"{k}.1" if k % 3 else None) for k in range(100)], "module_id string, label string, path array<int>, first_section string")
    refs = spark.createDataFrame([(k, "m", "article", "4") for k in range(100)], "ref_id long, module_id string, level string, number string")
    got = grammar.structural_places(refs, nodes)
    assert {r["section_id"] for r in got.collect()} == {"94.1"}  # of the last siblings (k % 5 = 4), the last with a section
    assert _largest_join(got) <= 200


def test_definers_as_a_condition(spark):
    rows = spark.createDataFrame([(1, "m", "1", ["h"], '"Fee" means a sum.'), (2, "m", "2", ["h"], '"Fee" means a sum.')], "key long, module_id string, section_id string, hierarchy array<string>, text string")
    found = definitions.defined_terms(rows, id_col="key")
    told = {how: sorted((r["defined_in"], r["scope_kind"]) for r in definitions.definitions(rows, found, d).collect()) for how, d in (("list", ["2"]), ("condition", F.col("key") == 2))}
    assert told["list"] == told["condition"] == [("1", "hierarchy"), ("2", "module")]
