"""Places of matches, and how often bills' ranges are found for their blocks."""

import re

from pyspark.sql import functions as F

from corpusloom.operators import bill_structure, grammar
from corpusloom.plans import catalog

TEXTS = [None, "", "x", "aé1 b22 c", "22", "😀 a1a1\n a1", "1 22 333"]


def test_hits_against_a_plain_version(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id long, text string")
    for pattern, group in ((r"[0-9]+", 0), (r"([a-z])[0-9]", 1), (r"\n", 0)):
        got = {r["id"]: r["h"] for r in rows.select("id", grammar.hits(F.col("text"), pattern, group).alias("h")).collect()}
        for k, t in enumerate(TEXTS):
            want = None if t is None else [(m.start(), m[0], m[group]) for m in re.finditer(pattern, t)]
            assert (None if got[k] is None else [tuple(h) for h in got[k]]) == want, (t, pattern)


def test_matches_are_made_once(spark):
    rows = spark.createDataFrame([("a1",)], "text string")
    plan = rows.select(grammar.hits(F.col("text"), "([a-z])[0-9]", 1).alias("h"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2


def test_blocks_read_written_ranges(spark, sf_dir, monkeypatch):
    plan = catalog.QUERIES["bill_blocks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "regexp_extract_all" not in plan and bill_structure.AMEND not in plan
