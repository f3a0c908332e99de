"""Composed paths and what they answer when there is nothing."""

import pytest

from corpusloom.plans.api import BadInput, Corpus


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return Corpus.of(spark, sf_dir)


def told(corpus, path):
    rows = corpus.answer(path).collect()
    return rows[0] if rows else None


def test_answers_tell_what_is_missing(corpus):
    assert told(corpus, "/modules/src1/sections/1.0")["ok"]
    for path in ("/nowhere", "/modules/none", "/modules/src1/sections/999.9", "/bills/123456789", "/bills/123456789/impact"):
        assert (told(corpus, path)["ok"], told(corpus, path)["code"]) == (False, "not_found"), path
    bad = told(corpus, "/ordinances/1066")
    assert bad["code"] == "bad_input" and len(bad["issues"]) == 1 and told(corpus, "x" * 600)["code"] == "bad_input"
    with pytest.raises(BadInput):
        corpus.read("x" * 600)


def test_parts_of_dependencies(corpus):
    rows = corpus.read("/modules/src1/sections/1.0/dependencies").collect()
    assert {"outbound", "article", "bill", "term"} <= {r["part"] for r in rows}
    assert all((r["path"] is None) == (not r["installed"]) for r in rows)
    assert not [r for r in rows if r["part"] == "article" and (r["module_id"], r["section_id"]) == ("src1", "1.0")]
    assert corpus.read("/modules/src1/sections/999.9/dependencies").count() == 0
