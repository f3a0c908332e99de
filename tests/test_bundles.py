"""Readers of definitions, bills and their index; what is not there has no rows."""

import json

import pytest

from corpusloom.sources import corpus


def test_absent_files_have_no_rows(spark, tmp_path):
    root = str(tmp_path)
    assert corpus.read_definitions(spark, root).count() == corpus.read_bills(spark, f"{root}/bills").count() == corpus.read_bills_index(spark, f"{root}/bills-index.json").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "definitions-v2.json").write_text(json.dumps([{"id": "m1/1#a", "term": "Tax", "scope": {"kind": "module"}}, {"id": "m1/2#b", "term": "Fee"}]))
    assert {(r.id, r.scope.kind if r.scope else None) for r in corpus.read_definitions(spark, str(tmp_path)).collect()} == {("m1/1#a", "module"), ("m1/2#b", None)}
    (tmp_path / "bills").mkdir()
    for n in ("20", "3", "100"):
        (tmp_path / "bills" / f"{n}.json").write_text(json.dumps({"file_no": n}))
    assert [r.file_no for r in corpus.read_bills(spark, str(tmp_path / "bills")).collect()] == ["100", "20", "3"]
    index = tmp_path / "bills-index.json"
    index.write_text(json.dumps({"bills": [{"file_no": "3", "section_ids": ["1.1"]}, {"file_no": "20"}]}))
    assert {(r.file_no, tuple(r.section_ids or ())) for r in corpus.read_bills_index(spark, str(index)).collect()} == {("3", ("1.1",)), ("20", ())}
    index.write_text('{"bills": [')
    with pytest.raises(Exception):
        corpus.read_bills_index(spark, str(index)).collect()


def test_session_bills(spark):
    listed = spark.createDataFrame([("1", "Ordinance"), ("2", " ORDINANCE "), ("3", "Resolution"), ("4", None), ("5", "ordinance")], "file_no string, type string")
    details = spark.createDataFrame([("1", "2025-01-01"), ("2", "2027-01-01"), ("5", "2026-12-31")], "file_no string, introduced_at string")
    chosen = lambda **k: sorted(r.file_no for r in corpus.session_bills(listed, details, "2025-01-01", "2026-12-31", **k).collect())
    assert chosen() == ["1", "5"] and chosen(limit=1) == ["5"]


def test_broken_promotion_is_put_back(spark, tmp_path):
    path, fresh = str(tmp_path / "t"), str(tmp_path / "t.new")
    spark.range(3).write.parquet(f"{path}.old")
    assert corpus.recover(spark, path) and not corpus.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    spark.range(5).write.parquet(fresh)
    corpus.promote(spark, fresh, path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()
