"""Commits that survive writers which die in any phase, locks, seals, gates and reports."""

import json
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import commit as K

PHASES = ("locked", "written", "sealed", "old moved", "new moved")


class Died(Exception):
    pass


def killer(phase):
    def at(now):
        if now == phase:
            raise Died(phase)

    return at


def rows(spark, n):
    return spark.range(n).select(F.expr("concat('m', id % 2)").alias("module_id"), F.col("id").cast("string").alias("section_id"), F.lit("t").alias("text"))


def count(spark, path):
    return spark.read.parquet(f"{path}/sections").count()


@pytest.mark.parametrize("phase", PHASES)
def test_a_dead_writer_is_put_right(spark, tmp_path, phase):
    path = str(tmp_path / "corpus")
    K.commit(spark, path, {"sections": rows(spark, 4)}, partition={"sections": "module_id"})
    with pytest.raises(Died):
        K.commit(spark, path, {"sections": rows(spark, 7)}, at=killer(phase))
    folder = K.Folder(spark, path)
    K.recover(folder)
    assert count(spark, path) == (4 if phase in ("locked", "written") else 7)
    assert K.sealed(folder) and not folder.exists(".new") and not folder.exists(".old") and not folder.exists(".lock")
    K.commit(spark, path, {"sections": rows(spark, 9)})
    assert count(spark, path) == 9


def test_old_moved_without_new(spark, tmp_path):
    path = str(tmp_path / "corpus")
    K.commit(spark, path, {"sections": rows(spark, 4)})
    folder = K.Folder(spark, path)
    folder.rename("", ".old")
    K.recover(folder)
    assert count(spark, path) == 4


def test_locks(spark, tmp_path):
    folder = K.Folder(spark, str(tmp_path / "c"))
    token = K.acquire(folder)
    with pytest.raises(K.CommitError) as e:
        K.commit(spark, folder.path, {"sections": rows(spark, 1)})
    assert e.value.kind == "atomic_write_lock_held" and K.exit_code([e.value.kind]) == 6
    K.release(folder, "another")
    assert folder.exists(".lock")
    K.release(folder, token)
    assert not folder.exists(".lock")
    folder.create(".lock", json.dumps({"since": time.time() - 8000, "token": "x"}))
    K.release(folder, K.acquire(folder))
    folder.create(".lock", "{broken")
    with pytest.raises(K.CommitError) as e:
        K.acquire(folder)
    assert e.value.kind == "atomic_write_recovery_refused"
    assert K.acquire(folder, grace=-1)


def test_seals_tell_changed_files(spark, tmp_path):
    path = tmp_path / "corpus"
    K.commit(spark, str(path), {"sections": rows(spark, 4)})
    folder = K.Folder(spark, str(path))
    assert K.sealed(folder)
    folder.create("/sections/part-x.parquet", "other")
    assert not K.sealed(folder)


def test_empty_tables_are_refused(spark, tmp_path):
    path = str(tmp_path / "corpus")
    K.commit(spark, path, {"sections": rows(spark, 4)})
    with pytest.raises(K.CommitError, match="empty"):
        K.commit(spark, path, {"sections": rows(spark, 0)})
    assert count(spark, path) == 4


def build(spark, path, violations, **more):
    manifests = [{"id": m, "name": m, "code_title": m, "module_version": "1", "citation_patterns": [], "defined_term_patterns": [], "display_rules": {"prefix": "b"}, "max_skip_count": 3, "jd_anchor": None} for m in ("m0", "m1")]
    none = spark.createDataFrame([], "module_id string, term string")
    found = spark.createDataFrame(violations, "module_id string, kind string, n long")
    return K.build_corpus(spark, path, rows(spark, 5), none, none, found, manifests, "xx", "2026-01-01", **more)


def test_gates_decide_what_is_written(spark, tmp_path):
    path = str(tmp_path / "corpus")
    report = build(spark, path, [("m1", "unresolvable_def_id", 2), ("m0", "duplicate_section_ids", 1), ("m1", "unresolvable_def_id", 1)])
    assert (report["valid"], report["refused"], report["sections"], report["exit_code"]) == (False, ["m0"], {"m1": 2}, 4)
    assert report["errors"] == [{"kind": "duplicate_section_ids", "module_id": "m0", "n": 1}, {"kind": "unresolvable_def_id", "module_id": "m1", "n": 3}]
    stored = json.loads((tmp_path / "corpus" / K.REPORT).read_text())
    assert stored["errors"] == report["errors"] and spark.read.parquet(f"{path}/sections").select("module_id").distinct().collect()[0][0] == "m1"
    (manifest,) = json.loads((tmp_path / "corpus" / K.MANIFEST).read_text())
    assert manifest["id"] == "m1" and not {"display_rules", "max_skip_count", "jd_anchor"} & manifest.keys()
    assert build(spark, path, [])["valid"] and K.exit_code([]) == 0
    assert build(spark, path, [("m1", "toc_coverage_failed", 1)], only=["m0"])["valid"] and not (tmp_path / "corpus" / K.REPORT).exists()
    with pytest.raises(K.CommitError, match="no section"):
        build(spark, path, [("m0", "skip_gate_exceeded", 1)], only=["m0"])
    assert [r["ref"] for r in K.text_snapshot(rows(spark, 3)).collect()] == ["m0::0", "m0::2", "m1::1"]
