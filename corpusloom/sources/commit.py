"""Writing a corpus as one commit: a lock that expires, a sealed folder, two renames, and recovery from a writer that died at any point.

A build goes to ``<path>.new``. Its seal (a sidecar with the checksum of all its files) is written last, so a
folder whose seal fits its files is whole. Committing renames the live folder to ``<path>.old`` and the new one into
its place. Whoever takes the lock next first puts right what a dead writer left. Files are renamed and
locked by Hadoop's file systems; rows and checksums are worked out by Spark.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds after which a lock counts as left behind, and for which one that can't be read counts as being written.
EXPIRES, GRACE = 7200, 60
SEAL, REPORT, MANIFEST = "_corpus-meta.json", "_build-report.json", "_manifest.json"
#: What a failure means to whoever started the build.
EXIT = {"ok": 0, "args": 2, "fetch": 3, "parse": 4, "write": 5, "lock_held": 6, "recovery_refused": 7}
#: Kinds of failures, in the order in which a build meets them.
KINDS = {
    "manifest_invalid": "parse", "source_unreadable": "parse", "parse_aborted": "parse", "skip_gate_exceeded": "parse", "toc_coverage_failed": "parse", "citation_resolution_failed": "parse",
    "duplicate_section_ids": "parse", "unresolvable_def_id": "parse", "atomic_write_failed": "write", "corpus_meta_write_failed": "write", "atomic_write_lock_held": "lock_held", "atomic_write_recovery_refused": "recovery_refused",
}


class CommitError(RuntimeError):
    """A write that was refused: ``kind`` is one of KINDS."""

    def __init__(self, kind: str, reason: str) -> None:
        super().__init__(f"{kind}: {reason}")
        self.kind, self.reason = kind, reason


def exit_code(kinds: Iterable[str]) -> int:
    """The code of the first failure, 0 without one."""
    return next((EXIT[KINDS[k]] for k in kinds), EXIT["ok"])


class Folder:
    """A path with the renames and small files that a commit needs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, suffix: str = "") -> bool:
        return self.fs.exists(self._at(self.path + suffix))

    def age(self, suffix: str) -> float:
        return time.time() - self.fs.getFileStatus(self._at(self.path + suffix)).getModificationTime() / 1000

    def delete(self, suffix: str) -> None:
        self.fs.delete(self._at(self.path + suffix), True)

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self._at(self.path + a), self._at(self.path + b)):
            raise CommitError("atomic_write_failed", f"cannot rename {self.path}{a} to {self.path}{b}")

    def create(self, suffix: str, text: str, replace: bool = True) -> bool:
        """Write a small file; False if it is there and may not be replaced."""
        try:
            out = self.fs.create(self._at(self.path + suffix), replace)
        except Exception:  # the file system's own error
            if not replace and self.exists(suffix):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, suffix: str) -> str:
        stream = self.fs.open(self._at(self.path + suffix))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def acquire(folder: Folder, expires: float = EXPIRES, grace: float = GRACE) -> str:
    """Take the lock of a path and return its token. A lock that has expired is taken over."""
    for _ in range(2):
        token = uuid.uuid4().hex
        if folder.create(".lock", json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "since": time.time(), "token": token}), replace=False):
            return token
        try:
            held = json.loads(folder.read(".lock"))
            since = float(held["since"])
        except (ValueError, KeyError, TypeError):
            if folder.age(".lock") <= grace:
                raise CommitError("atomic_write_recovery_refused", f"{folder.path}.lock cannot be read and is new") from None
            folder.delete(".lock")
            continue
        if time.time() - since <= expires:
            raise CommitError("atomic_write_lock_held", f"{folder.path}.lock is held by {held.get('host')}/{held.get('pid')}")
        folder.delete(".lock")
    raise CommitError("atomic_write_lock_held", f"{folder.path}.lock is contended")


def release(folder: Folder, token: str) -> None:
    """Give the lock back, unless somebody else has it by now."""
    try:
        if json.loads(folder.read(".lock")).get("token") == token:
            folder.delete(".lock")
    except Exception:  # noqa: BLE001 - no lock to give back
        return


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and digests of all files under a folder but its seal, in order; files are read by tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"^.*?\Q" + path.rstrip("/").split("/")[-1] + r"\E/", "")
    rows = files.select(name.alias("name"), F.sha2("content", 256).alias("d")).where(~F.col("name").rlike(r"(^|/)(\.[^/]*\.crc|_SUCCESS)$") & (F.col("name") != SEAL))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\n", "name", "d"))), "\n"), 256)).first()[0]


def sealed(folder: Folder, suffix: str = "") -> bool:
    """Whether a folder has a seal that fits its files."""
    try:
        stored = json.loads(folder.read(f"{suffix}/{SEAL}"))["checksum"]
    except Exception:  # noqa: BLE001 - absent or broken
        return False
    return stored == checksum(folder.spark, folder.path + suffix)


def recover(folder: Folder) -> None:
    """Put right what a dead writer left: an old table without a live one comes back, a sealed new one goes live, an unsealed one is deleted."""
    if folder.exists(".old"):
        if folder.exists():
            folder.delete(".old")
        else:
            folder.rename(".old", "")
    if folder.exists(".new"):
        if sealed(folder, ".new"):
            _swap(folder, lambda phase: None)
        else:
            folder.delete(".new")


def _swap(folder: Folder, at: Callable[[str], None]) -> None:
    if folder.exists():
        folder.rename("", ".old")
    at("old moved")
    folder.rename(".new", "")
    at("new moved")
    folder.delete(".old")


def commit(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], meta: Mapping[str, object] | None = None, partition: Mapping[str, str] | None = None, files: Mapping[str, object] | None = None, at: Callable[[str], None] = lambda phase: None) -> dict:
    """Replace the corpus at ``path`` by ``tables`` (one folder each) and small JSON ``files``, in one commit; returns its seal.

    ``partition`` names a table's column to write folders by. An empty first table is refused. ``at`` is told each phase
    (locked, written, sealed, old moved, new moved). Readers see the former corpus until the last rename but one.
    """
    folder = Folder(spark, path)
    token = acquire(folder)
    try:
        at("locked")
        recover(folder)
        folder.delete(".new")
        for name, rows in tables.items():
            own = (partition or {}).get(name)
            writer = (rows.repartition(own, F.pmod(F.xxhash64(*[c for c in rows.columns if c != own]), F.lit(16))) if own else rows).write
            (writer.partitionBy(own) if own else writer).parquet(f"{path}.new/{name}")
        first = next(iter(tables))
        if spark.read.parquet(f"{path}.new/{first}").isEmpty():
            folder.delete(".new")
            raise CommitError("atomic_write_failed", f"{first} is empty")
        for name, content in (files or {}).items():
            folder.create(f".new/{name}", json.dumps(content, sort_keys=True))
        at("written")
        seal = {**(meta or {}), "checksum": checksum(spark, f"{path}.new"), "tables": sorted(tables)}
        folder.create(f".new/{SEAL}", json.dumps(seal, sort_keys=True))
        at("sealed")
        if not sealed(folder, ".new"):
            folder.delete(".new")
            raise CommitError("atomic_write_recovery_refused", f"the seal of {path}.new does not fit")
        _swap(folder, at)
        return seal
    finally:
        release(folder, token)


def distributed_manifest(jurisdiction: str, module: Mapping[str, object]) -> dict:
    """What of a module's manifest goes with the corpus: display rules and skip counts stay behind."""
    always = ("id", "name", "code_title", "module_version", "citation_patterns", "defined_term_patterns")
    sometimes = ("jd_anchor", "min_section_count", "global_definer_sections")
    return {"jurisdiction": jurisdiction, **{k: module[k] for k in always}, **{k: module[k] for k in sometimes if module.get(k) is not None}}


def build_corpus(spark: SparkSession, path: str, sections: DataFrame, definitions: DataFrame, unresolved: DataFrame, violations: DataFrame, manifests: Iterable[Mapping[str, object]], jurisdiction: str, snapshot_at: str, only: Iterable[str] = (), at: Callable[[str], None] = lambda phase: None) -> dict:
    """Gate a corpus and commit what passes: the report (valid, errors by kind and module, sections by module, exit code).

    ``violations``: module_id, kind (of KINDS), n. Modules that repeat section ids or exceed their skips are not written; those with
    other failures are, and the report says so. With ``only``, just these modules are kept and no report is written. If nothing is
    left the commit is refused.
    """
    chosen = list(only)
    kept = (lambda df: df.where(F.col("module_id").isin(chosen))) if chosen else (lambda df: df)
    found = kept(violations).groupBy("module_id", "kind").agg(F.sum("n").alias("n")).collect()  # modules times kinds
    unknown = {r["kind"] for r in found} - KINDS.keys()
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    order = list(KINDS)
    errors = sorted(({"kind": r["kind"], "module_id": r["module_id"], "n": int(r["n"])} for r in found), key=lambda e: (order.index(e["kind"]), e["module_id"] or ""))
    refused = sorted({e["module_id"] for e in errors if e["kind"] in ("duplicate_section_ids", "skip_gate_exceeded")})
    good = kept(sections).where(~F.col("module_id").isin(refused)) if refused else kept(sections)
    built = {r["module_id"]: r["n"] for r in good.groupBy("module_id").agg(F.count("*").alias("n")).collect()}
    report = {"valid": not errors, "snapshot_at": snapshot_at, "modules_built": sorted(built), "sections": built, "refused": refused, "errors": errors, "exit_code": exit_code(e["kind"] for e in errors)}
    if not built:
        raise CommitError("atomic_write_failed", "no section is left to write")
    files = {MANIFEST: [distributed_manifest(jurisdiction, m) for m in manifests if m["id"] in built]} | ({} if chosen else {REPORT: report})
    tables = {"sections": good, "definitions": kept(definitions), "unresolved_references": kept(unresolved)}
    meta = {"jurisdiction": jurisdiction, "snapshot_at": snapshot_at, "modules": sorted(built)}
    report["checksum"] = commit(spark, path, tables, meta, {"sections": "module_id"}, files, at)["checksum"]
    return report


def text_snapshot(sections: DataFrame) -> DataFrame:
    """Texts by ``module::id``, in order."""
    return sections.select(F.concat_ws("::", "module_id", "section_id").alias("ref"), "text").orderBy("ref")
