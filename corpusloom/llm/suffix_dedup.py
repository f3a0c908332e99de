"""Operator 7: removal of repeated 100-byte strings by prefix-free parsing.

Parse. A rolling hash runs over every text. The trigger of a window (a start of a 100-byte
string) is the smallest hash of a GRAM-byte string inside it, the leftmost of equals, so equal
windows have their triggers at the same place. Consecutive windows with one trigger form a
phrase: its bytes begin at the first such window and end with the last one; neighbouring
phrases overlap by 99 bytes. Equal phrases have equal keys (trigger hash, content hash).

Dictionary. The first occurrence of a key, in corpus order, enters the dictionary; every window
of a later occurrence starts a repeated string. Repeats inside a task's block of texts are
settled there, so a frequent phrase sends one row per block, never one per document.

Suffix array. Two dictionary phrases can share a 100-byte string only if they share their trigger.
The phrases of triggers that stand in several phrases, and no others, come together by trigger;
there the dictionary's suffixes that hold a whole string are sorted by their bytes, as far as 100
(deeper order tells nothing here), and neighbours are compared byte by byte. Phrases overlap by
99 bytes, so every 100-byte string lies whole in a phrase and what follows in the parse is never needed
to order it; of the parse only the positions (doc_id, start) enter, which put each class of equal
suffixes in corpus order. All but the first are repeats. A trigger with more than CROWD phrases would
be one large task; its suffixes are dealt by the trigger's hash and one of the 100 bytes instead
(128 bits in all), as are phrases by the hashes of trigger and content.

Rows are phrases (one per 35 bytes or so), not bytes; suffixes are expanded only where a
trigger repeats in different surroundings, at the ends of repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, numbered, small_batches, stage

#: Length of a repeated string, and of the hashed strings among which its trigger is.
LENGTH = 100
GRAM = 32
#: Bytes of text whose repeats are settled together, and bytes that are hashed at a time, at most.
BLOCK = 1 << 23
STRETCH = 1 << 20
#: Dictionary phrases of one trigger up to which their suffixes are ordered in one task; beyond, each suffix is a row of its own.
CROWD = 512
#: Dictionary phrases whose suffixes are sorted together, about.
SORTED = 4096
_POSITION = np.uint64((1 << 25) - 1)

_MIX = np.random.default_rng(7).integers(1, 2**63, size=(16, 2), dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(70).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _join(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Hash of two neighbouring strings from theirs."""
    out = a * _MIX[level, 0]
    out += b * _MIX[level, 1]
    out ^= out >> np.uint64(29)
    return out


def window_hashes(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``gram``-byte and every ``length``-byte string of ``data`` (uint8)."""
    step, size, level = _BYTE[data], 1, 0
    whole: np.ndarray | None = None
    held, grams = 0, None
    while True:
        if size == gram:
            grams = step
        if length & size:  # the string's length in binary: its parts, from the smallest
            if whole is None:
                whole, held = step, size
            else:
                n = len(data) - held - size + 1
                whole, held = _join(step[:n], whole[size : size + n], 15 - level), held + size
        if size * 2 > max(length, gram):
            break
        n = len(data) - 2 * size + 1
        step, size, level = _join(step[:n], step[size : size + n], level), size * 2, level + 1
    return grams, whole


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbouring keys."""
    out, have = keys, 1
    while have * 2 <= width:
        out, have = np.minimum(out[: len(out) - have], out[have:]), have * 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


class Parsed:
    """Phrases of a block of texts: per phrase its text's index, first window, windows, trigger hash and content hash."""

    def __init__(self, texts: list[bytes], shift: list[int], length: int = LENGTH, gram: int = GRAM):
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        if len(data) < length:
            self.text = self.start = self.count = np.zeros(0, np.int64)
            self.trigger = self.content = np.zeros(0, np.uint64)
            return
        grams, self.whole = window_hashes(data, length, gram)
        keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        owner = (_sliding_least(keys, length - gram + 1) & _POSITION).astype(np.int64)
        # windows that lie inside one text
        valid = np.ones(len(owner), bool)
        for b, s in zip(begin.tolist(), sizes.tolist(), strict=True):
            valid[max(b, b + s - length + 1) : b + s] = False
        at = np.flatnonzero(valid)
        own = owner[at]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else at
        last = np.r_[first[1:] - 1, len(at) - 1] if len(at) else at
        lo, hi = at[first], at[last]
        self.at = lo
        self.text = np.searchsorted(begin, lo, side="right") - 1
        self.start = lo - begin[self.text] + np.asarray(shift, np.int64)[self.text]
        self.count = hi - lo + 1
        self.trigger = grams[own[first]]
        self.content = _join(_join(self.whole[lo], self.whole[hi], 0), (self.count + ((own[first] - lo) << 20)).astype(np.uint64), 1)


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(index, shift, bytes): the texts, long ones in stretches whose windows are disjoint."""
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), STRETCH):
            yield i, s, t[s : s + STRETCH + length - 1]


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[tuple[list, list[bytes]]]:
    """Texts with their ids, so many at a time."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        raw = batch.column("text").cast(pa.binary())
        for k, t in zip(batch.column("doc_id").to_pylist(), raw.to_pylist(), strict=True):
            ids.append(k)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where, in ranges sorted by (group, start), a new run begins; touching ranges run together."""
    if not len(group):
        return np.zeros(0, bool)
    new = np.r_[True, group[1:] != group[:-1]]
    reach = np.zeros(len(end), np.int64)
    shifted = end + group * (int(end.max()) + 1)  # groups ascend, so one running maximum serves all
    reach = np.maximum.accumulate(shifted) - group * (int(end.max()) + 1)
    new[1:] |= start[1:] > reach[:-1]
    return new


_PARSE = "h long, c long, doc_id long, start long, n int, repeat boolean"


def _parse(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            key = np.array(ids, np.int64)
            parts: list[tuple[np.ndarray, ...]] = []
            group, size = [], 0
            for piece in [*_stretches(texts, length), None]:
                if piece is None or size + len(piece[2]) > STRETCH + length:
                    if group:
                        p = Parsed([g[2] for g in group], [g[1] for g in group], length, gram)
                        parts.append((np.array([g[0] for g in group], np.int64)[p.text], p.start, p.count, p.trigger.view(np.int64), p.content.view(np.int64)))
                    group, size = [], 0
                if piece is not None:
                    group.append(piece)
                    size += len(piece[2])
            text, start, count, h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc = key[text]
            order = np.lexsort((start, doc, c, h))
            again = np.zeros(len(order), bool)
            again[1:] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
            first, rest = order[~again], order[again]
            # repeats inside the block, joined to runs of windows
            rest = rest[np.lexsort((start[rest], text[rest]))]
            new = _merged(text[rest], start[rest], start[rest] + count[rest])
            head = rest[new]
            ends = np.maximum.reduceat(start[rest] + count[rest], np.flatnonzero(new)) if len(rest) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[h[first], h[head] ^ doc[head] ^ (start[head] << 20)]), pa.array(np.r_[c[first], c[head]]), pa.array(np.r_[doc[first], doc[head]]),
                    pa.array(np.r_[start[first], start[head]]), pa.array(np.r_[count[first], ends - start[head]].astype(np.int32)), pa.array(np.r_[np.zeros(len(first), bool), np.ones(len(head), bool)]),
                ],
                ["h", "c", "doc_id", "start", "n", "repeat"],
            )

    return run


_SUFFIXES = "h long, w long, doc_id long, start long, n int, bytes binary, repeat boolean"


def _suffixes(length: int, gram: int):
    """For the dictionary phrases that a document holds first: their bytes, or the keys of their suffixes if their trigger is crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            few: list[tuple] = []
            many: list[tuple] = []
            for doc, text, phrases in zip(batch.column("doc_id").to_pylist(), raw, batch.column("phrases").to_pylist(), strict=True):
                data = text.as_py()
                crowded = sorted((p["start"], p["n"], p["h"]) for p in phrases if p["crowded"])
                few += [(p["h"], doc, p["start"], p["n"], data[p["start"] : p["start"] + p["n"] + length - 1]) for p in phrases if not p["crowded"]]
                if crowded:
                    many.append(_keys([(h, doc, s, n, data[s : s + n + length - 1]) for s, n, h in crowded], length, gram))
            if few:
                h, doc, start, n, raw = zip(*few, strict=True)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.nulls(k, pa.int64()), pa.array(doc), pa.array(start), pa.array(n, pa.int32()), pa.array(raw, pa.binary()), pa.array([False] * k)], _names(_SUFFIXES))
            if many:
                h, w, doc, pos = (np.concatenate(x) for x in zip(*many, strict=True))
                # of a suffix that the batch holds more than once, the first; the others repeat it
                order, again = _later(h, w, doc, pos)
                yield pa.RecordBatch.from_arrays([pa.array(h[order]), pa.array(w[order]), pa.array(doc[order]), pa.array(pos[order]), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.binary()), pa.array(again)], _names(_SUFFIXES))

    return run


def _keys(phrases: list[tuple], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(h, w, doc, start) of every suffix of phrases (h, doc, start, n, bytes)."""
    _, whole = window_hashes(np.frombuffer(b"".join(p[4] for p in phrases), np.uint8), length, gram)
    h, doc, start, n = (np.array(x, np.int64) for x in zip(*(p[:4] for p in phrases), strict=True))
    first = np.cumsum(n + length - 1) - (n + length - 1)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(h, n), whole[np.repeat(first, n) + step].view(np.int64), np.repeat(doc, n), np.repeat(start, n) + step


def _later(h: np.ndarray, w: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of key, then of the corpus; which of them follow an equal one."""
    order = np.lexsort((pos, doc, w, h))
    return order, np.r_[False, (h[order][1:] == h[order][:-1]) & (w[order][1:] == w[order][:-1])]


def suffix_array(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``data`` at the places ``at`` in order of their first ``length`` bytes, equal ones in the order given; which of them equal the one before."""
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    # All have one length, so that zero bytes at the end, which this type does not see, make no two of them equal.
    order = np.argsort(strings.view(f"S{length}").ravel(), kind="stable")
    ordered = strings[order]
    return order, np.r_[np.zeros(min(len(at), 1), bool), (ordered[1:] == ordered[:-1]).all(axis=1)]


def _settle(length: int):
    """Repeats among the suffixes of phrases that come sorted by trigger; a trigger's phrases stay together."""

    def told(phrases: list[tuple]) -> pa.RecordBatch:
        phrases.sort(key=lambda p: p[1:3])  # the parse's order
        doc, start, n = (np.array(x, np.int64) for x in zip(*(p[1:4] for p in phrases), strict=True))
        first = np.cumsum(n + length - 1) - (n + length - 1)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        doc, pos = np.repeat(doc, n), np.repeat(start, n) + step
        # phrases of one text overlap in the strings of no window, so (doc, pos) ascends
        order, again = suffix_array(np.frombuffer(b"".join(p[4] for p in phrases), np.uint8), np.repeat(first, n) + step, length)
        order = order[again]
        return pa.RecordBatch.from_arrays([pa.array(doc[order]), pa.array(pos[order]), pa.array(np.ones(len(order), np.int32))], ["doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "start", "n", "bytes")), strict=True):
                if len(held) >= SORTED and row[0] != held[-1][0]:
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of windows that start a repeated string: doc_id, start, n. ``docs`` has doc_id (long, not null) and text."""
    parsed = docs.mapInArrow(_parse(length, gram), _PARSE)
    phrases = parsed.withColumn("alike", F.expr("count(*) over (partition by h)")).where("repeat or alike > 1")
    placed = phrases.withColumns(
        {
            "place": F.expr("row_number() over (partition by h, c order by doc_id, start)"),
            "several": F.expr("min(c) over (partition by h) <> max(c) over (partition by h)"),
        }
    )
    told = placed.withColumn("repeat", F.expr("repeat or place > 1")).where("repeat or several")
    told = stage(told.select("h", "doc_id", "start", "n", "repeat", (F.col("alike") > CROWD).alias("crowded")), "phrases")
    asked = told.where("not repeat").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "h", "crowded")).alias("phrases"))
    suffixes = docs.join(asked, "doc_id").select("doc_id", "text", "phrases").mapInArrow(_suffixes(length, gram), _SUFFIXES)
    suffixes = stage(suffixes, "suffixes")
    few = suffixes.where("bytes is not null").select("h", "doc_id", "start", "n", "bytes").repartition("h").sortWithinPartitions("h")
    few = few.mapInArrow(_settle(length), "doc_id long, start long, n int")
    many = suffixes.where("bytes is null and not repeat").select("doc_id", "start", F.expr("row_number() over (partition by h, w order by doc_id, start)").alias("place")).where("place > 1")
    many = many.union(suffixes.where("repeat").select("doc_id", "start", F.lit(2)))
    return told.where("repeat").select("doc_id", "start", "n").union(few).union(many.select("doc_id", "start", F.lit(1)))


#: Column with a row's place in corpus order, a unique long; null for a row without id.
KEY = "_key"


def _placed(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with each row's place: its id, or a number in the order of ids and rows where ids are repeated."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    if ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.withColumn(KEY, F.col(id_col).cast("long"))
    rows = numbered(docs, "suffix-rows")
    order = rows.select(F.col(id_col).cast("long").alias("id"), ROW).where("id is not null").orderBy("id", ROW)
    places = stage(order.select(ROW, F.monotonically_increasing_id().alias(KEY)), "places")
    return rows.join(places, ROW, "left").drop(ROW)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("runs"), strict=True):
                data = text.as_py() or b""
                removed, spans, kept = 0, 0, data
                if runs.is_valid:
                    v = runs.values
                    start = v.field("start").to_numpy(zero_copy_only=False)
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], start[order] + v.field("n").to_numpy(zero_copy_only=False)[order] + length - 1
                    new = _merged(np.zeros(len(start), np.int64), start, end)
                    lo, hi = start[new], np.maximum.reduceat(end, np.flatnonzero(new))
                    removed, spans = int((hi - lo).sum()), len(lo)
                    kept = b"".join(data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True))
                rows.append((doc, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], _names(_RESULT))

    return run


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier in the corpus.

    Earlier: in a row with a smaller id, or in the same text at an earlier start; overlaps
    count, and strings are judged on the input. Returns one row per input row: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, and kept (the remaining bytes) if
    ``with_bytes``. Ids are integers; rows that share one are documents of their own, in any
    order among themselves. A row with a null id is returned uncut and
    takes no part in matching. A null text counts as empty; texts shorter than ``length`` stay
    whole. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    base = _placed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    known = base.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("doc_id"), "text")
    runs = repeated_windows(known, length, gram).groupBy(F.col("doc_id").alias(KEY)).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    out = base.join(runs, KEY, "left").select("doc_id", "text", "runs").mapInArrow(_cut(length, with_bytes), _RESULT)
    return out if with_bytes else out.drop("kept")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings removed from its texts, same columns.

    Bytes of a character that a cut divides are dropped with it. ``count_col``, where it
    exists, becomes the new text's number of characters. Rows that share an id are documents
    of their own; a row with a null id stays whole and takes no part. Columns may have any names but
    those that begin with an underscore here: ``_key``, ``_row``, ``_run_id`` and ``_runs``.
    """
    small_batches(docs.sparkSession)
    rows = _placed(docs, id_col)
    known = rows.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("doc_id"), F.col(text_col).alias("text"))
    runs = repeated_windows(known, length).groupBy(F.col("doc_id").alias("_run_id")).agg(F.collect_list(F.struct("start", "n")).alias("_runs"))

    @F.pandas_udf("string")
    def rest(texts, runs):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, r in zip(texts, runs, strict=True):
            if r is None or t is None:
                out.append(t)
                continue
            data = t.encode()
            gone = np.zeros(len(data) + 1, np.int32)
            for x in r:
                gone[x["start"]] += 1
                gone[x["start"] + x["n"] + length - 1] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            out.append(np.frombuffer(data, np.uint8)[keep].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    joined = rows.join(runs, F.col(KEY) == F.col("_run_id"), "left")
    out = joined.select(*[F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(rest(F.col(text_col), F.col("_runs"))).alias(c) if c == text_col else F.col(c) for c in docs.columns])
    if count_col and count_col in docs.columns:
        out = out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))
    return out


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole text, strings of 100 bytes."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: SQL would need a row for every byte; tests hold the query against a brute-force version.
SQL: dict[str, str] = {}
QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
