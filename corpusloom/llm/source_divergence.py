"""Operator 12: how far sources of one language diverge, by systolic rotation.

Each (language, source) group has a vector of counts over the language's kept terms. Terms are
dealt into slices of a bounded size, so a group's vector is cut into short, compressed pieces,
one per slice, and all sums over terms are sums over slices. Sources are seated at stations, SEATS
at each. A station's pieces stay in the partition of (language, slice, station); the pieces of the
other stations come past one at a time, in the rounds of a round-robin tournament: of M stations, i and j
meet in round (i + j) mod M, once, at the smaller of the two, and both directions are evaluated there.
A task holds one station's pieces and one visitor, whatever the number of rounds. The
language's own vector visits every station before the rounds; local heaps keep the terms that stand out most.

All arithmetic is on integers: p = 1 + floor(10^9 (count + 1) / (N + V)) of a term in a group with N
occurrences of V kept terms, and f = floor((p - q)^2 / q).
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, utf8

#: A term is kept if so many documents of its language hold it.
DOCUMENTS = 3
#: Terms that are reported per group at most (the feature's limit).
TOP = 200
#: Terms in a slice, on average at most, and sources at a station.
SLICE = 1 << 15
SEATS = 8
#: Entries that a counting task holds before it emits them.
HELD = 400_000

_TERMS = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of characters beyond ASCII, as UTF-8; these runs are the same on bytes and on characters."""
    return utf8(text).translate(_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, documents with it, occurrences), combined as far as one task goes."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in found.items():
            words = list(n)
            for k in range(0, len(words), 1 << 16):
                some = words[k : k + (1 << 16)]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([docs[w] for w in some], pa.int64()), pa.array([n[w] for w in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "n"])
        found.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            docs, n = found.setdefault((lang, source), (Counter(), Counter()))
            own = terms(text)
            n.update(own)
            docs.update(set(own))
        if sum(len(n) for _, n in found.values()) > HELD:
            yield from flush()
    yield from flush()


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, docs, n for every term of every group; nulls count as empty strings."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    return parts.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers and their counts, as gaps, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + n.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    size = len(raw) // 12
    return np.cumsum(np.frombuffer(raw[: 4 * size], "<u4").astype(np.int64)), np.frombuffer(raw[4 * size :], "<i8")


def probabilities(at: np.ndarray, n: np.ndarray, size: int, total: int, kept: int) -> np.ndarray:
    """p of every term of a slice of ``size`` terms; ``total`` occurrences of ``kept`` terms in all slices. Exact: 10^9 is multiplied in three steps."""
    x = np.ones(size, np.int64)
    x[at] += n
    p = np.zeros(size, np.int64)
    for _ in range(3):
        x *= 1000
        p = p * 1000 + x // (total + kept)
        x %= total + kept
    return p + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _meetings(top: int):
    """Stream the rows of a partition, sorted by (lang, slice, station, round): seats first, then the language, then visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        seats: list[tuple[str, np.ndarray, np.ndarray]] = []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                place = (r["lang"], r["slice"], r["host"])
                if place != here:
                    here, seats = place, []
                at, n = unpacked(r["data"]) if r["data"] is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                p = probabilities(at, n, r["size"], r["total"], r["kept"])
                if r["round"] == -2:
                    for other, _, q in seats:  # sources of one station meet as they sit down
                        out.append((*place[:2], r["source"], other, None, int(divergences(p, q).sum())))
                        out.append((*place[:2], other, r["source"], None, int(divergences(q, p).sum())))
                    seats.append((r["source"], at, p))
                elif r["round"] == -1:
                    for source, own, q in seats:
                        f = divergences(q[own], p[own])
                        over = np.flatnonzero(q[own] > p[own])
                        for k in heapq.nsmallest(top, over.tolist(), key=lambda k: (-f[k], k)) if len(over) > top else over.tolist():
                            out.append((*place[:2], source, None, int(own[k]), int(f[k])))
                else:
                    for source, _, q in seats:
                        out.append((*place[:2], source, r["source"], None, int(divergences(q, p).sum())))
                        out.append((*place[:2], r["source"], source, None, int(divergences(p, q).sum())))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "slice", "source", "other", "number", "value"])

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", documents: int = DOCUMENTS, top: int = TOP, slice_size: int = SLICE, seats: int = SEATS) -> DataFrame:
    """lang, source, part, item, value, rank: each source against each other one of its language, and its terms that stand out most.

    Part ``pair``: value is the sum of f over all kept terms, all ranks. Part ``term``: terms that occur in
    the source, with p above the language's; ``top`` ranks. Ranks count from 1 by value, descending, then by the item's bytes.
    Null text, lang and source count as empty strings; repeated rows count as often as they stand. A group without any kept term
    takes part with its smallest probabilities; in a language without kept terms all pairs have 0. Extra columns are not read.
    Texts are read whole, of any length. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    every = stage(counts(docs, text_col, lang_col, source_col), "term-counts")
    of_term = every.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= documents)
    of_term = stage(of_term.select("lang", "term", "n"), "kept-terms")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source")))).distinct()

    # languages: kept terms V, occurrences, slices; a language without kept terms has one empty slice
    langs = groups.select("lang").distinct().join(of_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total")), "lang", "left")
    langs = stage(langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total")).withColumn("slices", F.greatest(F.ceil(F.col("kept") / slice_size), F.lit(1)).cast("int")), "languages")
    numbered = of_term.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")).drop("slices")
    order = Window.partitionBy("lang", "slice").orderBy("term")
    numbered = stage(numbered.withColumn("number", (F.row_number().over(order) - 1).cast("int")), "term-numbers")
    sizes = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(numbered.groupBy("lang", "slice").agg(F.count("*").cast("int").alias("size")), ["lang", "slice"], "left").fillna(0, ["size"])

    @F.pandas_udf("binary")
    def piece(entries: pd.Series) -> pd.Series:
        return pd.Series([packed(np.array([e["number"] for e in x], np.int64), np.array([e["n"] for e in x], np.int64)) for x in entries], dtype=object)

    def pieces(rows: DataFrame, *keys: str) -> DataFrame:
        # a list is as long as a slice at most
        return rows.groupBy(*keys, "slice").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("x")).select(*keys, "slice", piece("x").alias("data"))

    own = every.select("lang", "term", "source", "n").join(numbered.select("lang", "term", "slice", "number"), ["lang", "term"])
    own = stage(own, "group-terms")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seated = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).withColumn("seat", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    seated = seated.join(langs.select("lang", "kept"), "lang").withColumn("station", F.floor(F.col("seat") / seats).cast("int"))
    seated = stage(seated.withColumn("stations", F.max("station").over(Window.partitionBy("lang")) + 1).drop("seat"), "seats")
    vectors = stage(seated.join(sizes, "lang").join(pieces(own, "lang", "source"), ["lang", "source", "slice"], "left"), "vectors")
    of_lang = langs.select("lang", "kept", "total").join(sizes, "lang").join(pieces(numbered, "lang"), ["lang", "slice"], "left")

    columns = ["lang", "slice", "size", "kept", "total", "source", "data"]
    residents = vectors.select(*columns, F.col("station").alias("host"), F.lit(-2).alias("round"))
    stations = seated.select("lang", F.col("station").alias("host")).distinct()
    overall = of_lang.join(stations, "lang").select(*(F.lit(None).cast("string").alias(c) if c == "source" else F.col(c) for c in columns), "host", F.lit(-1).alias("round"))
    visitors = vectors.where("station > 0").withColumn("host", F.explode(F.sequence(F.lit(0), F.col("station") - 1))).select(*columns, "host", F.expr("(host + station) % stations").alias("round"))
    floor = residents.unionByName(overall).unionByName(visitors).repartition("lang", "slice", "host").sortWithinPartitions("lang", "slice", "host", "round", "source")
    met = stage(floor.mapInArrow(_meetings(top), "lang string, slice int, source string, other string, number int, value long"), "meetings")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.where("other is not null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    told = met.where("number is not null").join(numbered.select("lang", "slice", "number", F.col("term").alias("item")), ["lang", "slice", "number"])
    told = told.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(told.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages of ``documents``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = {
    "op12_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT k) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL),
vectors AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + l.v) AS p, 1 + (1000000000::HUGEINT * (t.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN kept t USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, ((a.p - b.p) * (a.p - b.p)) // b.p AS f FROM vectors a JOIN vectors b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
summed AS (SELECT g.lang, g.source, h.source AS item, coalesce(p.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT lang, source, item, sum(f) AS value FROM pairs GROUP BY ALL) p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM summed
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM vectors WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS place FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 200
"""
}
QUERIES = {"op12_source_divergence": op12_source_divergence}
