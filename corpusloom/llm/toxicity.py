"""Operator 6: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of a text's letters (white space and signs become one space, ASCII
letters lower case), each counted once a text and hashed into BUCKETS. A feature's value is its
log-count ratio r = log of its share among positive over its share among negative texts, so a
feature that says nothing weighs nothing however long the text is. A logistic regression on
these values is fitted on a bounded sample of labelled rows (SAMPLE, a parameter).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, small_batches, stage, utf8

#: Bytes of the n-grams, hash buckets, labelled rows in the sample at most.
GRAMS = (4, 6)
BUCKETS = 1 << 20
SAMPLE = 16_000
#: Bytes of text in the sample, about, at most; beyond that a part of its rows is drawn by hash.
SAMPLE_BYTES = 96 << 20
#: A feature's count must stray from chance so far (one in ten thousand does so by chance); so many are kept anyhow.
STRAY, FEATURES_AT_LEAST = 15.0, 64
THRESHOLD = 0.3
#: Log-odds of every text where there is nothing to learn from.
NOTHING_LEARNED = -20.0

_LETTERS = bytes(b"abcdefghijklmnopqrstuvwxyz"[c - 65] if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_BYTE = np.random.default_rng(6).integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_M = np.random.default_rng(66).integers(1, 2**63, size=8, dtype=np.uint64) | np.uint64(1)


def grams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text, with repeats."""
    data = b" " + b" ".join(utf8(text).translate(_LETTERS).split()) + b" "
    one = _BYTE[np.frombuffer(data, np.uint8)]
    two = one[:-1] * _M[0] + one[1:] * _M[1]
    two ^= two >> np.uint64(31)
    if len(data) < GRAMS[0]:
        return np.zeros(0, np.int64)
    four = two[:-2] * _M[2] + two[2:] * _M[3]
    four ^= four >> np.uint64(31)
    six = four[:-2] * _M[4] + two[4:] * _M[5] if len(data) >= GRAMS[1] else four[:0]
    return (np.concatenate([four, six]) * _M[6] >> np.uint64(44)).astype(np.int64)


def grams_of(gram: bytes) -> np.ndarray:
    """The bucket of one n-gram, from its bytes; none for another length."""
    if len(gram) not in GRAMS:
        return np.zeros(0, np.int64)
    one = _BYTE[np.frombuffer(gram, np.uint8)]
    two = one[:-1] * _M[0] + one[1:] * _M[1]
    two ^= two >> np.uint64(31)
    out = two[:-2] * _M[2] + two[2:] * _M[3]
    out ^= out >> np.uint64(31)
    if len(gram) == GRAMS[1]:
        out = out[:-2] * _M[4] + two[4:] * _M[5]
    return (out * _M[6] >> np.uint64(44)).astype(np.int64)


@dataclass
class Model:
    """weight: log-count ratio times regression weight by bucket; zero for a bucket that is no feature."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = grams(text)
        found = found[self.weight[found] != 0]
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[np.unique(found)].sum(dtype=np.float64), -30, 30))))


def _presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of either label each bucket stands, in one partition."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            counts[int(label), np.unique(grams(text))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": at, "negative": counts[0, at].astype(np.int64), "positive": counts[1, at].astype(np.int64)})


def _solve(row: np.ndarray, col: np.ndarray, values: np.ndarray, labels: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on sparse rows: text ``row[k]`` has feature ``col[k]``; each feature has one value."""
    n = len(labels)
    w = np.zeros(len(values) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[:-1] = 0.05
    w[-1] = np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    for k in range(1, rounds + 1):
        z = np.bincount(row, (values * w[:-1])[col], minlength=n) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(values * np.bincount(col, off[row], minlength=len(values)) / n + ridge * w[:-1], off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows, those with the smallest hashes of their ids.

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1); null labels and ids are left out, and of
    repeated ids the larger label counts. A sample of more than SAMPLE_BYTES of text is thinned, so that what the driver holds
    does not grow with the texts. Without rows of both labels nothing can be learned and
    every text scores near zero, so that nothing is rejected without evidence. The sample's texts are written
    once; all that follows reads them there. Every n-gram of the sample whose counts stray from
    chance is a feature.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    # The sample's size is bounded by its limit, so it can be sent to every task.
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id")
    rows = stage(rows, "toxicity-sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        rows = rows.where(F.pmod(F.xxhash64("label_id", F.lit("drawn")), F.lit(1_000_000)) < SAMPLE_BYTES / size * 1_000_000)
    counts = rows.mapInPandas(_presence, "bucket int, negative long, positive long").groupBy("bucket").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
    n0, n1 = (int(x or 0) for x in rows.agg(F.sum(F.expr("1 - label")), F.sum("label")).first())
    weight = np.zeros(BUCKETS, np.float32)
    if not n0 or not n1:
        return Model(weight, NOTHING_LEARNED)
    p, q = (F.col("positive") + 0.5) / (n1 + 1.0), (F.col("negative") + 0.5) / (n0 + 1.0)
    # How far the counts stray from chance (the likelihood-ratio statistic of presence against label).
    share = (F.col("positive") + F.col("negative")) / (n0 + n1)
    cells = [(F.col("positive"), n1 * share), (F.col("negative"), n0 * share), (n1 - F.col("positive"), n1 * (1 - share)), (n0 - F.col("negative"), n0 * (1 - share))]
    stray = 2 * sum((F.when(seen > 0, seen * F.log(seen / chance)).otherwise(0.0) for seen, chance in cells), F.lit(0.0))
    told = stage(counts.select("bucket", F.log(p / q).alias("ratio"), stray.alias("stray")), "toxicity-features")
    best = told.where(F.col("stray") >= STRAY).orderBy("bucket").collect()  # BUCKETS at most
    if len(best) < FEATURES_AT_LEAST:
        best = told.orderBy(F.desc("stray"), "bucket").limit(FEATURES_AT_LEAST).collect()
    number = np.full(BUCKETS, -1, np.int32)
    number[[r["bucket"] for r in best]] = np.arange(len(best))
    ratio = np.array([r["ratio"] for r in best])

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at = number[grams(t)]
            out.append(np.unique(at[at >= 0]).tolist())
        return pd.Series(out, dtype=object)

    got = rows.select(features("text").alias("x"), "label").toArrow().combine_chunks()
    x = got.column("x").combine_chunks()
    x = x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)
    sizes = np.diff(x.offsets.to_numpy())
    w, bias = _solve(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), x.flatten().to_numpy(), ratio, got.column("label").to_numpy().astype(np.float64))
    weight[[r["bucket"] for r in best]] = ratio * w
    return Model(weight, bias)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score in 0 to 1 for every whole text; a null text scores as an empty one.

    Repeated rows come back as often as they stand, null ids too; a column of ``docs`` called ``score_col`` is
    replaced. An empty table gives an empty result.
    """

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.withColumn(score_col, of(F.col(text_col)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; labels of fold 2 of 4 are held out. Repeated rows come back as often as they stand."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 4) != 2)
    out = scored(docs, fit(docs, labels)).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


#: A fitted model has no SQL; tests hold features and scores against a plain version and the model against held-out labels.
SQL: dict[str, str] = {}
QUERIES = {"op6_toxicity": op6_toxicity}
