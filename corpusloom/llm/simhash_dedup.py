"""Operator 2: SimHash near-dedup with generalised pigeonhole candidate search.

Fingerprints of all documents are reduced to distinct values. Correlated bits are grouped into
partitions; a dynamic programme gives each partition its own threshold t >= -1 with
sum(t) = max_distance - partitions + 1, at the least estimated cost. Two fingerprints within
max_distance then agree up to t on at least one partition, so equality joins on partition
values (and, for t > 0, on values within t bits) find every pair, which is verified.

Buckets of more than HOT fingerprints are not compared pairwise. Their members go through an
exact second way: two fingerprints differ in at most two bits exactly if their one-bit balls
meet, and all fingerprints whose balls share a point are pairwise within two bits. Each member
has 65 such points, a point at most 65 members, so one large group of near copies stays linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, numbered, small_batches, stage, utf8, without_others
from .components import connected_components

BITS = 64
#: Members of a bucket up to which it is compared pairwise.
HOT = 256
#: Numbers of partitions among which the cheapest is chosen.
PARTITIONS = (2, 3, 4)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle; a shorter text is one shingle, a text without words none."""
    w = utf8(text).lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if n <= words:
        spans = [joined]
    else:
        length = np.fromiter(map(len, w), np.int64, n)
        end = np.cumsum(length + 1) - 1
        begin = end - length
        spans = [joined[a:b] for a, b in zip(begin[: n - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in spans), np.uint64, len(spans))


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over word shingles; 0 for a text without words."""
    hashes = shingle_hashes(text, words)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * votes > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each pair of bits is set together, in one partition."""
    total = np.zeros((BITS, BITS), np.int64)
    for pdf in batches:
        bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += (bits.T @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pd.DataFrame({"i": i, "j": j, "n": total[i, j]})


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of each bit and absolute correlation of each two, over all of them."""
    got = distinct.select("fp").mapInPandas(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    n = distinct.count()
    both = np.zeros((BITS, BITS))
    for r in got:
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return n, share, np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal size: each grows from a free bit by the free bits most correlated with it."""
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        first = max(sorted(free), key=lambda b: sum(correlation[b, x] for x in free))
        own = [first]
        free.discard(first)
        while len(own) < size:
            best = max(sorted(free), key=lambda b: sum(correlation[b, x] for x in own))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t >= -1 that sum to ``budget`` at least cost; costs[i][t + 1] is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                cand = (cost + c, [*chosen, t])
                if used + t not in nxt or cand < nxt[used + t]:
                    nxt[used + t] = cand
        best = nxt
    return best[budget]


def plan_search(distinct: DataFrame, max_distance: int) -> tuple[list[list[int]], list[int]]:
    """Bit partitions and thresholds, from counts over all distinct fingerprints."""
    n, share, correlation = bit_statistics(distinct)
    options = {m: group_bits(correlation, m) for m in PARTITIONS}
    flat = [(m, i, bits) for m, groups in options.items() for i, bits in enumerate(groups)]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(_mask(bits)).alias("v")) for k, (_, _, bits) in enumerate(flat)])
    sizes = distinct.select(F.explode(keys).alias("p")).groupBy("p.k", "p.v").agg(F.count("*").alias("c"))
    # What a bucket costs: its pairs, or the points of its members' balls if that is less.
    got = {r["k"]: r["pairs"] for r in sizes.groupBy("k").agg(F.sum(F.least(F.expr("c * (c - 1.0) / 2"), F.expr(f"c * {BITS + 1}.0"))).alias("pairs")).collect()}
    found = []
    for m, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            pairs = float(got.get(next(k for k, f in enumerate(flat) if f[:2] == (m, i)), 0))
            differ = [2 * share[b] * (1 - share[b]) for b in bits]
            dist = [1.0]
            for p in differ:
                dist = [(dist[j] if j < len(dist) else 0) * (1 - p) + (dist[j - 1] * p if j else 0) for j in range(min(len(dist) + 1, 4))]
            row, probes = [0.0], 0
            for t in range(max_distance + 1):
                probes += math.comb(len(bits), t)
                row.append(n * (1 + probes) + pairs * sum(dist[: t + 1]) / max(dist[0], 1e-12))
            costs.append(row)
        found.append((*allocate(costs, max_distance - m + 1), m))
    _, thresholds, m = min(found)
    return options[m], thresholds


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def links_within(distinct: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links (a, b) that join every two fingerprints within ``max_distance`` bits, directly or through others that are.

    ``distinct`` has the column fp without repeats. max_distance is 0, 1 or 2.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance is 0, 1 or 2")
    groups, thresholds = plan_search(distinct, max_distance)
    entries = []
    for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        value = F.col("fp").bitwiseAND(_mask(bits))
        flips = [_signed(sum(1 << b for b in flip)) for r in range(1, t + 1) for flip in combinations(bits, r)]
        rows = F.array(F.struct(F.lit(i).alias("part"), value.alias("v"), F.lit(False).alias("probe")))
        if flips:
            rows = F.concat(rows, F.array(*[F.struct(F.lit(i).alias("part"), value.bitwiseXOR(F.lit(x)).alias("v"), F.lit(True).alias("probe")) for x in flips]))
        entries.append(rows)
    entered = distinct.select("fp", F.explode(F.concat(*entries)).alias("e")).select("fp", "e.*")
    buckets = entered.groupBy("part", "v").agg(F.count("*").alias("size"), F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("own")).where("size > 1 and own > 0")
    members = stage(entered.join(buckets.select("part", "v", (F.col("size") > HOT).alias("hot")), ["part", "v"]), "buckets")
    cold = members.where("not hot")
    left = cold.where("not probe").select("part", "v", F.col("fp").alias("a"))
    right = cold.select("part", "v", F.col("fp").alias("b"), "probe")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    pairs = left.join(right, ["part", "v"]).where(near & ((F.col("a") < F.col("b")) | (F.col("probe") & (F.col("a") != F.col("b"))))).select("a", "b")
    hot = members.where("hot").select("fp").distinct()
    return pairs.union(_ball_links(hot, max_distance))


def _ball_links(hot: DataFrame, max_distance: int) -> DataFrame:
    """Stars over the fingerprints that share a point of their balls."""
    ones: list[Column] = [F.lit(_signed(1 << b)) for b in range(BITS)]
    points = F.concat(F.array(F.lit(0).cast("long")), F.array(*ones)) if max_distance else F.array(F.lit(0).cast("long"))
    met = hot.select("fp", F.explode(points).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    if max_distance == 1:  # two in one ball may differ in two bits; only a centre is within one bit of all
        centre = met.join(hot.select(F.col("fp").alias("point")), "point")
        return centre.where("fp <> point").select(F.col("point").alias("a"), F.col("fp").alias("b"))
    shared = met.groupBy("point").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    return shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 2) -> DataFrame:
    """Near-duplicate components by SimHash: doc_id, fingerprint (hex), component_id, one row per input row.

    component_id is the smallest id reachable through fingerprints that differ in at most
    ``max_distance`` bits. A null text counts as empty; a text without words has fingerprint
    zero and links like any other. Null ids are never a component's name unless it has no
    other. Repeated rows come back as often as they are given. Other columns are ignored.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links_within(distinct.select("fp"), max_distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stage(named.join(names, "root").select("fp", "component_id"), "table")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(table, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, less near copies: one row stays of each group of similar texts.

    Texts are similar if their sets of word shingles have a Jaccard similarity of 0.8 or more. The components
    that :func:`simhash_dedup` finds are the first candidates, each row with its component's first, and are
    verified on whole sets. Fingerprints of 64 bits differ in ten bits on average at 0.8, so the pairs
    that they miss are found by an exact join after that, see :mod:`similar_sets`: all pairs count. The
    smallest id of a group stays, null ids last. Rows that repeat an id are told apart; columns may have
    any names but ``_row``. An empty table gives an empty one.
    """
    from .similar_sets import similar_groups

    rows = numbered(docs, "near-rows")
    texts = rows.select(F.col(ROW).alias("row"), F.col(text_col).alias("text"))
    found = simhash_dedup(texts, "row", "text", words)
    candidates = found.where("component_id <> doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    return without_others(rows, stage(similar_groups(texts, candidates, words), "similar-groups"), id_col)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: 3-word shingles, links at two bits or fewer."""
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: XXH64 is no DuckDB function; tests hold the query against a brute-force version.
SQL: dict[str, str] = {}
QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
