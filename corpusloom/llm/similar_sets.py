"""All pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, exactly.

Prefix filter. Shingles have one global order. Two sets of n and m shingles are that similar
only if the first n - ceil(0.8 n) + 1 of the one and the first m - ceil(0.8 m) + 1 of the other
have a shingle in common, so only these prefixes are exchanged. Any order gives the same pairs;
shingles that are frequent in a sample come last, so that prefixes hold rare ones. Sizes and the
places of the first common shingle rule out most pairs, and bitmaps of whole sets most of the rest; the
others are verified on whole sets.

Large groups. Candidates from elsewhere (SimHash components, see :mod:`simhash_dedup`) are verified first and
join most near copies. Then one row of each bucket (a shingle in several prefixes) of several groups
serves as its centre, the first in one of eight random orders, so a group has a few centres; every row is
held against those it meets most often, eight at most. After that only members of different groups are
compared, all of them, so no pair is left out that would join two groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, stage
from .components import connected_components
from .simhash_dedup import shingle_hashes

#: The least similarity, as a fraction: 4 / 5.
PART, WHOLE = 4, 5
#: Rows whose shingles are counted for the order, about, and frequent shingles that it puts last, at most.
SAMPLE, FREQUENT = 10_000, 20_000
#: Centres that a row is held against before all pairs across groups.
CENTRES = 8
#: Passes in which pairs are verified, at most, and bytes of sets that a pass moves, about.
SLICES, PASS = 4, 384 << 20
#: Longs of a set's bitmap.
LONGS = 8


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, ascending; a text without words has a shingle of its own kind, 0."""
    hashes = np.unique(shingle_hashes(text, words))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def _all_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    return run


def frequent_shingles(rows: DataFrame, words: int) -> list[int]:
    """Shingles of several rows of a sample, from the rarest to the most frequent; they bear on speed only."""
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    seen = rows.select("text").sample(share, seed=1).mapInArrow(_all_shingles(words), "h long")
    top = seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return [r["h"] for r in reversed(top)]


def _prefixes(words: int, last: list[int]):
    known = np.array(last, np.int64)
    by_hash = np.argsort(known)
    known = known[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingle_set(text, words).view(np.int64)
                n = len(own)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, by_hash[at], -1)
                    own = own[np.argsort(rank, kind="stable")]
                p = n - -(-PART * n // WHOLE) + 1
                parts.append((own[:p], np.full(p, row), np.arange(p, dtype=np.int32), np.full(p, n, np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["h", "row", "place", "n"])

    return run


def _possible(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles whose first common one is at i and j can be similar enough."""
    return (F.least(n, m) * WHOLE >= F.greatest(n, m) * PART) & (F.least(n - i, m - j) * (PART + WHOLE) >= (n + m) * PART)


def _verified(rows: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough, by their whole sets.

    Sets meet in up to SLICES passes over ranges of their hashes, whose common shingles add up, so that a pass moves a part of each set only.
    """
    names = [f"s{k}" for k in range(SLICES)]
    bounds = np.array([k * (2**64 // SLICES) for k in range(1, SLICES)], np.uint64)

    @F.pandas_udf(", ".join(["n int", *(f"{c} array<long>" for c in names)]))
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        sets = [shingle_set(t, words) for t in texts]
        cuts = [np.split(x.view(np.int64), np.searchsorted(x, bounds)) for x in sets]
        return pd.DataFrame({"n": [len(x) for x in sets], **{c: pd.Series([cut[k] for cut in cuts], dtype=object) for k, c in enumerate(names)}})

    counted = stage(pairs.distinct().select("a", "b", F.lit(0).alias("common"), F.lit(0).alias("all")), "candidates")
    asked = counted.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = stage(rows.join(asked, "row", "left_semi").select("row", of("text").alias("x")).select("row", "x.*"), "sets")
    # few passes where little is moved: their number bears on time and disk only
    longs, held = (x or 0 for x in sets.agg(F.sum("n"), F.count("*")).first())
    moved = 8 * longs * (2 + counted.count() / max(held, 1))
    step = max(SLICES // max(int(moved // PASS), 1), 1)
    for k in range(0, SLICES, step):
        part = F.concat(*names[k : k + step])
        left, right = (sets.select(F.col("row").alias(x), F.col("n").alias(f"{x}_n"), part.alias(f"{x}_set")) for x in "ab")
        common = F.col("common") + F.size(F.array_intersect("a_set", "b_set"))
        now = stage(counted.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.col("a_n") + F.col("b_n")).alias("all")), "counted")
        discard(counted)
        counted = now
    found = stage(counted.where(F.col("common") * (PART + WHOLE) >= F.col("all") * PART).select("a", "b"), "similar")
    discard(counted, sets)
    return found


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * LONGS bits whether an odd number of the set's shingles fall on it; two sets differ in at least as many shingles as their bitmaps in bits."""
    odd = np.bincount((shingles >> np.uint64(64 - (64 * LONGS - 1).bit_length())).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _bitmaps(rows: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """row and bits of the rows that ``asked`` names."""

    @F.pandas_udf("array<long>")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([bitmap(shingle_set(t, words)) for t in texts], dtype=object)

    return stage(rows.join(asked.select("row").distinct(), "row", "left_semi").select("row", of("text").alias("bits")), "bitmaps")


def _close(n: Column, x: Column, m: Column, y: Column) -> Column:
    """Whether the bitmaps x and y of sets of n and m shingles allow the similarity."""
    differ = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(LONGS)), F.lit(0))
    return differ * (PART + WHOLE) <= (n + m) * (WHOLE - PART)


def _centre(turn: int, *more: str) -> Column:
    """A bucket's centre: the least of its rows in one of CENTRES orders by hash, others each turn."""
    order = F.xxhash64("row", F.pmod("h", F.lit(CENTRES)) + F.lit(turn * CENTRES))
    return F.min(F.struct(order.alias("order"), "row", "place", "n", *more)).over(Window.partitionBy("h"))


def _most_met(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of a row and the centres (column other) that it meets most often, CENTRES a row at most."""
    often = met.groupBy("row", "other").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("times"), "other"))
    return often.withColumn("rank", place).where(F.col("rank") <= CENTRES).select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"))


def _mixed(met: DataFrame, groups: DataFrame) -> DataFrame:
    """Members, with their group's root, of the buckets that hold several groups."""
    rooted = met.select("h", "row", "place", "n").join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    several = rooted.withColumn("mixed", F.expr("min(root) over (partition by h) <> max(root) over (partition by h)")).where("mixed")
    return stage(several.drop("mixed"), "several")


def similar_groups(rows: DataFrame, candidates: DataFrame, words: int = 5) -> DataFrame:
    """Groups joined by pairs that are similar enough: node, root, for every row that is in such a pair.

    ``rows`` has row (a unique long) and text, and gives the same rows whenever it is read; ``candidates``
    (a, b) are pairs of rows to verify first, any or none. Shingles stand for themselves by 64-bit hashes.
    """
    small_batches(rows.sparkSession)
    entries = rows.mapInArrow(_prefixes(words, frequent_shingles(rows, words)), "h long, row long, place int, n int")
    met = stage(entries.withColumn("size", F.expr("count(*) over (partition by h)")).where("size > 1").drop("size"), "shared")
    links = _verified(rows, candidates, words)
    several = _mixed(met, stage(connected_components(links), "groups"))
    discard(met)
    near = _possible(F.col("n"), F.col("place"), F.col("least.n"), F.col("least.place"))
    star = several.withColumn("least", _centre(0, "root")).where((F.col("root") != F.col("least.root")) & near).select("row", F.col("least.row").alias("other"))
    links = links.union(_verified(rows, _most_met(star), words))
    last = _mixed(several, stage(connected_components(links), "groups"))
    discard(several)
    last = last.join(_bitmaps(rows, last, words), "row")
    l, r = last.alias("l"), last.alias("r")
    possible = _possible(F.col("l.n"), F.col("l.place"), F.col("r.n"), F.col("r.place")) & _close(F.col("l.n"), F.col("l.bits"), F.col("r.n"), F.col("r.bits"))
    across = l.join(r, F.col("l.h") == F.col("r.h")).where((F.col("l.root") < F.col("r.root")) & possible)
    links = links.union(_verified(rows, across.select(F.col("l.row").alias("a"), F.col("r.row").alias("b")), words))
    return connected_components(links)
