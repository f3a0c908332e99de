"""Rows that repeat an id or have none are neither lost nor mixed up, in any stage."""

import random
from collections import Counter

from corpusloom.llm import exact_dedup, simhash_dedup, suffix_dedup

from .test_dedup import brute_cut

R = random.Random(9)
WORDS = [" ".join("".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(5)]
A, B, C, D, E = WORDS


def of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_exact_copies_keep_one_of_each_group(spark):
    rows = [(1, A), (1, A), (1, B), (2, A), (None, C), (None, D), (None, C), (3, C), (4, E)]
    kept = Counter(map(tuple, exact_dedup.drop_exact_copies(of(spark, rows)).collect()))
    assert kept == Counter([(1, A), (1, B), (3, C), (None, D), (4, E)])


def test_near_copies_keep_one_of_each_group(spark):
    rows = [(1, A), (1, A), (1, B), (2, A + " end"), (None, C), (None, D), (None, C + " end"), (3, C + " more"), (4, E)]
    kept = Counter(map(tuple, simhash_dedup.drop_near_copies(of(spark, rows)).collect()))
    assert kept == Counter([(1, A), (1, B), (3, C + " more"), (None, D), (4, E)])


def test_repeats_are_cut_in_later_rows_only(spark):
    rows = [(1, A), (1, A), (2, B), (2, C + B), (3, D), (None, D)]
    cut = suffix_dedup.cut_repeats(of(spark, rows)).collect()
    ones = sorted(r["text"] for r in cut if r["doc_id"] == 1)
    assert ones == ["", A]
    twos = sorted(len(r["text"]) for r in cut if r["doc_id"] == 2)
    assert twos in (sorted([len(B), len(C)]), sorted([0, len(C + B)]))
    assert [r["text"] for r in cut if r["doc_id"] in (3, None)] == [D, D]


def test_suffix_digests_of_repeated_rows(spark):
    got = suffix_dedup.suffix_dedup(of(spark, [(7, A), (7, A), (7, A), (8, B + A)])).collect()
    want = brute_cut([(0, A), (1, A), (2, A), (3, B + A)])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want.values())
