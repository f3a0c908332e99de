"""The pipeline's near-copy stage against brute-force Jaccard."""

import random
import re

import pytest

import corpus_pipeline
from corpusloom.llm import similar_sets

from .conftest import ODD
from .test_dedup import brute_components


def shingles(text, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def planted(seed):
    """Texts with copies that differ in so many words that similarities lie all over 0.5 to 1, at the limit too."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common = " ".join(word() for _ in range(30))
    out = list(ODD)
    for size in (5, 6, 8, 12, 40, 100, 300, 300):
        base = [word() for _ in range(size)]
        out.append(" ".join(base) + (" " + common if size == 40 else ""))
        for edits in range(1, 9):
            copy = list(base)
            for at in r.sample(range(size), min(size, 1 + edits * size // 250)):
                copy[at] = word()
            out += [" ".join(copy), " ".join(base[: size - edits]), " ".join([*base, *(word() for _ in range(edits))]), " ".join(copy) + " " + common]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("sample", [10_000, 0])
def test_near_copies_against_brute_force_jaccard(spark, make, monkeypatch, sample):
    monkeypatch.setattr(similar_sets, "SAMPLE", sample)
    t = planted(11)
    sets = {k: shingles(x) for k, x in enumerate(t)}
    want = brute_components(sets, lambda i, j: similar(sets[i], sets[j]))
    between = [(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j]) and 20 * len(sets[i] & sets[j]) < 19 * len(sets[i] | sets[j])]
    assert len(between) > 50
    df = make(t)
    kept = corpus_pipeline.without_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_large_group_and_outsiders(spark, make):
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    group = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(120)]
    others = [" ".join(base[:30] + [f"y{n}_{k}" for k in range(60)]) for n in range(20)]
    t = group + others
    r.shuffle(t)
    sets = {k: shingles(x) for k, x in enumerate(t)}
    want = set(brute_components(sets, lambda i, j: similar(sets[i], sets[j])).values())
    assert {x["doc_id"] for x in corpus_pipeline.without_near_copies(spark, make(t), "").collect()} == want
    assert len(want) == 21
