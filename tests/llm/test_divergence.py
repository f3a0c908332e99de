"""Operator 12 against a brute-force version in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def brute(rows, top=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", g or "", s or "") for t, g, s in rows):
        found = TERM.findall(text.translate(A_Z))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang, seen in docs.items():
        kept = sorted((t for t, n in seen.items() if n >= 3), key=str.encode)
        own = {s: [c[t] for t in kept] for (g, s), c in counts.items() if g == lang}
        overall = [sum(c[k] for c in own.values()) for k in range(len(kept))]
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        p, q = {s: share(c) for s, c in own.items()}, share(overall)
        for s in own:
            pairs = [(-sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])), o.encode(), o) for o in own if o != s]
            terms = [(-((x - y) ** 2 // y), t.encode(), t) for x, y, t, c in zip(p[s], q, kept, own[s]) if c and x > y]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], "text string, lang string, source string, value int, rank string").repartition(3)


def told(df):
    got = df.collect()
    assert len(got) == len(set(got))
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got}


@pytest.mark.parametrize(("slice_size", "seats"), [(5, 2), (1 << 15, 8)])
def test_audit_is_brute_force(spark, slice_size, seats):
    pick = random.Random(slice_size)
    vocabulary = ["Alpha", "beta", "Čas", "ß", "naïve", "x", "yy", "zebra", "ÉTÉ", "été", "漢字"]
    rows = [(" ".join(pick.choices(vocabulary, weights=range(1, 12), k=pick.randint(0, 30))) + "!1", pick.choice(["en", "fr", None, ""]), f"s{pick.randint(0, 8)}") for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", None), ("alpha " * 40_000, "en", "s1"), ("hapax", "xx", "a"), ("legomenon", "xx", "b")] + rows[:9]
    assert told(sd.audit(table(spark, rows), top=4, slice_size=slice_size, seats=seats)) == brute(rows, top=4)


def test_empty_table(spark):
    assert sd.audit(table(spark, []).limit(0)).collect() == []


def test_large_counts_are_exact():
    n = np.array([10**14, 3], np.int64)
    got = sd.probabilities(np.array([0, 2]), n, 3, 10**14 + 3, 3)
    assert got.tolist() == [1 + 10**9 * (x + 1) // (10**14 + 6) for x in (10**14, 0, 3)]
    assert [x.tolist() for x in sd.unpacked(sd.packed(np.array([0, 2]), n))] == [[0, 2], n.tolist()]
