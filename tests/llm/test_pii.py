"""Operator 11: patterns, decoding and gradients against plain versions, the model on held-out spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import pii, queries

from .conftest import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_are_the_patterns():
    pick = random.Random(4)
    texts = ["a@b.c a.b@c.d@e.f @x.y a@b a@b..c a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.0.255 1.2.3", "4111 1111-1111 1111 5500005555555559 4111111111111112", "+1 (415) 555-2671. +44 20 7946 0958 x+1 234", "é@a.b ß1.1.1.1"]
    texts += ["".join(pick.choices("ab1290.@-+ ()é\n", k=40)) for _ in range(3_000)] + ["4" * 16 + "".join(pick.choices("0123456789 -", k=8)) for _ in range(500)]
    for t in texts + [x or "" for x in ODD]:
        assert pii.base_spans(t) == brute(t)
    for long in ("a" * 200_000, "9" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "+1" * 50_000):
        pii.base_spans(long)  # linear in the text


def small(seed=0):
    rng = np.random.default_rng(seed)
    e, h, k = pii.EMBED, pii.STATE, len(pii.KINDS) + 1
    f = lambda *s: rng.normal(0, 0.4, s).astype(np.float32)
    return pii.Model(f(e, pii.CLASSES), f(2, 4 * h, e + h + 1), f(k, 2 * h + 1), f(k, k)), rng


def test_states_and_best_paths_are_plain():
    m, rng = small()
    ids = rng.integers(0, pii.CLASSES, (3, 5)).astype(np.uint8)
    states = m.states(ids)
    h = pii.STATE
    for w, row in enumerate(ids):
        for d, order in enumerate((range(5), range(4, -1, -1))):
            out, c = np.zeros(h), np.zeros(h)
            for t in order:
                z = m.gates[d].astype(float) @ np.concatenate([m.embed[:, row[t]], out, [1]])
                i, f, o, g = np.clip(z[:h], 0, 1), np.clip(z[h : 2 * h], 0, 1), np.clip(z[2 * h : 3 * h], 0, 1), np.clip(z[3 * h :], -1, 1)
                c = f * c + i * g
                out = o * np.clip(c, -1, 1)
                np.testing.assert_allclose(states[t, d * h : (d + 1) * h, w], out, atol=1e-5)
    scores = np.matmul(m.out, states)
    found = m.decoded(ids)
    for w in range(3):
        value = lambda p: sum(scores[t, p[t], w] for t in range(5)) + sum(m.moves[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(5), repeat=5), key=value)
        cuts = [0, *(t for t in range(1, 5) if best[t] != best[t - 1]), 5]
        assert [(x[1], x[2], x[3]) for x in found if x[0] == w] == [(best[a], a, b) for a, b in zip(cuts, cuts[1:]) if best[a]]


def test_gradients_and_loss():
    m, rng = small(1)
    ids, tags = rng.integers(0, pii.CLASSES, (4, 6)).astype(np.uint8), rng.integers(0, 5, (4, 6)).astype(np.int8)
    loss, grads = pii._gradient(m, ids, tags)
    scores = np.matmul(m.out, m.states(ids)).astype(float)
    plain = 0.0
    for w in range(4):
        value = lambda p: sum(scores[t, p[t], w] for t in range(6)) + sum(m.moves[a, b] for a, b in zip(p, p[1:]))
        plain += np.log(sum(np.exp(value(p)) for p in itertools.product(range(5), repeat=6))) - value(tags[w])
    assert loss == pytest.approx(plain / 4, rel=1e-4)
    for part, g in zip((m.embed, m.gates, m.out, m.moves), grads):
        for at in (np.unravel_index(k, g.shape) for k in np.argsort(-np.abs(g), axis=None)[:3]):
            kept = part[at]
            part[at] = kept + 1e-2
            up = pii._gradient(m, ids, tags)[0]
            part[at] = kept - 1e-2
            down = pii._gradient(m, ids, tags)[0]
            part[at] = kept
            assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=2e-2)


def test_reconciled_is_the_best_set():
    pick = random.Random(5)
    assert pii.reconciled([("ip", 0, 5, 1.0), ("ip", 5, 9, 3.0), ("card", 4, 20, 2.0)]) == [("ip", 0, 9)]
    for _ in range(200):
        spans = [(pick.choice(pii.KINDS), a, a + pick.randint(1, 6), float(pick.randint(1, 9))) for a in (pick.randint(0, 20) for _ in range(7))]
        joined = []
        for kind in pii.KINDS:
            for s in sorted(x for x in spans if x[0] == kind):
                if joined and joined[-1][0] == kind and s[1] <= joined[-1][2]:
                    joined[-1] = (kind, joined[-1][1], max(joined[-1][2], s[2]), max(joined[-1][3], s[3]))
                else:
                    joined.append(s)
        free = lambda c: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(c, 2))
        most = max(sum(x[3] for x in c) for n in range(len(joined) + 1) for c in itertools.combinations(joined, n) if free(c))
        got = pii.reconciled(spans)
        worth = {x[:3]: x[3] for x in joined}
        assert free(got) and sum(worth[x] for x in got) == most


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_spans(spark, model):
    """Spans planted into windows of other documents than the model's."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 5000 and doc_id < 6000").selectExpr("xxhash64(doc_id) as key", "text").toPandas()
    windows = pd.concat(pii._windows([rows]))
    ids, tags = pii.labelled([], windows[~windows["some"]]["text"].tolist()[:700], seed=99)
    gold = {(w, int(t), a, b) for w, row in enumerate(tags) for cut in [[0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]] for a, b in zip(cut, cut[1:]) if (t := row[a])}
    got = {x[:4] for x in model.decoded(ids)}
    assert len(gold) > 1_000 and len(gold & got) >= 0.9 * len(gold) and len(gold & got) >= 0.9 * len(got)


def test_disguised_spans_in_long_texts(spark, make, model):
    filler = "Die Stadt ist groß und der Weg lang. " * 40
    hidden = ["(415) 555-2671", "4111.1111.1111.1111", "10[.]0[.]0[.]12", "415-555-2671"]
    texts = [filler + h + ", " + filler for h in hidden] + [filler, "", None, "Mail a@b.org or call (415) 555-2671 now."]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in pii.found(make(texts).withColumnRenamed("kept", "spans"), model).collect()}
    found = sum(any(a <= len(filler) + 2 and b >= len(filler) + len(h) - 2 for _, a, b, _ in got[k]) for k, h in enumerate(hidden))
    assert found >= 3 and got[4] == got[5] == got[6] == [] and ("email", 5, 12, True) in got[7]
    told = {r["doc_id"]: r["text"] for r in pii.redacted(pii.found(make(texts), model)).collect()}
    assert told[4] == filler and told[6] is None and told[7].startswith("Mail <email> or")


def test_query_against_patterns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_personal_data"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        base = brute(text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[d]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(told.split(",")) <= set(got[d]["spans"].split(","))


def test_empty_table_and_odd_texts(spark, make):
    blank = pii.fit(make([]))
    assert pii.found(make([]), blank).collect() == []
    rows = pii.found(make(ODD), blank).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == [] for r in rows)
