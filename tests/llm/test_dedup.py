"""Exact, near, suffix and embedding dedup against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from corpusloom.llm import components, embedding_dedup, exact_dedup, simhash_dedup, suffix_dedup

from .conftest import ODD, sha

WORDS = ["tion", "ther", "é", "und", "la", "re", "x"]


def texts(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(WORDS) for _ in range(r.randint(1, 3)))
    passages = [" ".join(word() for _ in range(r.randint(15, 60))) for _ in range(6)]
    out = list(ODD)
    for _ in range(n):
        parts = [r.choice([r.choice(passages)[r.randrange(40) :], " ".join(word() for _ in range(r.randint(1, 40)))]) for _ in range(r.randint(0, 5))]
        out.append(" ".join(parts))
    out += [out[-1] + " end", out[-1].replace(" ", "\n"), out[-2] + " end"]
    r.shuffle(out)
    return out


def test_exact_against_sql(spark, make, tmp_path):
    df = make(texts(1))
    df.write.parquet(str(tmp_path / "documents"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = sorted(c.execute(exact_dedup.SQL["op1_exact_dedup"]).fetchall())
    assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect())) == want
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [w[0] for w in want if w[3]]


def test_chunks_concatenate_and_resist_edits(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghijs. ") for _ in range(40_000)).replace(" ", "")
    rows = spark.createDataFrame([(1, base), (2, base[:20_000] + "inserted" + base[20_000:])], "k long, norm string")
    got = {x["k"]: x["c"] for x in rows.select("k", exact_dedup.chunks(rows["norm"]).alias("c")).collect()}
    assert "".join(got[1]) == base
    assert len(set(got[1]) - set(got[2])) <= 3 < len(got[1])


def test_exact_null_id_and_empty_table(spark, make):
    df = spark.createDataFrame([(None, "long  text"), (3, "longtext"), (3, "longtext")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(df).collect()} == {(None, None, 3), (3, None, 3)}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def fingerprint(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    counts = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, make):
    t = texts(2, 60)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_dedup(make(t)).collect()}
    fp = {k: fingerprint(x, 3) for k, x in enumerate(t)}
    want = brute_components(fp, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    assert got == {k: (f"{fp[k]:016x}", want[k]) for k in fp}
    assert simhash_dedup.simhash_dedup(make([])).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_of_close_fingerprints(spark, monkeypatch, hot, distance):
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(25)} | {0, 1, 2**64 - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_dedup.links_within(spark.createDataFrame([(s,) for s in signed], "fp long"), distance)
    roots = {x["node"]: x["root"] for x in components.connected_components(links).collect()}
    want = brute_components(signed, lambda i, j: ((i ^ j) & (2**64 - 1)).bit_count() <= distance)
    assert {s: roots.get(s, s) for s in signed} == want


def test_thresholds_take_the_cheapest_way():
    cost, chosen = simhash_dedup.allocate([[0, 5, 9, 20], [0, 1, 2, 30], [0, 50, 60, 70]], 0)
    assert sum(chosen) == 0 and chosen == [0, 1, -1] and cost == 7


def brute_cut(rows, length=100):
    seen, out = set(), {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(b[p : p + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(kept))
    return out


@pytest.mark.parametrize("crowd", [512, 1])
def test_suffixes_against_brute_force(spark, make, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    t = texts(4, 80)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(make(t)).collect()}
    assert got == brute_cut(enumerate(t))


def test_suffix_rows_without_id_or_rows(spark, make):
    long = "abcdefghij" * 30
    df = spark.createDataFrame([(None, long), (1, "x" * 99)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {None: (300, 0), 1: (99, 0)}
    assert suffix_dedup.suffix_dedup(make([])).count() == 0


def test_cut_texts_match_the_digests(spark, make):
    t = [x for x in texts(6, 40) if x is None or x.isascii()]
    digests = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.suffix_dedup(make(t)).collect()}
    cut = suffix_dedup.cut_repeats(make(t))
    assert cut.columns == make(t).columns
    for r in cut.collect():
        assert sha((r["text"] or "").encode()) == digests[r["doc_id"]]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_long_texts_in_stretches(monkeypatch):
    r = random.Random(8)
    data = bytes(r.choice(b"abcd ") for _ in range(5_000))
    whole = suffix_dedup.Parsed([data], [0])
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    parts = list(suffix_dedup._stretches([data], 100))
    split = suffix_dedup.Parsed([p[2] for p in parts], [p[1] for p in parts])
    cover = lambda p: sorted(x for s, n in zip(p.start.tolist(), p.count.tolist()) for x in range(s, s + n))
    assert cover(whole) == cover(split) == list(range(4_901))


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 5: 5, **{k: 5 for k in range(200, 260)}}


def vectors(seed=1):
    g = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for c in g.normal(size=(12, 16)):
            rows += [(label, (c + g.normal(size=16) * s).astype(np.float32).tolist()) for s in (0.0, 0.05, 0.2, 0.3, 0.35)]
    rows += [(0, None), (0, []), (0, [0.0] * 16), (0, [float("nan")] * 16), (0, [float("inf")] * 16), (0, [None] * 16), (1, [1.0, 2.0])]
    return [(k, v, label) for k, (label, v) in enumerate(rows)]


@pytest.mark.parametrize("shard", [8192, 20])
def test_embeddings_against_all_pairs(spark, shard):
    rows = vectors()
    unit = {}
    for k, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.asarray(v, np.float64)
            unit[k] = (label, x / np.linalg.norm(x))
    linked = lambda i, j: i in unit and j in unit and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= 0.93
    ids = [k for k, _, _ in rows]
    want = brute_components(ids, linked)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df, shard=shard).collect()}
    assert got == {i: (sum(linked(i, j) for j in ids if j != i), want[i], want[i] == i) for i in ids}
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_graph_recall():
    g = np.random.default_rng(3)
    v = g.normal(size=(3000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(v).build()
    queries = v[::10]
    ids, _ = graph.search(queries, 64)
    truth = np.argsort(-(queries @ v.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), truth.tolist())]) >= 0.9


def test_links_of_large_groups_over_several_shards(spark):
    """Groups of copies from 2 to 600 in six shards of one label: searches find nearly all links, and say so."""
    g = np.random.default_rng(5)
    sizes = [600, 200, 60, 30, *[2] * 40]
    centres = g.normal(size=(len(sizes), 32))
    v = np.concatenate([np.repeat(centres, sizes, axis=0), g.normal(size=(1500, 32))])
    v[: sum(sizes)] += 0.12 * g.normal(size=(sum(sizes), 32))
    v = v[g.permutation(len(v))]
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, shard=450).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    real = unit @ unit.T >= 0.93
    want = real.sum(axis=1) - 1
    found = np.array([got[k]["n_links"] for k in range(len(v))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    assert got[0]["recall"] >= 0.99


def test_components_of_a_link_matrix():
    g = np.random.default_rng(6)
    for _ in range(20):
        hit = g.random((40, 50)) < 0.015
        rows, cols = embedding_dedup._components(hit)
        names = brute_components(range(90), lambda i, j: i < 40 <= j and hit[i, j - 40])
        for i in range(40):
            assert (rows[i] < 0) == (not hit[i].any())
            for j in range(50):
                if rows[i] >= 0 and cols[j] >= 0:
                    assert (rows[i] == cols[j]) == (names[i] == names[40 + j])
