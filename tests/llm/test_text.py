"""Language, toxicity, packing, pieces, URLs and licences."""

import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import language_id, license_scan, nbest_pieces, packing, queries, suffix_dedup, toxicity, url_filter
from corpusloom.llm.common import stage
from corpusloom.llm.tokens import word_tokens

from .conftest import ODD


def test_language_on_held_out_rows(spark, sf_dir):
    got = queries.QUERIES["op3_language_id"](spark, sf_dir).collect()
    lang = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect())
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark, make):
    model = language_id.fit(make(["the cat and the dog"] * 3 + ODD))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(make(ODD), model).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[6][0] == "en"
    nobody = language_id.fit(make([]))
    assert {r["lang_pred"] for r in language_id.identified(make(["word"]), nobody).collect()} == {"und"}


def test_words_come_before_grams():
    entries = {(0, "the"): {0: -1.0, 1: -9.0}, (3, "<th"): {0: -8.0, 1: -2.0}, (1, "t"): {0: -5.0, 1: -6.0}}
    rows = sorted((language_id.key(n, e), logs) for (n, e), logs in entries.items())
    first = np.cumsum([0] + [len(logs) for _, logs in rows])
    floors = {n: np.full(2, -20.0, np.float32) for n in (0, *language_id.LENGTHS)}
    lang, log = (np.array(x) for x in zip(*((g, v) for _, logs in rows for g, v in logs.items())))
    m = language_id.Model(["a", "b"], np.array([k for k, _ in rows]), first, lang, log.astype(np.float32), floors)
    assert [x[0] for x in m.predict(["the", "thou", "xt", None, "12 ²"])] == ["a", "b", "a", "und", "und"]


def test_marks_belong_to_words():
    assert language_id.words("हिन्दी ภาษาไทย cafe\u0301 CAFÉ x²y \u0301 می‌خواهم") == {"हिन्दी": 1, "ภาษาไทย": 1, "café": 2, "x": 1, "y": 1, "می‌خواهم": 1}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_toxicity"](spark, folder).collect()}
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect())
    held = [k for k in labels if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert all(got[k]["predicted"] == int(got[k]["score"] >= 0.3) for k in got)
    found = [labels[k] for k in held if got[k]["predicted"]]
    assert np.mean(found) >= 0.95 and sum(found) >= 0.85 * sum(labels[k] for k in held)


def test_toxicity_against_a_plain_version(spark, make):
    """Features by counting every n-gram of every text, and scores by summing their weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    texts = dict(docs.collect())
    marked = [(texts[d], int(t)) for d, t in labels.collect() if d in texts]
    n = [sum(t == k for _, t in marked) for k in (0, 1)]
    seen = defaultdict(lambda: [0, 0])
    own = {}
    for text, toxic in marked:
        plain = b" " + b" ".join(toxicity.utf8(text).translate(toxicity._LETTERS).split()) + b" "
        own[text] = {int(b) for size in toxicity.GRAMS for k in range(len(plain) - size + 1) for b in toxicity.grams_of(plain[k : k + size])}
        for b in own[text]:
            seen[b][toxic] += 1
    stray = {}
    for b, (neg, pos) in seen.items():
        share = (neg + pos) / sum(n)
        cells = ((pos, n[1] * share), (neg, n[0] * share), (n[1] - pos, n[1] * (1 - share)), (n[0] - neg, n[0] * (1 - share)))
        stray[b] = 2 * sum(x * np.log(x / e) for x, e in cells if x > 0)
    features = {b for b, s in stray.items() if s >= toxicity.STRAY}
    assert len(features) >= toxicity.FEATURES_AT_LEAST
    weighed = set(np.flatnonzero(model.weight).tolist())
    assert weighed <= features and len(features - weighed) <= 0.01 * len(features)
    for text, _ in marked[:60]:
        z = model.bias + sum(float(model.weight[b]) for b in own[text])
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6)


def test_toxicity_sample_is_bounded_in_bytes(spark, make, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2_000)
    docs = make(["bad stupid words here " * 5, "good kind words there " * 5] * 100)
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 2 = 0) as toxic"))
    assert model.score("bad stupid words here") > 0.5 > model.score("good kind words there")


def test_toxicity_without_labels_or_text(spark, make):
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(make(ODD), labels)
    assert max(r["score"] for r in toxicity.scored(make(ODD), model).collect()) < 1e-6
    assert toxicity.scored(make([]), model).count() == 0


def test_tokens_are_the_librarys():
    t = word_tokens()
    texts = [x or "" for x in ODD] + ["ΑΣ ΣΑΣ x²½ ①", "İstanbul ŉ ǅ", "a\x1cb\x85c\xa0d '́e é <|endoftext|> it's I'LL", "ª º µ ÀÈ̀", "\r\n\t a  b"]
    for text, ids in zip(texts, t.encode_all(texts)):
        assert ids.tolist() == t.library.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts):
    ids = {k: np.append(word_tokens().encode(t or ""), 2).astype("<u4") for k, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[k])
            assert zlib.crc32(ids[k][at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[k])
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    return by_seq


def test_packing_every_token_once(spark, make):
    texts = ODD + ["some words " * 700, "more of them " * 900]
    rows = packing.pack(make(texts), window=8192).collect()
    by_seq = check_pieces(rows, list(enumerate(texts)))
    assert set(by_seq) == set(range(len(by_seq)))
    assert packing.pack(make([])).count() == 0


def round_robin(totals, targets, window):
    """Deficit round-robin carried out window by window in fractions: tokens served after each full one, and the deficits."""
    left = {s: Fraction(t) for s, t in totals.items()}
    credit, served = dict.fromkeys(totals, Fraction(0)), dict.fromkeys(totals, 0)
    quantum = Fraction(window)
    while live := [s for s in totals if left[s]]:
        whole = sum(targets[s] for s in live)
        step = min([quantum / whole, *(left[s] / targets[s] for s in live)])  # until the window is full or a queue is dry
        for s in live:
            credit[s] += targets[s] * step
            left[s] -= targets[s] * step
        quantum -= whole * step
        if not quantum:
            for s in totals:
                served[s] += int(credit[s])
                credit[s] -= int(credit[s])
            yield dict(served), dict(credit)
            quantum = Fraction(window)


def test_mixture_is_a_deficit_round_robin():
    r = random.Random(12)
    for _ in range(30):
        totals = {f"s{k}": r.choice([0, 1, 7, 500, r.randint(1, 20_000)]) for k in range(r.randint(1, 9))}
        targets = {s: r.randint(1, 40) for s in totals}
        m = packing.Mixture(totals, targets, 997)
        for k, (served, deficit) in enumerate(round_robin(totals, targets, 997), 1):
            assert dict(zip(m.names, m.served(k).tolist(), strict=True)) == served
            assert all(abs(d - float(deficit[s])) < 1e-4 or k == m.windows for s, d in zip(m.names, m.deficit(k), strict=True))
        assert m.served(m.windows).tolist() == [totals[s] for s in m.names] and not m.served(0).any()


def test_windows_hold_the_mixture(spark):
    totals = {"a": 60_000, "b": 30_000, "c": 10_000, "d": 0}
    m = packing.Mixture(totals, None, 1000)
    for k in range(m.windows):
        assert (m.served(k + 1) - m.served(k)).tolist() == [600, 300, 100, 0]
    equal = packing.Mixture(totals, {"a": 1, "b": 1}, 1000)
    assert equal.served(10).tolist() == [5_000, 5_000, 0, 0]
    assert equal.served(equal.windows).tolist() == [60_000, 30_000, 10_000, 0]
    for queue, position in (("a", 0), ("a", 59_999), ("b", 29_999), ("c", 0), ("c", 9_999)):
        q = equal.number[queue]
        k = equal.window_of(q, position)
        assert equal.served(k)[q] <= position < equal.served(k + 1)[q]


def test_many_queues_keep_their_shares():
    totals = {f"s{k}": 1 + k % 5_000 for k in range(50_000)}
    m = packing.Mixture(totals, {s: 1.0 for s in totals})
    last = np.zeros(len(totals), np.int64)
    for k in range(0, m.windows, 97):
        served = m.served(k)
        assert (served >= last).all() and abs(int(served.sum()) - k * packing.WINDOW) <= len(totals)
        live = served < m.total - 1
        assert served[live].max(initial=0) - served[live].min(initial=1 << 60) <= 1
        last = served


def test_best_segmentations_are_the_best():
    p, r = nbest_pieces.pieces(), random.Random(2)

    def every(word):
        out, todo = [], [(0, 0.0, ())]
        while todo:
            at, score, ids = todo.pop()
            if at == len(word):
                out.append((score, ids))
                continue
            for end in range(at + 1, len(word) + 1):
                if word[at:end] in p.table:
                    todo.append((end, score + p.table[word[at:end]][0], (*ids, p.table[word[at:end]][1])))
            if word[at] not in p.table:
                todo.append((at + 1, score + p.unknown, (*ids, *(p.byte_ids[b] for b in word[at].encode()))))
        return sorted(out, reverse=True)

    for text in ["the cat", "é x", "a\nb", "foo  bar", "日本 x", *("".join(r.choice("abe tion\n") for _ in range(8)) for _ in range(40))]:
        got = p.encode(text)
        want = every(nbest_pieces.MARK + text.replace(" ", nbest_pieces.MARK))
        assert [s for s, _, _ in got] == [s for s, _ in want[: len(got)]] and len(got) == min(p.n, len(want))
        assert len({i for _, i, _ in got}) == len(got)
        assert all(same and p.decode(ids) == text for _, ids, same in got)


def test_segmentations_of_odd_texts(spark, make):
    found = nbest_pieces.nbest_segmentations(make(ODD))
    texts = {(r["doc_id"], r["rank"]): r["text"] for r in nbest_pieces.decoded(found).collect()}
    assert all(texts[k, 1] == (t or "") for k, t in enumerate(ODD))
    assert nbest_pieces.nbest_segmentations(make([])).count() == 0


def test_urls_against_sql_and_odd_ones(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(map(tuple, url_filter.op8_url_filter(spark, sf_dir).collect())) == sorted(c.execute(url_filter.SQL["op8_url_filter"]).fetchall())
    urls = [None, "nope", "HTTP://A.B.Co.uk:80?x", "http://", "x://example.com/en/71", "x://notexample.com/en/71", "x://Éa.NET/de/#a", "x://a.com/en?/en/7"]
    rows = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(rows).collect()}
    assert got[0] == got[1] == got[3] == ("", "", None, "allow")
    assert got[2] == ("a.b.co.uk:80", "", None, "allow")
    assert got[4][2:] == ("example.com/en/7", "allow") and got[5][2:] == ("com/en/", "block")
    assert got[6] == ("Éa.net", "/de/", "net/de/", "block") and got[7][1:3] == ("/en", None)
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_reputation_blocks_a_bad_host_only(spark):
    bad = [(k, f"http://bad.example.com/en/{k}" if k % 20 else f"http://bad.example.com/x/{k}") for k in range(200)]
    good = [(1000 + k, f"http://good{k % 40}.example.org/x/{k}") for k in range(800)]
    rows = spark.createDataFrame(bad + good, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(rows, rules=(("block", "com", "/en/"),)).collect()}
    assert got[20] == "block" and all(got[1000 + k] == "allow" for k in range(800))


def brute_base(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = "".join(c if c.isdigit() and c < "\x7f" or "a" <= c <= "z" or c > "\x7f" else " " for c in w).split(" ")
    w = [x for x in w if x]
    at = [(i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licences_against_brute_force(spark, make):
    r = random.Random(4)
    vocabulary = ["mit", "license", "MIT License", "apache", "the", "general public license", "é", "-", "x1"]
    texts = ODD + [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(60)]
    got = {x["doc_id"]: x for x in license_scan.license_scan(make(texts)).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute_base(t)
        assert set(got[k]["base_labels"].split(",")) <= set(got[k]["labels"].split(",")) or not got[k]["base_labels"]
    assert license_scan.license_scan(make([])).count() == 0


@pytest.mark.parametrize("before", [0, 1, 60, 130, 150, 300, 1000])
def test_a_stray_match_does_not_break_a_chain(before):
    s, t = license_scan.Scanner(), license_scan.TEMPLATES[0][1].split()
    edited = ["zz" if k % 12 == 11 else w for k, w in enumerate(t)]
    stray = "permission is hereby granted".split()
    n, base, _, _, _, labels, score, spans = s.scan(" ".join(stray + ["yy"] * before + edited))
    assert (base, labels) == (0, "mit") and score > 0.85
    assert spans[-1][2] > 4 + before + len(t) - 12


def test_languages_by_letters_only_and_against_a_plain_version(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat noir et le chien", "fr"), ("der hund und die katze", "de"), ("the dog is here", "en"), (None, "fr"), ("x", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    counts = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for _, t, lang in rows:
        for w in (t or "").split() if lang else ():
            counts[0][w][lang] += 1
            for n in language_id.LENGTHS:
                marked = w if n == 1 else f"<{w}>"
                for i in range(len(marked) - n + 1):
                    counts[n][marked[i : i + n]][lang] += 1
    total = {(n, lang): sum(c[lang] for c in table.values()) for n, table in counts.items() for lang in ("de", "en", "fr")}

    def log(n, entry, lang):
        return np.log((counts[n][entry].get(lang) or 0.5) / (total[n, lang] + 1))

    def plain(text):
        found = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
        if not found:
            return "und", 0.0
        z = np.zeros(3)
        for w in found:
            for n in (0, *language_id.LENGTHS):
                marked = w if n < 2 else f"<{w}>"
                known = [p for p in ([w] if n == 0 else [marked[i : i + n] for i in range(len(marked) - n + 1)]) if p in counts[n]]
                if known:
                    z += np.mean([[log(n, p, lang) for lang in ("de", "en", "fr")] for p in known], axis=0)
                    break
        z /= len(found)
        return ("de", "en", "fr")[int(np.argmax(z))], 1 / np.exp(z - z.max()).sum()

    texts = [None, "", "²½Ⅷ① 12", "the", "The Cat, x2y²the", "chatte noire", "hunde katzen", "qqq", "mat mat chien ²le"]
    asked = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in language_id.identified(asked, model).collect()}
    for k, t in enumerate(texts):
        lang, score = plain(t)
        assert (got[k]["lang_pred"] == lang or score < 0.34) and abs(got[k]["score"] - score) < 1e-4, (t, got[k], lang, score)
    assert got[2]["lang_pred"] == "und" and language_id.identified(asked.limit(0), model).count() == 0


def test_licence_templates_with_gaps():
    s, t = license_scan.Scanner(), license_scan.TEMPLATES[0][1].split()
    n, base, _, _, _, labels, score, spans = s.scan("zz " + " ".join(t[:50] + ["other", "words"] + t[55:]))
    assert (base, labels) == (0, "mit") and score > 0.9 and spans[0] == ("mit", 1, 51)
    assert s.scan("of the the to and of the the software")[5:7] == ("", s.scan("of the the to and of the the software")[6])
    assert s.scan("of the the to and of the the software")[6] < license_scan.COVERED
    sequences = [[1, 2, 3, 1, 2], [2, 3, 4], [1, 2, 3, 1, 2, 5]]
    a = license_scan.Automaton()
    for k, q in enumerate(sequences):
        a.add(k, q)
    a.close()
    for text in itertools.product(range(1, 6), repeat=4):
        state, size = 0, 0
        for w in text:
            while state and w not in a.step[state]:
                state = a.link[state]
                size = a.length[state]
            if w in a.step[state]:
                state, size = a.step[state][w], size + 1
        longest = max(m for m in range(5) if any(list(text[4 - m :]) == q[i : i + m] for q in sequences for i in range(len(q) - m + 1)))
        assert size == longest


def test_pipeline_against_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {0: {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}}
    rows = docs
    for k, (name, function) in enumerate(corpus_pipeline.STAGES[:-1], 1):
        rows = stage(function(spark, rows, sf_dir), f"test-{name}")
        assert rows.columns == docs.columns
        kept[k] = {r[0]: r[1] for r in rows.select("doc_id", "text").collect()}
        assert set(kept[k]) <= set(kept[k - 1])
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    clean = [d for d in kept[0] if labels.get(d) == 0]
    assert np.mean([d in kept[1] for d in clean]) >= 0.95
    norm = lambda t: "".join((t or "").split(" ")).translate({k: None for k in range(9, 14)})
    groups = defaultdict(list)
    for d, t in kept[1].items():
        groups[norm(t)].append((-len(t or ""), d))
    assert set(kept[2]) == {min(g)[1] for g in groups.values()}
    assert set(kept[3]) == set(kept[4])
    from .test_dedup import brute_cut, sha

    want = brute_cut(kept[3].items())
    for d, t in kept[4].items():
        if want[d][1] == 0 or (t or "").isascii() and kept[3][d].isascii():
            assert sha((t or "").encode()) == want[d][3]
    check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), list(kept[4].items()))


def test_pipeline_on_odd_tables(spark, sf_dir, make):
    """Null and repeated ids and texts, very long texts, extra and clashing columns, and no rows at all."""
    odd = make(ODD).withColumnRenamed("kept", "_toxicity").withColumn("score", F.lit(1))
    odd = odd.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.limit(3))
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, function in corpus_pipeline.STAGES[:-1]:
            docs = stage(function(spark, docs, sf_dir), f"odd-{name}")
            assert docs.columns == odd.columns
        norm = {"".join((r["text"] or "").split()) for r in rows.collect()}
        assert docs.count() == (len(norm) if rows is odd else 0)
        pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
        assert sum(r["length"] for r in pieces) == sum(len(word_tokens().encode(r["text"] or "")) + 1 for r in docs.collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_source_divergence", "op13_conversation_repair"}))
def test_query_returns_every_row(spark, sf_dir, name):
    table, key = {"op8_url_filter": ("pages", "page_id"), "op9_embedding_dedup": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    got = queries.QUERIES[name](spark, sf_dir).select(key).distinct().count()
    assert got == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert suffix_dedup.LENGTH == 100


def test_lattices_are_cut_only_where_no_piece_crosses():
    p = nbest_pieces.pieces()
    mark = nbest_pieces.MARK
    text = f"{mark}The{mark}cat,{mark}x²._y(z).{mark}{mark}a1b{mark}"
    parts = p.word.findall(text)
    assert "".join(parts) == text and f"{mark}cat" in parts
    cuts = set(itertools.accumulate(map(len, parts)))
    for i, j in itertools.combinations(range(len(text) + 1), 2):
        assert text[i:j] not in p.table or not any(i < c < j for c in cuts)


def test_packing_to_targets(spark, make):
    texts = ["first source words " * 300, "second one's words " * 300, "third one " * 300] * 3
    rows = packing.pack(make(texts), targets={"src0": 3, "src1": 1}, window=1024, sequence=4096).collect()
    check_pieces(rows, list(enumerate(texts)))
    first = [r for r in rows if r["window"] == 0]
    share = lambda k: sum(r["length"] for r in first if r["doc_id"] % 3 == k)
    assert (share(0), share(1), share(2)) == (768, 256, 0)


def test_one_queue_is_served_as_all_are():
    r = random.Random(13)
    totals = {f"s{k}": r.randint(0, 9_000) for k in range(12)}
    for targets in (None, {"s1": 3, "s2": 5.5}, {s: r.random() for s in totals}):
        m = packing.Mixture(totals, targets, 701)
        for k in range(m.windows + 1):
            assert [m.served_of(q, k) for q in range(12)] == m.served(k).tolist()
        for q, s in enumerate(m.names):
            for position in range(0, totals[s], 371):
                k = m.window_of(q, position)
                assert m.served_of(q, k) <= position < m.served_of(q, k + 1)
