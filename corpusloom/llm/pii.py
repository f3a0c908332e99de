"""Operator 11: personal data by patterns and by a character-level bidirectional LSTM with CRF transitions.

The base patterns find data in their usual forms. The model, trained in numpy, finds the same kinds in
disguise (an address spelt with ``at`` and ``dot``, a defanged IP, a telephone number without ``+``, a card number with
other separators). It learns from labelled spans: those of the patterns in a bounded sample of the documents, and
spans of known form that are planted into the sample's clean windows, beside numbers that are none.

A text is cut into windows that overlap by more than any usual span; every window is decoded with
Viterbi, and the spans of all windows of a text are reconciled together: pieces of one span
that windows cut are joined, and of spans that overlap the set with the largest total margin stays. What the model adds must pass its
kind's exact check (digits, parts, Luhn) and overlaps no base span.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage

KINDS = ("email", "ip", "card", "phone")
#: Documents to take labelled windows from, about; windows with spans and clean ones to fit on, at most.
SAMPLE, WITH_SPANS, CLEAN = 20_000, 2_000, 3_000
#: Characters of a training window, of a window to decode, and from one window's start to the next.
TRAINED, WINDOW, STRIDE = 96, 256, 208
#: Sizes of embedding and state, windows decoded at once, batches to train on and their size.
EMBED, STATE, TOGETHER, BATCHES, BATCH = 8, 12, 2048, 600, 64
#: What the path through a span must be worth more than the one around it.
MARGIN = 2.0

# ---- patterns -------------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: what fails at the run's start fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each run of characters before an @ is looked at once, so time is linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str, checked: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start; without ``checked``, of right shape only."""
    out = [("email", *x) for x in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if not checked or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and (not checked or luhn(digits)):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- characters -----------------------------------------------------------------------------------------------------

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _table() -> np.ndarray:
    """Classes of code points below 128; 0 is padding: letters by name without case, one class of digits, signs each by itself."""
    of = np.full(129, 62, np.uint8)
    for k in range(26):
        of[65 + k] = of[97 + k] = 1 + k
    of[48:58] = 27
    of[32] = 28
    of[9:14] = 29
    for k, c in enumerate(_SIGNS):
        of[ord(c)] = 30 + k
    of[128] = 63
    return of


_CLASS = _table()
CLASSES = 64


def classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 128)]


# ---- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """embed (EMBED, CLASSES); gates (direction, 4 STATE, EMBED + STATE + 1), rows i, f, o, g; out (tags, 2 STATE + 1); moves (from, to).

    Gates are cut off at 0 and 1, cells' inputs and outputs at -1 and 1, in place of sigmoid and tanh.
    """

    embed: np.ndarray
    gates: np.ndarray
    out: np.ndarray
    moves: np.ndarray

    def states(self, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, 2 STATE + 1, windows), the last row ones, of windows ``ids`` (windows, time)."""
        n, steps = ids.shape
        e, h = EMBED, STATE
        emb = np.take(self.embed, ids.T, axis=1)  # (EMBED, time, windows)
        x = np.zeros((2, e + h + 1, n), np.float32)
        x[:, -1] = 1
        c = np.zeros((2, h, n), np.float32)
        z = np.empty((2, 4 * h, n), np.float32)
        states = np.ones((steps, 2 * h + 1, n), np.float32)
        for t in range(steps):
            x[0, :e], x[1, :e] = emb[:, t], emb[:, steps - 1 - t]
            if keep is not None:
                z = np.empty_like(z)
            np.matmul(self.gates, x, out=z)
            raw = z.copy() if keep is not None else None
            s, g = z[:, : 3 * h], z[:, 3 * h :]
            np.clip(s, 0, 1, out=s)
            np.clip(g, -1, 1, out=g)
            before = c
            c = s[:, h : 2 * h] * c
            g = s[:, :h] * g
            c += g
            cut = np.clip(c, -1, 1)
            out = x[:, e : e + h] if keep is None else np.empty_like(c)
            if keep is not None:
                keep.append((x.copy(), raw, z, before, c, cut))
            np.multiply(s[:, 2 * h :], cut, out=out)
            x[:, e : e + h] = out
            states[t, :h] = out[0]
            states[steps - 1 - t, h : 2 * h] = out[1]
        return states

    def decoded(self, ids: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(window, tag, start, end, margin) of the best paths through windows; windows whose best path has no span give nothing."""
        scores = np.matmul(self.out, self.states(ids))  # (time, tags, windows)
        steps, tags, n = scores.shape
        best = np.empty_like(scores)
        best[0] = scores[0]
        plain = scores[0, 0].copy()
        for t in range(1, steps):
            np.max(best[t - 1][:, None] + self.moves[:, :, None], axis=0, out=best[t])
            best[t] += scores[t]
            plain += self.moves[0, 0]
            plain += scores[t, 0]
        some = np.flatnonzero(best[-1].max(axis=0) > plain)
        if not len(some):
            return []
        path = np.zeros((steps, len(some)), np.int8)
        path[-1] = best[-1][:, some].argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = (best[t - 1][:, some] + self.moves[:, path[t]]).argmax(axis=0)
        found = []
        for k, w in enumerate(some.tolist()):
            own = path[:, k]
            cut = np.flatnonzero(np.diff(own)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), steps], strict=True):
                tag = int(own[a])
                if tag:
                    gain = (scores[a:b, tag, w] - scores[a:b, 0, w]).sum() + (b - a - 1) * (self.moves[tag, tag] - self.moves[0, 0])
                    gain += (self.moves[0, tag] - self.moves[0, 0] if a else 0) + (self.moves[tag, 0] - self.moves[0, 0] if b < steps else 0)
                    found.append((w, tag, a, b, float(gain)))
        return found


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _gradient(m: Model, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss of the CRF over windows and its gradient by embed, gates, out and moves."""
    n, steps = ids.shape
    e, h, k = EMBED, STATE, len(m.out)
    keep: list = []
    states = m.states(ids, keep)
    scores = np.matmul(m.out, states)
    moves = m.moves
    ahead = np.empty_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = _log_sum(ahead[t - 1][:, None] + moves[:, :, None], 0) + scores[t]
    total = _log_sum(ahead[-1], 0)
    back = np.zeros_like(scores)
    d_moves = np.zeros_like(moves)
    for t in range(steps - 1, 0, -1):
        right = scores[t] + back[t]
        both = moves[:, :, None] + right[None]
        d_moves += np.exp(ahead[t - 1][:, None] + both - total).sum(axis=2)
        back[t - 1] = _log_sum(both, 1)
    d_scores = np.exp(ahead + back - total)
    y = tags.T
    at = np.arange(n)
    gold = np.zeros(n, np.float32)
    for t in range(steps):
        gold += scores[t, y[t], at] + (moves[y[t - 1], y[t]] if t else 0)
        d_scores[t, y[t], at] -= 1
        if t:
            np.subtract.at(d_moves, (y[t - 1], y[t]), 1)
    d_scores = (d_scores / n).astype(np.float32)
    d_moves = (d_moves / n).astype(np.float32)
    d_out = np.einsum("tkn,tsn->ks", d_scores, states, optimize=True)
    d_states = np.matmul(m.out.T, d_scores)
    d_gates, d_emb = np.zeros_like(m.gates), np.zeros((e, steps, n), np.float32)
    d_c = np.zeros((2, h, n), np.float32)
    d_h = np.zeros((2, h, n), np.float32)
    for t in range(steps - 1, -1, -1):
        x, raw, z, before, c, cut = keep[t]
        i, f, o, g = (z[:, k * h : (k + 1) * h] for k in range(4))
        d_h[0] += d_states[t, :h]
        d_h[1] += d_states[steps - 1 - t, h : 2 * h]
        d_c += d_h * o * (np.abs(c) < 1)
        d_z = np.concatenate([d_c * g, d_c * before, d_h * cut, d_c * i], axis=1)
        d_z[:, : 3 * h] *= (raw[:, : 3 * h] > 0) & (raw[:, : 3 * h] < 1)
        d_z[:, 3 * h :] *= np.abs(raw[:, 3 * h :]) < 1
        d_c = d_c * f
        d_gates += np.matmul(d_z, x.transpose(0, 2, 1))
        d_x = np.matmul(m.gates.transpose(0, 2, 1), d_z)
        d_emb[:, t] += d_x[0, :e]
        d_emb[:, steps - 1 - t] += d_x[1, :e]
        d_h = np.ascontiguousarray(d_x[:, e : e + h])
    flat = ids.T.ravel()
    d_embed = np.stack([np.bincount(flat, row.ravel(), minlength=CLASSES) for row in d_emb]).astype(np.float32)
    return float((total - gold).mean()), [d_embed, d_gates, d_out.astype(np.float32), d_moves]


def train(ids: np.ndarray, tags: np.ndarray, batches: int = BATCHES, batch: int = BATCH, seed: int = 11) -> Model:
    """Fit by Adam on windows (windows, time) of character classes and their tags (0 is none)."""
    pick = np.random.default_rng(seed)
    e, h, k = EMBED, STATE, len(KINDS) + 1
    gates = pick.normal(0, 0.2, (2, 4 * h, e + h + 1)).astype(np.float32)
    gates[:, : 3 * h, -1] += 0.5
    gates[:, h : 2 * h, -1] += 0.3
    m = Model(pick.normal(0, 0.5, (e, CLASSES)).astype(np.float32), gates, pick.normal(0, 0.3, (k, 2 * h + 1)).astype(np.float32), np.zeros((k, k), np.float32))
    parts = [m.embed, m.gates, m.out, m.moves]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    order = np.zeros(0, np.int64)
    for step in range(1, batches + 1):
        if len(order) < batch:
            order = np.concatenate([order, pick.permutation(len(ids))])
        some, order = order[:batch], order[batch:]
        _, grads = _gradient(m, ids[some], tags[some])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - 0.95 * step / batches) * min(1.0, step / 10)
        for p, g, a, b in zip(parts, grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return m


# ---- labelled spans -------------------------------------------------------------------------------------------------


def disguised(pick: random.Random, words: list[str]) -> tuple[str, str]:
    """(kind, form) of one span, in a usual form or in disguise; kind is empty for numbers that are no personal data."""
    n, one = pick.randint, lambda *x: pick.choice(x)
    digits = lambda k: f"{pick.randrange(10**k):0{k}}"
    word = lambda: pick.choice(words)
    kind = one(*KINDS, "")
    if kind == "email":
        at, dot = one(("@", "."), ("@", "."), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" at ", "."), ("{at}", "."), (" @ ", " . "))
        local = one(word(), f"{word()}.{digits(n(1, 3))}", f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{digits(2)}")
        return kind, local + at + dot.join(one((word(), "com"), (word(), "org"), (word(), word(), "net"), (f"mail{n(0, 9)}", "example", "com"), (word(), "de"), (word(), "co", "uk")))
    if kind == "ip":
        return kind, one(".", ".", "[.]", " . ", "(.)", " dot ", ",").join(str(n(0, 255)) for _ in range(4))
    if kind == "card":
        sep = one("", " ", "-", ".", "_", " - ", "/", "  ")
        sizes = one((4, 4, 4, 4), (4, 6, 5), (16,), (4, 4, 4, 4, 3)) if sep else (16,)
        return kind, sep.join(digits(k) for k in sizes)
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return kind, one(f"+{n(1, 99)} ({a}) {b}-{c}", f"+{n(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{n(1, 9)}-{a}-{b}-{c}", f"00{n(1, 99)} {a} {b} {c}", f"({a}) {b} {c}", f"+{n(1, 99)}/{a}/{b}{c}")
    year = n(1900, 2050)
    return "", one(str(year), f"{year}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}.{n(1, 12)}.{year}", f"{n(0, 23)}:{n(0, 59):02}:{n(0, 59):02}", f"{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 999)},{digits(3)}.{digits(2)}",
                   digits(n(1, 8)), digits(n(9, 13)), "%x" % n(1 << 50, 1 << 60), f"{word()} at {word()}", f"@{word()}", f"{n(1, 99)} {n(100, 999)} {word()}", f"({year})", f"{digits(3)}-{digits(4)}")


def labelled(windows: list[str], clean: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and tags: ``windows`` with the spans of the patterns, and ``clean`` ones with a planted span or number each, and as they are."""
    pick = random.Random(seed)
    texts, spans = [], []
    for w in windows:
        texts.append(w)
        spans.append(base_spans(w, checked=False))
    pool = [x for w in clean for x in re.findall(r"[a-z]{3,10}", w.lower())] or ["name", "post", "box"]
    for w in clean * 3 if clean else [""] * CLEAN:
        texts.append(w)
        spans.append(base_spans(w, checked=False))
        gaps = [0, *(m.end() for m in re.finditer(r"\s", w))]
        at = pick.choice(gaps)
        kind, form = disguised(pick, pool)
        after = pick.choice(["", " ", ". ", ", ", "\n", "%%% "])
        left = w[:at]
        text = left + form + (after or " ") + w[at:]
        start = max(0, len(left) + len(form) + 8 - TRAINED)
        planted = (kind, len(left) - start, len(left) + len(form) - start)
        text = text[start : start + TRAINED]
        # what the patterns see elsewhere in the window stays labelled
        others = [s for s in base_spans(text, checked=False) if s[2] <= planted[1] or planted[2] <= s[1]]
        spans.append(others + [planted] * bool(kind))
        texts.append(text)
    ids, tags = np.zeros((len(texts), TRAINED), np.uint8), np.zeros((len(texts), TRAINED), np.int8)
    for k, (t, own) in enumerate(zip(texts, spans, strict=True)):
        c = classes(t[:TRAINED])
        ids[k, : len(c)] = c
        for kind, a, b in own:
            tags[k, max(a, 0) : b] = KINDS.index(kind) + 1
    return ids, tags


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Training windows of sampled texts: one around each pattern's span (eight a text at most) and one clean one."""
    for pdf in batches:
        out = []
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            text = text or ""
            own = base_spans(text, checked=False)
            pick = np.random.default_rng(abs(int(key)))
            for _, a, b in own[:8]:
                start = max(0, a - int(pick.integers(0, TRAINED - 8)))
                if b - start <= TRAINED or b - a > TRAINED:
                    out.append((True, key, text[start : start + TRAINED]))
            start = int(pick.integers(0, max(1, len(text) - TRAINED)))
            if not any(x[1] < start + TRAINED and start < x[2] for x in own):
                out.append((False, key, text[start : start + TRAINED]))
        yield pd.DataFrame(out, columns=["some", "key", "text"])


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on windows of about ``sample`` documents, drawn by the hashes of their ids; the driver holds WITH_SPANS + CLEAN windows at most.

    Without documents the model learns from planted spans alone.
    """
    rows = docs.select(F.xxhash64(id_col).alias("key"), F.col(text_col).alias("text"))
    share = min(1.0, sample / max(docs.count(), 1))
    drawn = rows.where(F.pmod("key", F.lit(1_000_003)) < share * 1_000_003)
    windows = stage(drawn.mapInPandas(_windows, "some boolean, key long, text string"), "pii-windows")
    with_spans = [r["text"] for r in windows.where("some").orderBy(F.xxhash64("key", "text"), "text").limit(WITH_SPANS).collect()]
    clean = [r["text"] for r in windows.where("not some").orderBy(F.xxhash64("key", "text"), "text").limit(CLEAN).collect()]
    return train(*labelled(with_spans, clean))


# ---- finding --------------------------------------------------------------------------------------------------------

_AT = re.compile(r"@|\bat\b", re.IGNORECASE)
_EDGES = re.compile(r"\A[^\w+(]+|[^\w)]+\Z")
#: What may stand between the digits of a disguised IP, card or telephone number.
_BETWEEN = {"ip": re.compile(r"[0-9\s.,()\[\]dot]+", re.IGNORECASE), "card": re.compile(r"[0-9\s._/-]+"), "phone": re.compile(r"[+0-9\s().\-/]+")}


def passes(kind: str, span: str) -> bool:
    """The exact check of a span that the model found."""
    if kind == "email":
        at = _AT.search(span)
        return bool(at and re.search(r"\w", span[: at.start()]) and re.search(r"\w\W*(?:\.|\bdot\b)\W*\w", span[at.end() :], re.IGNORECASE)) and "\n" not in span and len(span) <= 100
    if not _BETWEEN[kind].fullmatch(span) or "\n" in span:
        return False
    groups = _DIGIT_RUNS.findall(span)
    digits = "".join(groups)
    if kind == "ip":
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "card":
        return 13 <= len(digits) <= 19 and all(3 <= len(g) for g in groups) and luhn(digits)
    return 9 <= len(digits) <= 15 and len(groups) >= 3 and all(len(g) <= 7 for g in groups)


_DIGIT_RUNS = re.compile(r"[0-9]+")


def reconciled(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end, margin) of all windows of one text to a set without overlaps.

    Spans of one kind that overlap or touch are pieces of one, with the largest margin; of the rest the set with the largest sum of
    margins stays.
    """
    joined: list[list] = []
    for kind, a, b, gain in sorted(found, key=lambda s: (s[0], s[1], s[2])):
        if joined and joined[-1][0] == kind and a <= joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
            joined[-1][3] = max(joined[-1][3], gain)
        else:
            joined.append([kind, a, b, gain])
    joined.sort(key=lambda s: (s[2], s[1], s[0]))
    ends = np.array([s[2] for s in joined])
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for k, (_, a, _, gain) in enumerate(joined):
        before = int(np.searchsorted(ends[:k], a, "right"))
        take = best[before][0] + gain
        best.append((take, before, True) if take > best[k][0] else (best[k][0], k, False))
    out, k = [], len(joined)
    while k:
        _, before, taken = best[k]
        if taken:
            out.append(tuple(joined[k - 1][:3]))
        k = before
    return out[::-1]


def added(model: Model, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """What the model finds in each whole text, reconciled, trimmed and checked."""
    owner, starts, pieces = [], [], []
    found: list[list] = [[] for _ in texts]

    def decode() -> None:
        for w, tag, a, b, gain in model.decoded(np.stack(pieces)):
            if gain >= MARGIN:
                found[owner[w]].append((KINDS[tag - 1], starts[w] + a, starts[w] + b, gain))
        owner.clear(), starts.clear(), pieces.clear()

    for k, text in enumerate(texts):
        ids = classes(text)
        for start in range(0, max(len(ids) - (WINDOW - STRIDE), 1), STRIDE) if len(ids) else ():
            own = ids[start : start + WINDOW]
            owner.append(k)
            starts.append(start)
            pieces.append(own if len(own) == WINDOW else np.pad(own, (0, WINDOW - len(own))))
            if len(pieces) == TOGETHER:
                decode()
    if pieces:
        decode()
    out = []
    for text, spans in zip(texts, found, strict=True):
        kept = []
        for kind, a, b in reconciled([(k, a, min(b, len(text)), g) for k, a, b, g in spans]):
            span = text[a:b]
            lead = _EDGES.match(span)
            a += lead.end() if lead else 0
            span = text[a:b]
            trail = re.search(r"[^\w)]+\Z", span)
            b = a + trail.start() if trail else b
            if a < b and passes(kind, text[a:b]):
                kept.append((kind, a, b))
        out.append(kept)
    return out


def found(docs: DataFrame, model: Model, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``spans_col``: an array of (kind, start, end, base), by kind as listed, then start; code points, end exclusive.

    Every whole text is searched, of any length; a null text counts as empty. Repeated rows come back as often as they stand,
    null ids too; a column of ``docs`` called ``spans_col`` is replaced. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind string, start long, end long, base boolean>>")
    def of(texts: pd.Series) -> pd.Series:
        texts = [t or "" for t in texts]
        out = []
        for text, more in zip(texts, added(shipped.value, texts), strict=True):
            base = base_spans(text)
            own = [(*s, True) for s in base] + [(*s, False) for s in more if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
            own.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            out.append([dict(zip(("kind", "start", "end", "base"), s)) for s in own])
        return pd.Series(out, dtype=object)

    return docs.withColumn(spans_col, of(F.col(text_col)))


def redacted(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` (of :func:`found`) with every span of the text replaced by its kind in angle brackets; spans that overlap become one, named by the first."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            parts, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], s["end"])) if text else ():
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"<{s['kind']}>"]
                at = max(at, s["end"])
            out.append(text if text is None else "".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, of(F.col(text_col), F.col(spans_col)))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: counts and digest of the base spans, and all spans. Repeated rows come back as often as they stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = found(docs, fit(docs))
    told = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", told), ",").alias("spans"))


#: A fitted network has no SQL; tests hold patterns, decoding and gradients against plain versions and the model against held-out spans.
SQL: dict[str, str] = {}
QUERIES = {"op11_personal_data": op11_personal_data}
