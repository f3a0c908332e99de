"""Operator 10: licence scan with a generalised suffix automaton of licence tokens.

The templates' words are numbered and one suffix automaton over all templates is built (a few
thousand states, made once per worker). A text is streamed through it: every word moves to the
longest suffix that some template holds, which gives the matching statistics. Matches of
LEAST words and more become spans of a template; per template the spans are chained in the
order of both text and template, and the share of the template that the best chain covers is
the evidence for its label. Words that no template has reset the automaton, so only runs of
known words are streamed. The fixed phrases are looked up in the same word numbers.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Licence notices as they are published, by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
#: Words of a match that can be part of a chain, at least; share of a template that gives its label.
LEAST = 4
COVERED = 0.6

_WORDS = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and all beyond ASCII."""
    return utf8(text).translate(_WORDS).split()


@dataclass
class Automaton:
    """Generalised suffix automaton of word-number sequences; ends[state] are (template, end) of its strings."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the strings of q that are no longer than p's and ``word``."""
        clone = self._state(self.length[p] + 1, dict(self.step[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, template: int, sequence: list[int]) -> None:
        """Add one template; suffixes that others share end in the same states."""
        last = 0
        for at, word in enumerate(sequence, 1):
            q = self.step[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, {}), last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.step[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            self.ends[last].append((template, at))

    def close(self) -> None:
        """Hand ends up to the suffixes, so that a state knows all places of its strings."""
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})

    def statistics(self, sequence: list[int]) -> list[tuple[int, int, int]]:
        """(end, length, state) where the longest match ending at a word can't be prolonged by the next one."""
        out, state, size = [], 0, 0
        for at, word in enumerate(sequence):
            nxt = self.step[state].get(word)
            if nxt is None:
                if size >= LEAST:
                    out.append((at, size, state))
                while nxt is None and state > 0:
                    state = self.link[state]
                    size = self.length[state]
                    nxt = self.step[state].get(word)
                if nxt is None:
                    state, size = 0, 0
                    continue
            state, size = nxt, size + 1
        if size >= LEAST:
            out.append((len(sequence), size, state))
        return out


class Scanner:
    """Templates and phrases, ready for texts."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        split = [words(t) for _, t in templates]
        self.sizes = [len(s) for s in split]
        self.phrases = [(words(p), label) for p, label in phrases]
        known = sorted({w for s in [*split, *(p for p, _ in self.phrases)] for w in s})
        self.number = {w: k for k, w in enumerate(known, 1)}
        self.automaton = Automaton()
        for k, s in enumerate(split):
            self.automaton.add(k, [self.number[w] for w in s])
        self.automaton.close()

    def places(self, ids: np.ndarray) -> list[tuple[np.ndarray, int, str]]:
        """(starts, words, label) of each phrase."""
        out = []
        for phrase, label in self.phrases:
            n = len(phrase)
            hit = np.ones(max(len(ids) - n + 1, 0), bool)
            for k, w in enumerate(phrase):
                hit &= ids[k : k + len(hit)] == self.number[w]
            out.append((np.flatnonzero(hit), n, label))
        return out

    def spans(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Per template the matches (start in the text, start in the template, words)."""
        edge = np.flatnonzero(np.diff(np.r_[0, (ids > 0).astype(np.int8), 0]))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo < LEAST:
                continue
            for end, size, state in self.automaton.statistics(ids[lo:hi].tolist()):
                for template, at in self.automaton.ends[state]:
                    found.setdefault(template, []).append((lo + end - size, at - size, size))
        return found

    def covered(self, template: int, matches: list[tuple[int, int, int]]) -> tuple[float, list[tuple[int, int]]]:
        """Largest share of the template that a chain of matches covers, ordered in text and template, and its spans in the text.

        Chains are searched in stretches of the text four times as long as the template; a stretch begins
        in the middle of the one before, so every chain up to twice as long as the template lies whole in
        one, wherever it stands and whatever matches precede it.
        """
        matches.sort(key=lambda m: (m[0] + m[2], m[1]))
        half = 2 * self.sizes[template] + LEAST
        stretches: dict[int, list[tuple[int, int, int]]] = {}
        for m in matches:
            k = m[0] // half
            stretches.setdefault(k, []).append(m)
            if k:
                stretches.setdefault(k - 1, []).append(m)
        best, where = 0, []
        for k in sorted(stretches):
            gain, spans = self._chain(stretches[k])
            if gain > best:
                best, where = gain, spans
        return min(best / self.sizes[template], 1.0), where

    @staticmethod
    def _chain(matches: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """Most words that a chain of matches (sorted by end in the text) covers, and its spans in the text.

        A chain's matches end in ascending order on both sides; its gain is what each adds in the
        template. Ends in the text ascend by sorting; a staircase of the best chains by end in the
        template keeps each step logarithmic.
        """
        chains: list[tuple[int, int, int]] = []  # (end in the template, covered, number of its last match), both ascending
        before: list[int] = []
        best, last = 0, -1
        for k, (_, at, n) in enumerate(matches):
            j = bisect.bisect_right(chains, (at, 1 << 60, 0)) - 1
            gain, prior = (chains[j][1] + n, chains[j][2]) if j >= 0 else (n, -1)
            before.append(prior)
            i = bisect.bisect_left(chains, (at + n, 0, 0))
            while i < len(chains) and chains[i][1] <= gain:
                del chains[i]
            if i == 0 or chains[i - 1][1] < gain:
                chains.insert(i, (at + n, gain, k))
            if gain > best:
                best, last = gain, k
        where = []
        while last >= 0:
            where.append((matches[last][0], matches[last][0] + matches[last][2]))
            last = before[last]
        return best, where[::-1]

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of a text."""
        w = words(text)
        ids = np.fromiter(map(self.number.get, w, [0] * len(w)), np.int32, len(w))
        if not ids.any():
            return len(w), 0, None, None, "", "", 0.0, []
        hits = self.places(ids)
        starts = np.concatenate([s for s, _, _ in hits])
        base = {label for s, _, label in hits if len(s)}
        labels, score, spans = set(base), 0.0, []
        for template, matches in self.spans(ids).items():
            share, where = self.covered(template, matches)
            score = max(score, share)
            if share >= COVERED:
                labels.add(self.labels[template])
                spans += [(self.labels[template], a, b) for a, b in where]
        first, last = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
        # a phrase names its licence outright
        return len(w), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else score, sorted(set(spans), key=lambda s: s[1:])


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans are the words [first, end) of the chains behind the method's labels. score is the
    largest covered share of a template, or 1 where a phrase stands. A null text counts as empty:
    no words, no labels, score 0. Repeated rows come back as often as they stand; other columns
    are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(_RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        found = scanner()
        out = pd.DataFrame([found.scan(t) for t in texts], columns=[x.split()[0] for x in _RESULT.split(", ")])
        out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
        out["spans"] = [[{"label": s[0], "first": s[1], "end": s[2]} for s in x] for x in out["spans"]]
        return out

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("r")).select("doc_id", "r.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole text."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


#: An automaton has no SQL; tests hold the query against a brute-force version.
SQL: dict[str, str] = {}
QUERIES = {"op10_license_scan": op10_license_scan}
