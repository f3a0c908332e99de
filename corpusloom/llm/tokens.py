"""Token ids of a public word-level BPE vocabulary, equal to the library's, a word at a time.

The vocabulary's own normalisation (NFC, white space to one space, lower case) and its split
into words are repeated here for texts whose characters are below U+0250, where they are plain
rules on character categories; each distinct word is then encoded once by the library and kept.
Any other text goes through the library whole, so the ids are the library's in every case.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Below this code point texts take the quick way.
SIMPLE = 0x250
#: Words that a worker remembers in each of two generations; one that is used again moves to the younger.
REMEMBERED = 700_000


def _category_class(initial: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SIMPLE) if unicodedata.category(chr(c))[0] == initial)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    letters, numbers, white = _category_class("L"), _category_class("N"), "\\t-\\r \x85\xa0"
    # The vocabulary's own split pattern, with its classes written out.
    # Letters stand first, which no other branch begins with.
    words = re.compile(rf"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{white}{letters}{numbers}]+")
    return words, re.compile(f"[^\x00-{chr(SIMPLE - 1)}]")


class WordTokens:
    """Encodes texts to token ids with one vocabulary file of the installed tokenizers."""

    def __init__(self, name: str = "word_bpe_49k.json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        encoded = self.library.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(encoded.ids, self.kind), np.array(encoded.word_ids)
        cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True])
        if len(cuts) != len(words) + 1:  # a word that the library splits: one at a time
            for w in words:
                self.known[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
            return
        raw, at = ids.tobytes(), (ids.itemsize * cuts).tolist()
        for w, lo, hi in zip(words, at, at[1:], strict=False):
            self.known[w] = raw[lo:hi]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (the smallest unsigned type that holds them) of each text, as the library gives them with add_special_tokens=False."""
        words_of, beyond = _patterns()
        split = [None if "<|" in t or beyond.search(t) else words_of.findall(unicodedata.normalize("NFC", t).lower()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        found = [list(map(self.known.get, w)) if w else [] for w in split]
        open_ = [k for k, x in enumerate(found) if None in x]
        need = {w for k in open_ for w, x in zip(split[k], found[k], strict=True) if x is None}
        again = [w for w in need if w in self.older] if self.older else []
        self.known.update((w, self.older[w]) for w in again)
        new = list(need.difference(again))
        for k in range(0, len(new), 10_000):
            self._learn(new[k : k + 10_000])
        known = self.known
        for k in open_:
            found[k] = [x or known[w] for w, x in zip(split[k], found[k], strict=True)]
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind) if w is None else np.frombuffer(b"".join(x), self.kind) for t, w, x in zip(texts, split, found, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def some_at_a_time(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of ``texts`` with about ``most`` characters each."""
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


@lru_cache(maxsize=2)
def word_tokens(name: str = "word_bpe_49k.json") -> WordTokens:
    """One encoder for each worker process."""
    return WordTokens(name)
