"""Operator 5: SentencePiece encoding and decoding with N-best segmentation.

A forward Viterbi pass gives every place of a piece lattice the best score of the way to it. A
backward A-star search from the end takes these scores as its heuristic; as they are exact, the
first N hypotheses that reach the start are the N best, in order. No piece of the vocabulary
runs from other characters into a word mark, or joins a letter and a sign (both are checked when
it is read; a vocabulary with such pieces is searched in longer parts), so a text's lattice is a
chain of word lattices: words are searched once and remembered, and the text's N best are chosen
among the words'.
Only the N - 1 words whose second best costs least can differ from their best there, for each
of them alone already gives a hypothesis that is no worse than one that differs elsewhere.
"""

from __future__ import annotations

import bisect
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
HYPOTHESES = 3
#: Words whose results a worker remembers in each of two generations.
REMEMBERED = 300_000
#: Characters of a word up to which its results are remembered.
SHORT = 64


class Pieces:
    """A vocabulary file's pieces, with searches over their lattices."""

    def __init__(self, name: str = "piece_bpe_32k.model", n: int = HYPOTHESES):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.n = n
        self.table: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:-1], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.bytes_of.append(b"")
            else:
                self.table[piece] = (model.get_score(k), k)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.trie: dict = {}
        for piece, (score, k) in self.table.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (score, (k,))
        usual = [s for s, _ in self.table.values() if s > -1e8]
        # A character without a piece is one edge, below all pieces, that stands for its bytes.
        self.unknown = min(usual, default=0.0) - 10
        inside = any(MARK in p.lstrip(MARK) for p in self.table)
        # Word characters that are neither letters nor digits, such as superscripts, go with the signs' neighbours uncut.
        odd = "".join(sorted({c for p in self.table for c in p if c.isalnum() and not c.isalpha()}))
        letter, sign = rf"[^\W\d_{re.escape(odd)}]", rf"[^\w{MARK}]"
        across = any(re.search(f"{letter}{sign}|{sign}{letter}", p) for p in self.table)
        # Letters with no word character after them, signs before a letter, a mark or the end, and else all up to the next mark.
        apart = "" if across else rf"{MARK}*{letter}+(?!\w)|{MARK}*{sign}+(?={letter}|{MARK}|\Z)|"
        self.word = re.compile("(?s:.+)" if inside else f"{apart}{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, tuple[float, bytes, float]] = {}
        self.older: dict[str, tuple[float, bytes, float]] = {}
        self.lists: dict[str, list[tuple[float, bytes]]] = {}

    def nbest(self, text: str, n: int) -> tuple[list[tuple[float, tuple[int, ...]]], float]:
        """The n best segmentations of a marked text, best first (of equal ones the smaller ids, read from the end), and the next one's score."""
        size = len(text)
        edges: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # by their end
        best = [0.0] + [-np.inf] * size
        for i in range(size):
            node, j, alone = self.trie, i, False
            while j < size and (node := node.get(text[j])) is not None:
                j += 1
                if (got := node.get("")) is not None:
                    edges[j].append((i, got[0], got[1]))
                    alone |= j == i + 1
                    if best[i] + got[0] > best[j]:
                        best[j] = best[i] + got[0]
            if not alone:
                edges[i + 1].append((i, self.unknown, tuple(self.byte_ids[b] for b in text[i].encode("utf-8", "replace"))))
                best[i + 1] = max(best[i + 1], best[i] + self.unknown)
        out: list[tuple[float, tuple[int, ...]]] = []
        # Every open entry stands for a hypothesis of exactly its cost, so no more are needed than hypotheses are still sought.
        open_: list[tuple[float, tuple, int, float]] = [(-best[size], (), size, 0.0)]
        while open_ and len(out) < n:
            _, path, at, done = open_.pop(0)
            if not at:
                ids: list[int] = []
                while path:
                    edge, path = path
                    ids.extend(edge)
                out.append((done, tuple(ids)))
                continue
            need = n + 1 - len(out)
            for a, s, edge in edges[at]:
                cost = -(done + s + best[a])
                if len(open_) < need or cost <= open_[need - 1][0]:
                    bisect.insort(open_, (cost, (edge, path), a, done + s))
            del open_[need:]
        return out, -open_[0][0] if open_ else -np.inf

    def _of_word(self, w: str) -> tuple[float, bytes, float]:
        """Best score and ids of a word, and what its second best costs."""
        found = self.older.get(w)
        if found is None:
            [(score, ids)], second = self.nbest(w, 1)
            found = (score, array("I", ids).tobytes(), score - second)
        if len(w) <= SHORT:
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[w] = found
        return found

    def _several(self, w: str) -> list[tuple[float, bytes]]:
        """The N best of a word; the words whose second best costs least come again and again."""
        found = self.lists.get(w)
        if found is None:
            found = [(s, array("I", ids).tobytes()) for s, ids in self.nbest(w, self.n)[0]]
            if len(w) <= SHORT:
                if len(self.lists) > REMEMBERED // 10:
                    self.lists.clear()
                self.lists[w] = found
        return found

    def encode(self, text: str | None) -> list[tuple[float, bytes, bool]]:
        """(score, little-endian 32-bit ids, decodes to the text) of the N best segmentations of a text, best first."""
        if not text:
            return [(0.0, b"", True)]
        words = self.word.findall(MARK + text.replace(" ", MARK))
        get, make = self.known.get, self._of_word
        found = [get(w) or make(w) for w in words]
        scores, parts, losses = zip(*found, strict=True)
        gaps = np.array(losses)
        several = np.flatnonzero(np.isfinite(gaps))
        if len(several) > self.n:
            limit = np.partition(gaps[several], self.n - 2)[self.n - 2] if self.n > 1 else -np.inf
            several = several[gaps[several] <= limit]
        chosen = np.sort(several[np.argsort(gaps[several], kind="stable")[: self.n - 1]]).tolist()
        others = {k: self._several(words[k]) for k in chosen}
        ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for k in chosen:
            ways = heapq.nsmallest(self.n, [(loss + scores[k] - s, (*picks, c)) for loss, picks in ways for c, (s, _) in enumerate(others[k])])
        total, out, parts = float(sum(scores)), [], list(parts)
        whole = self.decode(b"".join(parts)) == text.replace(MARK, " ")
        for loss, picks in ways:
            for k, c in zip(chosen, picks, strict=True):
                parts[k] = others[k][c][1]
            # only the chosen words differ from the best segmentation
            same = whole and all(self._raw(others[k][c][1]) == self._raw(found[k][1]) for k, c in zip(chosen, picks, strict=True))
            out.append((total - loss, b"".join(parts), same))
        return out

    def _raw(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation; a mark in the text itself comes back as a space."""
        raw = self._raw(ids)
        return raw[1:].decode("utf-8", "replace") if raw else ""


@lru_cache(maxsize=2)
def pieces(name: str = "piece_bpe_32k.model", n: int = HYPOTHESES) -> Pieces:
    return Pieces(name, n)


def nbest_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = HYPOTHESES, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The n best segmentations of every whole text: doc_id, rank (from 1), score, ids (binary), round_trip.

    round_trip tells whether decoding gives the text again. A null or empty text has one
    segmentation without pieces. Repeated rows come back as often as they stand; other columns
    are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession, 128)

    @F.pandas_udf("array<struct<rank:int,score:double,ids:binary,round_trip:boolean>>")
    def of(texts: pd.Series) -> pd.Series:
        p = pieces(model, n)
        out = []
        for t in texts:
            out.append([{"rank": k, "score": s, "ids": ids, "round_trip": same} for k, (s, ids, same) in enumerate(p.encode(t), 1)])
        return pd.Series(out, dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("all"))
    # No list is empty; an inner explode would have its lists computed a second time, for a filter on their size.
    return rows.select("doc_id", F.explode_outer("all").alias("s")).select("doc_id", "s.*")


def decoded(segmentations: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids") -> DataFrame:
    """``segmentations`` with the text of each (column text); null ids give null."""

    @F.pandas_udf("string")
    def of(ids: pd.Series) -> pd.Series:
        p = pieces(model)
        return pd.Series([None if x is None else p.decode(x) for x in ids], dtype=object)

    return segmentations.withColumn("text", of(F.col(ids_col)))


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document, with a digest of their ids."""
    found = nbest_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "rank", "score", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")


#: A lattice search has no SQL; tests hold it against all segmentations of short texts.
SQL: dict[str, str] = {}
QUERIES = {"op5_nbest_pieces": op5_nbest_pieces}
