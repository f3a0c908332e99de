"""Operator 3: language identification, known words first, then ever shorter character n-grams.

A known word is scored by its log frequency in each language. A word that no language's table
holds is scored by its character n-grams: of the longest length of which at least one is known,
the mean log frequency over the known ones; single characters are the last resort. A text's
score per language is the mean over its words; the reported score is the winner's share of
the exponentials of these means, whatever the text's length.

The tables are fitted on a sample of labelled rows that is bounded in bytes of text (SAMPLE, a
parameter), and hold every word and n-gram of it. They are kept sparse: an entry has a list of
(language, log frequency) for the languages that use it, and a language that does not takes
the floor of its table.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, small_batches, stage

#: Bytes of labelled text to fit on, about, over all languages; each may use an equal part of them.
SAMPLE = 16 << 20
#: Lengths of the n-grams, longest first; 0 stands for whole words.
LENGTHS = (5, 4, 3, 2, 1)
#: Scores that a worker remembers: words times languages.
REMEMBERED = 1 << 22
# Below this range there are neither combining marks nor joiners.
_MAY_MARK = re.compile("[\u0300-\u036f\u0483-\U0010ffff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_JOINERS = "\u200c\u200d"


@lru_cache(maxsize=1)
def _run() -> re.Pattern:
    """A letter and all letters, combining marks (category M) and joiners after it."""

    def ranges(keep) -> str:
        out, first = [], None
        for k in range(sys.maxunicode + 2):
            there = k <= sys.maxunicode and keep(chr(k))
            if there and first is None:
                first = k
            elif not there and first is not None:
                out.append(f"{chr(first)}-{chr(k - 1)}" if k - 1 > first else chr(first))
                first = None
        return "".join(out)

    letters = ranges(str.isalpha)
    return re.compile(f"[{letters}][{letters}{ranges(lambda c: unicodedata.category(c)[0] == 'M')}{_JOINERS}]*")


def words(text: str) -> Counter:
    """Lower-cased, composed runs of letters with their counts; marks and joiners belong to the letter before, digits of any kind, such as superscripts, are no letters."""
    text = text.lower()
    if _MAY_MARK.search(text):
        return Counter(_run().findall(unicodedata.normalize("NFC", text)))
    found = Counter(_LETTERS.findall(text))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def parts(word: str, n: int) -> list[str]:
    """The word's n-grams, with its ends marked (single characters without)."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def key(n: int, entry: str) -> int:
    """A word (n = 0) or an n-gram as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(entry.encode("utf-8", "replace"), n) - (1 << 63)


@dataclass
class Model:
    """languages in order; keys of all entries, ascending; entry k's languages and log frequencies lie from first[k] on; floors[n] per language."""

    languages: list[str]
    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    log: np.ndarray
    floors: dict[int, np.ndarray]
    number: dict[str, int] = field(default_factory=dict)  # of words seen, into rows
    rows: np.ndarray | None = None

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of words per language: their own, or the means of the longest n-grams of which any is known."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        rest = np.arange(len(words))
        for n in (0, *LENGTHS):
            asked = [[words[k]] if n == 0 else parts(words[k], n) for k in rest.tolist()]
            owner = np.repeat(np.arange(len(rest)), [len(x) for x in asked])
            keys = np.array([key(n, p) for x in asked for p in x], np.int64)
            at = np.searchsorted(self.keys, keys)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == keys[known]
            at, owner = at[known], owner[known]
            # the floor for every language, and what its own entries have above it
            size = self.first[at + 1] - self.first[at]
            flat = np.arange(size.sum()) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)
            above = np.zeros((len(rest), len(self.languages)), np.float32)
            np.add.at(above, (np.repeat(owner, size), self.lang[flat]), self.log[flat] - self.floors[n][self.lang[flat]])
            count = np.bincount(owner, minlength=len(rest))
            some = count > 0
            out[rest[some]] = self.floors[n] + above[some] / count[some, None]
            rest = rest[~some]
            if not len(rest):
                break
        return out

    def _learn(self, words: set[str]) -> None:
        """Give every word a row of ``rows``."""
        new = [w for w in words if w not in self.number]
        if self.rows is None or len(self.number) + len(new) > len(self.rows):
            new = list(words)
            self.rows, self.number = np.zeros((max(REMEMBERED // len(self.languages), 2 * len(new)), len(self.languages)), np.float32), {}
        if new:
            self.rows[len(self.number) : len(self.number) + len(new)] = self.scores(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        found = [words(t) if t else Counter() for t in texts]
        if self.languages:
            self._learn(set().union(*found))
        out = []
        for own in found:
            if not own or not self.languages:
                out.append(("und", 0.0))
                continue
            at = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
            counts = np.fromiter(own.values(), np.float64, len(own))
            z = counts @ self.rows[at] / counts.sum()
            best = int(np.argmax(z))
            out.append((self.languages[best], float(1 / np.exp(z - z[best]).sum())))
        return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and n-grams of each language in one partition of the sample."""
    counts: dict[tuple[str, int], Counter] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            counts.setdefault((lang, 0), Counter()).update(words(text))
    for (lang, _), own in list(counts.items()):
        for n in LENGTHS:
            of = counts.setdefault((lang, n), Counter())
            for w, c in own.items():
                for p in parts(w, n):
                    of[p] += c
    for (lang, n), own in counts.items():
        yield pd.DataFrame({"lang": lang, "n": n, "key": [key(n, e) for e in own], "count": list(own.values())})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``docs``: of each language about ``sample`` / languages bytes of whole texts, drawn by the hash of the id.

    Rows with a null language or text are left out. Without any labelled row every prediction is
    ``und``. The sample's counts are written once; what reaches the driver are the sample's entries.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    none = np.zeros(0, np.int64)
    if not languages:
        return Model([], none, np.zeros(1, np.int64), none, none, {})
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample / len(languages) / max(sizes[lang], 1))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    counts = drawn.mapInPandas(_count, "lang string, n int, key long, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count"))
    table = stage(counts, "language-counts").toArrow()
    lang = np.searchsorted(np.array(languages, dtype=object), table.column("lang").to_numpy(zero_copy_only=False).astype(object))
    n, keys, count = (table.column(c).to_numpy() for c in ("n", "key", "count"))
    order = np.lexsort((lang, keys))
    lang, n, keys, count = lang[order], n[order], keys[order], count[order]
    totals = np.zeros((max(LENGTHS) + 1, len(languages)))
    np.add.at(totals, (n, lang), count)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else none
    log = np.log(count / (totals[n, lang] + 1)).astype(np.float32)
    return Model(languages, keys[start], np.r_[start, len(keys)], lang.astype(np.int32), log, {k: np.log(0.5 / (totals[k] + 1)).astype(np.float32) for k in (0, *LENGTHS)})


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of these names; ``und`` and 0 where the text is null or has no letter.

    Repeated rows come back as often as they stand, null ids too; of languages that score alike the first by
    name is told. An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shipped.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    told = of(F.col(text_col)).alias("_told")
    return docs.select(*kept, told).select(*kept, "_told.lang_pred", "_told.score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; fold 0 of 5 is held out. Repeated rows come back as often as they stand."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_fold("doc_id", 5) != 0))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


#: A fitted model has no SQL; tests hold it against held-out languages and a brute-force version.
SQL: dict[str, str] = {}
QUERIES = {"op3_language_id": op3_language_id}
