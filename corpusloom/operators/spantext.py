"""Texts whose spans survive: clean lines, bodies joined from boxes, runs joined to a bill's text and stripped of page chrome."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import offsets
from corpusloom.functions.arrays import running_sums

SPANS = "array<struct<start:int,end:int,format:string>>"


def _with_spans(text: Column, spans: Column, made: Callable[[str], offsets.Map]) -> Column:
    """struct(text, spans) after an edit; spans of which nothing is left are gone."""

    @F.pandas_udf(f"struct<text:string,spans:{SPANS}>")
    def of(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out, kept = [], []
        for t, own in zip(texts, lists, strict=True):
            m = made(t or "")
            out.append(None if t is None else m.text)
            moved = [(m.span(s["start"], s["end"]), s["format"]) for s in (own if own is not None else [])]
            kept.append([{"start": p[0], "end": p[1], "format": f} for p, f in moved if p])
        return pd.DataFrame({"text": out, "spans": pd.Series(kept, dtype=object)})

    return of(text, spans)


def clean_lines(text: Column, spans: Column) -> Column:
    """struct(text, spans): white space collapsed and trimmed line by line, blank lines dropped, and the spans (start, end, format) where their characters went."""
    return _with_spans(text, spans, offsets.clean_lines)


def bodies(boxes: DataFrame, id_col: str, marker: Column, order: str = "pos") -> DataFrame:
    """Bodies under headings with the formats of all their boxes: id, block, heading, body, spans.

    ``boxes``: id, order, text, spans (start, end, format). Boxes without a letter or digit are left out, the others joined by line
    feeds, and each box's spans moved by what stands before it.
    """
    w = Window.partitionBy(id_col).orderBy(order)
    dealt = boxes.withColumn("block", F.sum(marker.cast("int")).over(w))
    part = F.when(~marker & F.col("text").rlike("[0-9A-Za-z]"), F.struct(F.col(order).alias("o"), "text", "spans"))
    held = dealt.groupBy(id_col, "block").agg(F.max(F.when(marker, F.col("text"))).alias("heading"), F.array_sort(F.collect_list(part)).alias("parts"))
    held = held.withColumn("ends", running_sums(F.transform("parts", lambda p: F.length(p["text"]) + 1)))

    def moved(p: Column, end: Column) -> Column:
        base = end - F.length(p["text"]) - 1
        return F.transform(p["spans"], lambda s: F.named_struct(F.lit("start"), s["start"] + base, F.lit("end"), s["end"] + base, F.lit("format"), s["format"]))

    return held.select(id_col, "block", "heading", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("body"), F.flatten(F.zip_with("parts", "ends", moved)).alias("spans"))


#: Lines of a bill's pages that are no text of it, and reprints of sponsors inside lines.
NUMBER = re.compile(r"^\s*\d{1,2}\s*$")
CHROME_LINES = (re.compile(r"^BOARD OF SUPERVISORS\b"), re.compile(r"^FILE NO\.\s+\d+\s+ORDINANCE NO\b"), re.compile(r"^(?:Mayor [A-Z][A-Za-z'-]+;?\s*$|Supervisors? [A-Z])"))
LEGEND = ("NOTE:", "Additions to Codes", "Deletions to Codes", "Board amendment additions", "Board amendment deletions", "Asterisks (", "subsections or parts of tables")
REPRINT = re.compile(r"\s*(?:Mayor [A-Z][A-Za-z'-]+;\s+)?Supervisors? [A-Z][A-Za-z'-]+(?:[;,]\s+[A-Z][A-Za-z'-]+)*(?=\s|$)|\s+Mayor [A-Z][A-Za-z'-]+(?=\s*(?:\n|$))")
_TRAILING = re.compile(r"[ \t]+(?=\n)")
_FEEDS = re.compile(r"(?<=\n\n)\n+")
_ENDS = re.compile(r"\A\s+|\s+\Z")


def _is_chrome(line: str) -> bool:
    line = line.strip()
    return bool(line) and (bool(NUMBER.match(line) and 1 <= int(line) <= 25) or any(p.search(line) for p in CHROME_LINES) or line.startswith(LEGEND))


def without_chrome(text: str) -> offsets.Map:
    """A bill's text without reprints of sponsors, page numbers (1 to 25), feet, heads and the legend; at most two line feeds in a row, trimmed."""
    first = offsets.without(text, REPRINT)

    def lines():
        at = 0
        for line in first.text.split("\n"):
            if _is_chrome(line):
                yield at, min(at + len(line) + 1, len(first.text)), "", False
            at += len(line) + 1

    out = first.then(offsets.edited(first.text, lines()))
    out = out.then(offsets.without(out.text, _FEEDS))
    return out.then(offsets.without(out.text, _ENDS))


def run_texts(runs: DataFrame) -> DataFrame:
    """Bills' texts from their runs: doc, text, ranges (run, start, end in the text; a run that chrome cuts has several, one that is chrome none).

    ``runs``: doc, run (order), text, has_eol. A run is followed by a line feed where it has one, else by a space unless it ends in
    one; white space before a line feed goes.
    """
    one = F.struct(F.col("run").cast("long").alias("run"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("has_eol", F.lit(False)).alias("eol"))
    held = runs.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("runs"))
    schema = f"doc {runs.schema['doc'].dataType.simpleString()}, text string, ranges array<struct<run:bigint,start:int,end:int>>"
    return held.mapInArrow(_run_texts, schema)


def _run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("runs")
        rows = lists.flatten()
        names, texts, eols = (rows.field(k).to_pylist() for k in range(3))
        bounds = pc.list_value_length(lists).to_pylist()
        made, ranges, ends, k = [], [], [0], 0
        for n in bounds:
            parts, own, at = [], [], 0
            for k in range(k, k + n):
                text = texts[k]
                after = "\n" if eols[k] else "" if text.endswith(" ") else " "
                parts += [text, after]
                own.append((names[k], at, at + len(text)))
                at += len(text) + len(after)
            k += n > 0
            joined = offsets.without("".join(parts), _TRAILING)
            m = joined.then(without_chrome(joined.text))
            made.append(m.text)
            ranges += [(run, a, b) for run, start, end in own for a, b in m.stretches(start, end)]
            ends.append(len(ranges))
        columns = list(zip(*ranges, strict=True)) or [()] * 3
        kinds = (("run", pa.int64()), ("start", pa.int32()), ("end", pa.int32()))
        told = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[c for c, _ in kinds])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)], names=["doc", "text", "ranges"])


#: White space, inside a class: ASCII's and Unicode's; BLANK is without line feeds.
_UNICODE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WHITE, BLANK = rf"\s{_UNICODE}", rf" \t\r\f\u000b{_UNICODE}"


def normal(text: Column) -> Column:
    """Composed (NFC), white space collapsed to one space and trimmed; doing it again changes nothing."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in texts], dtype=object)

    return F.trim(F.regexp_replace(composed(text), f"[{WHITE}]+", " "))


def tokens(text: Column) -> Column:
    """Words of the normal text, with their places in it: array of struct(start, token); none for an empty text."""
    words = F.filter(F.split(normal(text), " "), lambda w: w != "")
    ends = running_sums(F.transform(words, lambda w: F.length(w) + 1))
    return F.zip_with(words, ends, lambda w, e: F.named_struct(F.lit("start"), e - F.length(w) - 1, F.lit("token"), w))
