"""HTML to rows: elements with their offsets, anchors, links and text, by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that become format spans.
FORMATS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "ul": "list", "ol": "list", "li": "listItem"}
#: Elements that begin a box of their own, those that never close, and those without text of their own.
BOXES = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "li", "article", "nav", "section", "title", "footer", "header", "td"}
VOID = {"br", "img", "hr", "input", "meta", "link"}
SILENT = {"script", "style"}


class _Boxes(HTMLParser):
    """Boxes in document order: tag, classes, offset, anchors, links, text, format spans."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.boxes: list[dict] = []
        self.open: list[str] = []
        self.spans: list[tuple[str, int]] = []
        self.feed(text)
        self.close()

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        if tag in BOXES or not self.boxes:
            self.boxes.append({"tag": tag, "classes": (have.get("class") or "").split(), "offset": self._offset(), "anchors": [], "links": [], "text": "", "spans": []})
            self.spans = []
        box = self.boxes[-1]
        if tag == "a":
            box["anchors"] += [have["name"]] if have.get("name") else []
            box["links"] += [have["href"]] if have.get("href") else []
        if tag in FORMATS:
            self.spans.append((tag, len(box["text"])))
        if tag == "br":
            box["text"] += "\n"
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        for k in range(len(self.spans) - 1, -1, -1):
            if self.spans[k][0] == tag:
                _, start = self.spans.pop(k)
                if start < len(self.boxes[-1]["text"]):
                    self.boxes[-1]["spans"].append({"start": start, "end": len(self.boxes[-1]["text"]), "format": FORMATS[tag]})
                break

    def handle_data(self, data: str) -> None:
        if self.boxes and not SILENT & set(self.open):
            self.boxes[-1]["text"] += data


BOX = "pos int, tag string, classes array<string>, start_offset int, anchors array<string>, links array<string>, text string, spans array<struct<start:int,end:int,format:string>>"


def boxes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per box of every page, in document order. Malformed markup is read leniently; null gives no rows."""
    names = [x.split()[0] for x in BOX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, b["tag"], b["classes"], b["offset"], b["anchors"], b["links"], b["text"], b["spans"]) for k, h in zip(pdf[id_col], pdf[html_col], strict=True) if h for n, b in enumerate(_Boxes(h).boxes)]
            yield pd.DataFrame(rows, columns=[id_col, *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, {BOX}")


def clean_lines(text: Column) -> Column:
    """Each line with spaces, tabs and hard spaces collapsed and trimmed; blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def bodies(rows: DataFrame, id_col: str, marker: Column, order: str = "pos", text_col: str = "text") -> DataFrame:
    """Bodies under headings: rows are dealt to the last marker before them (a running sum) and joined in order."""
    w = Window.partitionBy(id_col).orderBy(order)
    dealt = rows.withColumn("block", F.sum(marker.cast("int")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.when(~marker & F.col(text_col).rlike("[0-9A-Za-z]"), F.struct(F.col(order).alias("o"), F.col(text_col).alias("t"))))), lambda x: x["t"])
    return dealt.groupBy(id_col, "block").agg(F.max(F.when(marker, F.col(text_col))).alias("heading"), F.array_join(parts, "\n").alias("body"))


def section_id(title: Column) -> Column:
    """Normalised id: trimmed, n final stars as -fn<n>, no final dot, lower case, spaces as hyphens."""
    t = F.trim(title)
    stars = F.length(F.regexp_extract(t, r"(\*+)$", 1))
    bare = F.regexp_replace(t, r"\*+$", "")
    base = F.when(stars > 0, F.concat(bare, F.lit("-fn"), stars.cast("string"))).otherwise(bare)
    return F.regexp_replace(F.lower(F.regexp_replace(base, r"\.$", "")), " +", "-")


def qualified_ids(sections: DataFrame, module: str = "module_id", id_col: str = "section_id", parent: str = "parent_slug") -> DataFrame:
    """Ids that repeat in a module under two or more parents get their parent's slug before them."""
    shared = sections.groupBy(module, id_col).agg(F.countDistinct(parent).alias("n_parents")).where("n_parents > 1")
    joined = sections.join(shared, [module, id_col], "left")
    return joined.withColumn("qualified_id", F.when(F.col("n_parents").isNotNull(), F.concat(F.col(parent), F.lit("."), F.col(id_col))).otherwise(F.col(id_col))).drop("n_parents")
