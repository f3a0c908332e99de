"""Result grids and detail pages of a legislation site, from HTML to rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid's class and the columns that it must have.
GRID, REQUIRED = "rgMasterTable", ("file #", "type", "status", "title")


class _Grid(HTMLParser):
    """Header cells and rows of the first grid of a page; a cell is its text and its first link."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.header: list[str] = []
        self.rows: list[list[list[str]]] = []
        self.depth, self.cell, self.done = 0, None, False
        self.feed(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = dict(attrs)
        if tag == "table" and not self.done and (self.depth or GRID in (have.get("class") or "").split()):
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = ["", ""]
            if tag == "td" and self.rows:
                self.rows[-1].append(self.cell)
        elif self.cell is not None and tag == "a" and not self.cell[1]:
            self.cell[1] = have.get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done |= not self.depth
        elif self.depth == 1 and tag in ("td", "th"):
            if tag == "th" and self.cell is not None:
                self.header.append(" ".join(self.cell[0].split()).lower())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data


_ROW = "file_no string, type string, status string, short_title string, detail_link string, problem string"


def grid_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of each page's grid; rows without a link are left out. A page without the grid or a column gives one row that names the problem."""
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf[id_col], pdf[html_col], strict=True):
                grid = _Grid(text or "")
                lacking = [c for c in REQUIRED if c not in grid.header]
                if lacking:
                    out.append((key, None, None, None, None, None, "no grid" if not grid.header else f"no column {lacking[0]}"))
                    continue
                at = [grid.header.index(c) for c in REQUIRED]
                for row in grid.rows:
                    if len(row) >= len(grid.header) and row[at[0]][1]:
                        out.append((key, *(" ".join(row[k][0].split()) for k in at), row[at[0]][1], None))
            yield pd.DataFrame(out, columns=[id_col, *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, {_ROW}")


def url_parameter(url: Column, name: str) -> Column:
    """A query parameter of a URL, whatever the case of its name; null if it is missing."""
    return F.nullif(F.regexp_extract(url, rf"(?i)[?&]{name}=([^&#]+)", 1), F.lit(""))


def us_date(text: Column) -> Column:
    """M/D/YYYY as an ISO date, else null."""
    part = lambda k: F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$", k)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))


def sponsor(text: Column) -> Column:
    """A sponsor's name; empty ones and a hyphen are null."""
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("-"))


def absolute_url(link: Column, base: str) -> Column:
    return F.when(link.rlike("(?i)^https?://"), link).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(link, "^/+", "")))


def next_page(html: Column) -> Column:
    """The argument of the post-back that leads to the page after the current one, null on the last."""
    current = F.nullif(F.regexp_extract(html, r'(?s)<a[^>]*class="[^"]*rgCurrentPage[^"]*"[^>]*>\s*(?:<span>)?\s*(\d+)', 1), F.lit(""))
    arguments = F.regexp_extract_all(html, F.lit(r"__doPostBack\('[^']*','(Page\$\d+)'\)"), F.lit(1))
    return F.element_at(F.filter(arguments, lambda a: a == F.concat(F.lit("Page$"), (current.cast("int") + 1).cast("string"))), 1)


def latest_version(attachments: Column) -> Column:
    """The attachment (struct name, url) with the highest ``Leg Ver n``, the first of equals; else the first one without a number."""
    number = lambda a: F.nullif(F.regexp_extract(a["name"], r"(?i)Leg\s+Ver\s*(\d+)", 1), F.lit("")).cast("int")
    numbered = F.filter(attachments, lambda a: number(a).isNotNull())
    highest = F.array_max(F.transform(numbered, number))
    plain = F.filter(attachments, lambda a: number(a).isNull() & a["name"].rlike(r"(?i)leg"))
    return F.coalesce(F.get(F.filter(numbered, lambda a: number(a) == highest), 0), F.get(plain, 0))
