"""The structure of a bill's whole text: the codes that it amends, the sections inside each, and their paragraphs.

A bill's markers are found in one pass over its text, and its ranges come from them in order, so that they are
nested and disjoint; blocks are the ranges' texts cut at blank lines and labels.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.spantext import BLANK, WHITE

_W = f"[{WHITE}]"
#: A line that amends a code, a section's header, an article's, what begins a bill's end, and verbs of amending.
AMEND = rf"(?m)^{_W}*(?:\d+{_W}+)?Section{_W}+\d+[A-Z]?\.{_W}+[^.]{{0,200}}?\b(?:of{_W}+the|The){_W}+([A-Z][A-Za-z'{WHITE}]+?){_W}+(Code|Charter)\b[^.]{{0,80}}?\b(?:is|are)(?:{_W}+are)?{_W}+(?:hereby{_W}+)?amended\b"
HEADER = rf"(?m)^{_W}*(?:\d+{_W}+)?(?:SEC\.|SECTION|Section){_W}+([0-9][0-9A-Za-z.-]*)\.{_W}+([A-Z][A-Z0-9{WHITE}\-–—,;:&'()./]+)$"
ARTICLE = rf"(?m)^{_W}*ARTICLE{_W}+\d+[A-Z]?:"
CLOSING = rf"(?m)^(?:{_W}*(?:\d+{_W}+)?Section{_W}+\d+[A-Z]?\.{_W}+[A-Z]|APPROVED{_W}+AS{_W}+TO{_W}+FORM\b)"
AMENDED = rf"\b(?:is|are)(?:{_W}+are)?{_W}+(?:hereby{_W}+)?amended\b"
STRUCTURAL = (rf"(?i)\bby{_W}+adding{_W}+Chapter{_W}+[\w-]+", rf"(?i)\bis{_W}+hereby{_W}+repealed{_W}+in{_W}+its{_W}+entirety\b", rf"(?i)\brepealing{_W}+Chapter{_W}+[\w-]+{_W}+in{_W}+its{_W}+entirety\b", rf"(?i)\badding{_W}+(?:a{_W}+new{_W}+)?Article{_W}+[\w-]+")
#: Lines that begin a paragraph of their own.
BREAKS = (r"\[", rf"Ordinance[{BLANK}]+(?:amending|adopting|repealing|enacting|making|approving|authorizing)\b", r"Be it ordained\b", rf"Section[{BLANK}]+\d+[A-Z]?\.", rf"(?:SEC\.|SECTION)[{BLANK}]+\d", rf"\([a-z]+\)[{BLANK}]", rf"\(\d+\)[{BLANK}]", r"APPROVED AS TO FORM\b")
#: Fixed value: a subsection's label at the start of a line.
LABEL = rf"(?i)^{_W}*(\((?:[a-z]+|\d+)\))[{BLANK}]+"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{_W}+", " "))


def paragraphs(text: Column, breaks: str) -> Column:
    """The paragraphs of a text, as they stand: cut at blank lines and before lines that ``breaks`` fits."""
    return F.split(F.regexp_replace(text, rf"(?m)^(?=[{BLANK}]*(?:{breaks}))", "\n"), rf"\n(?:[{BLANK}]*\n)+")


def reflowed(text: Column) -> Column:
    """Wrapped lines joined to paragraphs, which blank lines part; what begins a paragraph of its own does so anywhere."""
    return F.array_join(F.filter(F.transform(paragraphs(text, "|".join(BREAKS)), _squeezed), lambda p: p != ""), "\n\n")


def structural_action(text: Column) -> Column:
    """The first words that add or repeal a whole chapter or article, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in STRUCTURAL))


#: What ``^`` and ``$`` mean in the patterns above: lines end with a line feed, a carriage return, both, or one of Unicode's separators.
_LINE, _END = "(?:(?<![^\n\x85\u2028\u2029])|(?<=\r)(?!\n))", "(?=[\r\x85\u2028\u2029]|(?<!\r)\n|\\Z)"


def _rule(pattern: str, line: str = _LINE) -> re.Pattern:
    """A pattern of lines, by default at a line's start, as Python reads it; its digits and white space are ASCII's."""
    own = pattern.removeprefix("(?m)^")
    own = own.removesuffix("$") + _END if own.endswith("$") else own
    return re.compile(line + own.replace(r"\d", "[0-9]").replace(r"\s", r" \t\n\r\f\v"))


_STARTS = _rule(_LINE)
#: What every marker holds after white space or a number at a line's start, and the kinds of markers by that word.
_WORD = re.compile(r"SEC(?:TION|\.)|Section|A(?:RTICLE|PPROVED)")
_RULES = {"group": _rule(AMEND), "header": _rule(HEADER), "article": _rule(ARTICLE), "closing": _rule(CLOSING)}
_KINDS = {"Section": ("group", "header", "closing"), "SECTION": ("header",), "SEC.": ("header",), "ARTICLE": ("article",), "APPROVED": ("closing",)}
_INDENT, _AMENDED, _NUMBER, _SPACES = _rule(f"{_W}*", ""), _rule(AMENDED, ""), _rule(rf"Section{_W}+(\d+[A-Z]?)\.", ""), _rule(f"{_W}+", "")
_WHITE = frozenset(c for c in map(chr, range(0x10000)) if _SPACES.fullmatch(c))
_LABEL, _BREAK, _GAP = re.compile(LABEL, re.ASCII), _rule(rf"(?=[{BLANK}]*(?ai:{LABEL.removeprefix(f'(?i)^{_W}*')}))"), re.compile(rf"\n(?:[{BLANK}]*\n)+")


def _white(text: str, at: int) -> int:
    """Where the white space begins that ends at a place."""
    while at and text[at - 1] in _WHITE:
        at -= 1
    return at


def _marks(text: str) -> dict[str, list[re.Match]]:
    """All matches of each kind of marker from left to right; patterns are tried only where one of their words leads a line."""
    found: dict[str, list[re.Match]] = {kind: [] for kind in _RULES}
    for word in _WORD.finditer(text):
        # an article's line may begin with white space, that of a form's approval with nothing, all others with a number too
        low = word.start() if word[0] == "APPROVED" else _white(text, word.start())
        if low < word.start() and word[0] != "ARTICLE":
            digits = low
            while digits and text[digits - 1] in "0123456789":
                digits -= 1
            low = _white(text, digits) if digits < low else low
        for kind in _KINDS[word[0]]:
            # the match before may go into this one's white space, or over it
            past = max(low, found[kind][-1].end() if found[kind] else 0)
            line = _STARTS.search(text, past, word.start() + 1) if past <= word.start() else None
            if line and line.start() <= word.start() and (m := _RULES[kind].match(text, line.start())):
                found[kind].append(m)
    return found


#: A range: kind, group_no, header_no, number, name, start, after, end.
_Range = tuple[str, int | None, int | None, str | None, str | None, int, int | None, int]


def _ranged(text: str) -> list[_Range]:
    """The ranges of one text, from its markers in order: preamble and closing, then groups and their headers."""
    found, size = _marks(text), len(text)
    starts = [m.start() for m in found["group"]]
    if not starts:
        return [("preamble", None, None, None, None, 0, None, size)]
    closing = size
    for m in found["closing"]:
        at = _INDENT.match(m[0]).end() + m.start()
        if at >= starts[-1] and not _AMENDED.search(text[at : at + 300]):
            closing = at
            break
    out: list[_Range] = [("preamble", None, None, None, None, 0, None, starts[0]), ("closing", None, None, None, None, closing, None, size)]
    inside: list[list[re.Match]] = [[] for _ in starts]
    for m in found["header"]:
        if m.start() >= starts[0]:
            inside[bisect.bisect_right(starts, m.start()) - 1].append(m)
    articles = [m.start() for m in found["article"]]
    for k, m in enumerate(found["group"]):
        follows = starts[k + 1] if k + 1 < len(starts) else None
        end = closing if follows is None else follows
        out.append(("group", k + 1, None, _NUMBER.search(m[0])[1], f"{m[1].strip(' ')} {m[2]}".strip(" "), m.start(), m.end(), end))
        for n, h in enumerate(inside[k]):
            until = inside[k][n + 1].start() if n + 1 < len(inside[k]) else size if follows is None else follows
            nth = bisect.bisect_right(articles, h.start())
            if nth < len(articles) and h.end() < articles[nth] < until:
                until = articles[nth]
            out.append(("header", k + 1, n + 1, h[1], _SPACES.sub(" ", h[2]).strip(" "), h.start(), h.end(), min(until, end)))
    return out


def _with_raw(text: str, found: list[_Range]) -> list[tuple]:
    """Ranges, each with the text that its blocks are made of: a group's ends where its first header begins, a header's begins after its title."""
    firsts = {r[1]: r[5] for r in reversed(found) if r[0] == "header"}
    return [(*r, text[r[6] if r[0] == "header" else r[5] : firsts.get(r[1], r[7]) if r[0] == "group" else r[7]]) for r in found]


_SHAPE = {"kind": pa.string(), "group_no": pa.int32(), "header_no": pa.int32(), "number": pa.string(), "name": pa.string(), "start": pa.int32(), "after": pa.int32(), "end": pa.int32(), "raw": pa.string()}


def ranges(bills: DataFrame, raw: bool = False) -> DataFrame:
    """Ranges of every bill's whole text: file_no, kind, group_no, header_no, number, name, start, after, end; with ``raw`` also raw,
    the text that :func:`blocks` makes of each, so that it need not be cut out of the whole text again.

    ``bills``: file_no, text. Kinds: preamble (up to the first group; all of a bill without groups), group (a code that is amended:
    name), header (a section inside a group: number and title; ``after`` is where the title ends) and closing. Ends are
    exclusive. An article's line ends the section before it. Null texts have no ranges. Each text is read once, where it is; nothing is shuffled.
    """
    names = [c for c in _SHAPE if raw or c != "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # large texts' pieces go on before the next texts are read
            for at in range(0, batch.num_rows, 1024):
                some, places, out = batch.slice(at, 1024), [], []
                for k, text in enumerate(some.column(1).to_pylist()):
                    found = _ranged(text)
                    out += _with_raw(text, found) if raw else found
                    places += [k] * len(found)
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(places, pa.int32())), *(pa.array(c, _SHAPE[n]) for c, n in zip(columns, names, strict=True))], names=["file_no", *names])

    key = bills.schema["file_no"].dataType.simpleString()
    kinds = ", ".join(f"`{n}` {'string' if _SHAPE[n] == pa.string() else 'int'}" for n in names)
    return bills.where("text is not null").select("file_no", "text").mapInArrow(run, f"file_no {key}, {kinds}")


def _cut(raw: str) -> list[tuple[int, str | None, int | None, str | None]]:
    """A section's paragraphs as (place, marker, subsection, text): cut at blank lines and before labels, each under the last label and its number among the labels."""
    out, marker, n = [], None, 0
    for place, part in enumerate(_GAP.split(_BREAK.sub("\n", raw)), 1):
        label = _LABEL.match(part)
        if label:
            marker, n, part = label[1], n + 1, part[label.end():]
        text = _SPACES.sub(" ", part).strip(" ") or None
        if text or label:
            out.append((place, marker, n or None, text))
    return out


_PARAGRAPH = {"place": pa.int32(), "marker": pa.string(), "subsection": pa.int32(), "text": pa.string()}
_PARAGRAPHS = "array<struct<place:int,marker:string,subsection:int,text:string>>"


def _paragraphs(raw: Column) -> Column:
    """Per raw text its paragraphs; null for null."""

    @F.arrow_udf(_PARAGRAPHS)
    def of(texts: pa.Array) -> pa.Array:
        ends, out = [0], []
        for text in texts.to_pylist():
            out += _cut(text) if text is not None else []
            ends.append(len(out))
        columns = list(zip(*out, strict=True)) or [()] * len(_PARAGRAPH)
        told = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARAGRAPH.values(), strict=True)], names=list(_PARAGRAPH))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told, mask=texts.is_null())

    return of(raw)


def blocks(bills: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks of bills: file_no, group_no, header_no, place, kind, number (of a header), marker, subsection, text.

    ``found`` of :func:`ranges`; if it has ``raw``, texts are not read again. Kinds: preamble, action and closing (reflowed), code_section_header
    (text: its title) and paragraph; a paragraph under a label has it as ``marker`` and its number among the labels as
    ``subsection``, and a label without text has a null text. All blocks of a range come from its row.
    """
    if "raw" not in found.columns:
        firsts = found.where("kind = 'header'").groupBy("file_no", "group_no").agg(F.min("start").alias("first"))
        held = found.join(bills.select("file_no", "text").where("text is not null"), "file_no").join(firsts, ["file_no", "group_no"], "left")
        a, b = F.when(F.col("kind") == "header", F.col("after")).otherwise(F.col("start")), F.when(F.col("kind") == "group", F.coalesce("first", "end")).otherwise(F.col("end"))
        found = held.select(*found.columns, F.substr("text", a + 1, b - a).alias("raw"))
    header = F.col("kind") == "header"
    # a title is a block before its paragraphs, any other range is one block
    one = F.array(F.struct(F.lit(0).alias("place"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("int").alias("subsection"), F.when(header, F.col("name")).otherwise(F.col("raw")).alias("text")))
    cut = found.withColumn("p", _paragraphs(F.when(header, F.col("raw"))))
    # an inner explode would have the paragraphs cut a second time, for a filter on their number
    rows = cut.select("file_no", "group_no", "header_no", "kind", "number", F.explode_outer(F.concat(one, F.coalesce("p", F.array().cast(_PARAGRAPHS)))).alias("b")).where("b is not null")
    rows = rows.select("file_no", "group_no", "header_no", "kind", "number", "b.*")
    titled = header & (F.col("place") == 0)
    kind = F.when(titled, "code_section_header").when(header, "paragraph").when(F.col("kind") == "group", "action").otherwise(F.col("kind"))
    return rows.select("file_no", "group_no", "header_no", "place", kind.alias("kind"), F.when(titled, F.col("number")).alias("number"), "marker", "subsection", F.when(header, F.col("text")).otherwise(reflowed(F.col("text"))).alias("text"))


def sections(found: DataFrame) -> DataFrame:
    """The sections inside bills' codes, a row each: file_no, group_no, header_no, number, title, paragraphs (place, marker, subsection, text), which are those of :func:`blocks`.

    ``found`` of :func:`ranges` with ``raw``.
    """
    return found.where("kind = 'header'").select("file_no", "group_no", "header_no", "number", F.col("name").alias("title"), _paragraphs(F.col("raw")).alias("paragraphs"))


def gated(made: DataFrame, found: DataFrame) -> DataFrame:
    """``made`` (blocks), or a failure if any bill lost a header that ``found`` has: nothing incomplete is written."""
    count = lambda rows, kind, name: rows.where(F.col("kind") == kind).groupBy("file_no").agg(F.count("*").alias(name))
    both = count(found, "header", "expected").join(count(made, "code_section_header", "emitted"), "file_no", "left")
    short = both.where("expected <> coalesce(emitted, 0)").select("file_no", F.raise_error(F.concat(F.lit("bill "), F.col("file_no").cast("string"), F.lit(": "), F.col("expected").cast("string"), F.lit(" headers found, "), F.coalesce("emitted", F.lit(0)).cast("string"), F.lit(" in blocks"))).alias("gate"))
    return made.join(short.where("gate is null"), "file_no", "left_anti")
