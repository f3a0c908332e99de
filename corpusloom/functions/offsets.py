"""Maps between the places of a text and of what an edit makes of it, so that spans survive cleaning, joining and removal.

A map is a list of pieces (old start, new start, size): stretches of characters that both texts have. Maps
compose; a span goes to where its first and last surviving characters went.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass
class Map:
    text: str
    old: list[int]
    new: list[int]
    size: list[int]
    #: Where pieces end in the old text.
    ends: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.ends = [a + n for a, n in zip(self.old, self.size)]

    def span(self, start: int, end: int) -> tuple[int, int] | None:
        """Where a span went, or None if none of it is left."""
        a = bisect_right(self.ends, start)  # the first piece that ends after start
        b = bisect_left(self.old, end) - 1  # the last that starts before end
        if a > b or start >= end:
            return None
        return self.new[a] + max(start - self.old[a], 0), self.new[b] + min(end - self.old[b], self.size[b])

    def stretches(self, start: int, end: int) -> list[tuple[int, int]]:
        """The stretches of the new text that a span became; neighbours that touch are one."""
        out: list[tuple[int, int]] = []
        a = bisect_right(self.ends, start)
        while a < len(self.old) and self.old[a] < end:
            first = self.new[a] + max(start - self.old[a], 0)
            last = self.new[a] + min(end - self.old[a], self.size[a])
            if out and out[-1][1] == first:
                out[-1] = (out[-1][0], last)
            elif first < last:
                out.append((first, last))
            a += 1
        return out

    def then(self, other: Map) -> Map:
        """This map, and then one of its text."""
        if other.text == self.text and other.size == [len(other.text)]:
            return self
        pieces, i, j = [], 0, 0
        while i < len(self.old) and j < len(other.old):
            start, end = max(self.new[i], other.old[j]), min(self.new[i] + self.size[i], other.old[j] + other.size[j])
            if start < end:
                pieces.append((self.old[i] + start - self.new[i], other.new[j] + start - other.old[j], end - start))
            if self.new[i] + self.size[i] <= other.old[j] + other.size[j]:
                i += 1
            else:
                j += 1
        return _map(other.text, pieces)


def _map(text: str, pieces: Iterable[tuple[int, int, int]]) -> Map:
    rows = [p for p in pieces if p[2] > 0]
    return Map(text, [p[0] for p in rows], [p[1] for p in rows], [p[2] for p in rows])


def edited(text: str, edits: Iterable[tuple[int, int, str, bool]]) -> Map:
    """The map of edits (start, end, replacement, kept), by start and without overlaps; ``kept``: the replacement stands for the range's first characters."""
    parts, pieces, at, new = [], [], 0, 0
    for start, end, by, kept in edits:
        pieces.append((at, new, start - at))
        new += start - at
        if kept:
            pieces.append((start, new, min(len(by), end - start)))
        parts += [text[at:start], by]
        new += len(by)
        at = end
    parts.append(text[at:])
    pieces.append((at, new, len(text) - at))
    return _map("".join(parts), pieces)


def without(text: str, pattern: re.Pattern) -> Map:
    """What is left without all matches of a pattern."""
    return edited(text, ((m.start(), m.end(), "", False) for m in pattern.finditer(text)))


_BLANKS = re.compile("\\A[ \t\u00a0\n]+|[ \t\u00a0\n]+\\Z|[ \t\u00a0]*\n[ \t\u00a0\n]*|[ \t\u00a0]+")


def clean_lines(text: str) -> Map:
    """Spaces, tabs and hard spaces collapsed and trimmed in each line, blank lines dropped."""

    def edits():
        for m in _BLANKS.finditer(text):
            if m.start() == 0 or m.end() == len(text):
                yield m.start(), m.end(), "", False
            elif "\n" in m[0]:
                yield m.start(), m.end(), "\n", False
            else:
                yield m.start(), m.end(), " ", True

    return edited(text, edits())
