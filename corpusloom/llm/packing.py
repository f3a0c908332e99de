"""Operator 4: mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window of WINDOW tokens gives each queue that is
not dry a quantum in proportion to its target; it serves as many whole tokens as its credit
allows, and what is left of the credit is its deficit, carried into the next window. A dry
queue's part goes to the others. After any window a queue has therefore served the whole part
of all the credit it ever got, and its deficit is the fraction (``Mixture.deficit``). Credits
are a function of the window's number, so deficits need no hand-over from task to task: every
task computes the windows of its own documents and all of them agree; tests hold this against
a round-robin that is carried out window by window. Inside a window the queues' slices follow
one another, and the line of all windows is cut into sequences; documents are cut freely, so
only the end of the line is not full, and it becomes sequences whose lengths are powers of
two, which need no padding.

Documents are encoded once, into a table in the shared folder that also holds each document's
place in its queue within its block (a task's share of the input); the blocks' bases come from
sums over that table without its ids.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage
from .tokens import some_at_a_time, word_tokens

SEQUENCE = 4096
#: Tokens of a window: the mixture holds in every 16 sequences.
WINDOW = 16 * SEQUENCE
END_OF_TEXT = 2
#: Targets of the query: shares by this power of a source's tokens, so that a large source does not crowd out the others.
TEMPERATURE = 0.5


class Mixture:
    """Where the tokens of each queue stand on the line of all windows.

    ``totals`` are the queues' tokens, ``targets`` their shares (any positive scale; without them,
    the totals). A queue's credit at level x is weight * (x - begin); the level of a window's end
    is where the credits of all queues, none above its total, sum to the windows' tokens. Queues
    without a target begin when all others are dry, in proportion to their totals. Levels come
    from sorted sums, in logarithmic time, so many queues cost no more than a few.
    """

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, window: int = WINDOW):
        self.names = sorted(totals)
        self.number = {s: k for k, s in enumerate(self.names)}
        self.window = window
        self.total = np.array([totals[s] for s in self.names], np.int64)
        self.end = int(self.total.sum())
        self.windows = -(-self.end // window)
        weight = np.array([(targets or {}).get(s, 0.0) if targets else float(totals[s]) for s in self.names], np.float64)
        named = weight > 0
        if named.any():
            weight[named] *= self.total[named].sum() / weight[named].sum() or 1.0
        lasts = (self.total[named] / weight[named]).max(initial=0.0)
        self.weight = np.where(named, weight, np.maximum(self.total, 1))
        self.begin = np.where(named, 0.0, lasts)
        dry = self.begin + self.total / self.weight
        # levels at which the sum of credits bends, the sum there, and its slope from there on
        at = np.concatenate([self.begin, dry])
        order = np.argsort(at, kind="stable")
        self.levels = at[order]
        self.slopes = np.cumsum(np.concatenate([self.weight, -self.weight])[order])
        self.sums = np.concatenate([[0.0], np.cumsum(self.slopes[:-1] * np.diff(self.levels))])
        self._bends = [x.tolist() for x in (self.levels, self.slopes, self.sums)]
        self._queues = list(zip(self.weight.tolist(), self.begin.tolist(), self.total.tolist(), strict=True))

    def level(self, window: int) -> float:
        """The level at the beginning of ``window``."""
        levels, slopes, sums = self._bends
        v = float(min(window * self.window, self.end))
        k = max(bisect.bisect_right(sums, v) - 1, 0)
        if k + 1 >= len(levels) or slopes[k] <= 0:
            return levels[k]
        return min(levels[k] + (v - sums[k]) / slopes[k], levels[k + 1])

    def credit(self, window: int) -> np.ndarray:
        """What each queue was given before ``window``, none more than its total."""
        if window >= self.windows:
            return self.total.astype(np.float64)
        return np.clip(self.weight * (self.level(window) - self.begin), 0, self.total)

    def served(self, window: int) -> np.ndarray:
        """Tokens of each queue in all windows before ``window``."""
        return np.floor(np.minimum(self.credit(window) + 1e-6, self.total)).astype(np.int64)  # a whole token is whole, whatever the last digits say

    def deficit(self, window: int) -> np.ndarray:
        """Credit that each queue carries into ``window``, in parts of a token."""
        return np.maximum(self.credit(window) - self.served(window), 0.0)

    def served_of(self, queue: int, window: int) -> int:
        """One queue's part of :meth:`served`."""
        weight, begin, total = self._queues[queue]
        if window >= self.windows:
            return total
        return math.floor(min(min(max(weight * (self.level(window) - begin), 0.0), total) + 1e-6, total))

    def window_of(self, queue: int, position: int) -> int:
        """The window that holds the queue's token ``position``."""
        weight, begin, _ = self._queues[queue]
        levels, slopes, sums = self._bends
        x = begin + (position + 1) / weight
        k = max(bisect.bisect_right(levels, x) - 1, 0)
        v = sums[k] + max(slopes[k], 0.0) * (x - levels[k])
        w = min(max(int(v // self.window), 0), self.windows - 1)
        while w > 0 and self.served_of(queue, w) > position:
            w -= 1
        while w + 1 < self.windows and self.served_of(queue, w + 1) <= position:
            w += 1
        return w

    def layout(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each queue: tokens served before and after ``window``, and where its slice begins on the line."""
        before, after = self.served(window), self.served(window + 1)
        size = after - before
        return before, after, before.sum() + np.cumsum(size) - size


def sequence_at(position: int, total: int, sequence: int = SEQUENCE) -> tuple[int, int, int]:
    """(sequence, offset in it, tokens of it from there on) at a position on a line of ``total`` tokens."""
    full = total // sequence
    if position < full * sequence:
        return position // sequence, position % sequence, sequence - position % sequence
    k, rest, at = full, total - full * sequence, position - full * sequence
    while True:
        part = 1 << (rest.bit_length() - 1)
        if at < part:
            return k, at, part - at
        k, rest, at = k + 1, rest - part, at - part


_TOKENS = "doc_id long, queue string, block int, start long, n long, ids binary"


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        encoder, used = word_tokens(name), {}
        for batch in batches:
            n = batch.num_rows
            starts, counts, raw = np.zeros(n, np.int64), np.zeros(n, np.int64), []
            names = batch.column("queue").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            encoded = (x for some in some_at_a_time(texts) for x in encoder.encode_all(some))
            for k, (queue, body) in enumerate(zip(names, encoded, strict=True)):
                ids = np.append(body, body.dtype.type(END_OF_TEXT))
                starts[k] = used.get(queue, 0)
                counts[k] = len(ids)
                used[queue] = used.get(queue, 0) + len(ids)
                raw.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("queue"), pa.array(np.full(n, block, np.int32)), pa.array(starts), pa.array(counts), pa.array(raw, pa.binary())], ["doc_id", "queue", "block", "start", "n", "ids"])

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long"


def _cut(mixture: Mixture, total: int, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        most = max((64 << 20) // (24 * max(len(mixture.names), 1)), 8)  # so many layouts are kept
        for batch in batches:
            rows: list[tuple] = []
            for doc, name, base, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "place", "n", "ids")), strict=True):
                data = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                queue = mixture.number[name]
                done, window = 0, mixture.window_of(queue, base)
                while done < n:
                    if window not in layouts:
                        if len(layouts) > most:
                            layouts.clear()
                        layouts[window] = mixture.layout(window)
                    before, after, line = layouts[window]
                    until = int(after[queue])
                    if until <= base + done:
                        window += 1
                        continue
                    seq, offset, room = sequence_at(int(line[queue]) + base + done - int(before[queue]), total, sequence)
                    size = min(n - done, until - base - done, room)
                    rows.append((doc, done, size, zlib.crc32(data[4 * done : 4 * (done + size)]), n, seq, offset, window))
                    done += size
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source", targets: dict[str, float] | None = None, temperature: float = 1.0, sequence: int = SEQUENCE, window: int = WINDOW, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Pack all documents into sequences of at most ``sequence`` tokens, a mixture of the queues in every window.

    ``targets`` maps values of ``queue_col`` to shares; queues that it does not name follow when all
    named ones are dry. Without it a queue's share is its tokens to the power ``temperature``.
    The driver holds one sum per queue. Returns one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, window. A null or empty text is the end token
    alone; a null queue is a queue of its own; null ids stay null and repeated rows are packed as
    often as they stand, in any order among themselves. Other columns are ignored, whatever
    their names; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = F.coalesce(F.concat(F.lit("q:"), F.col(queue_col).cast("string")), F.lit("null"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("queue"), F.col(text_col).alias("text"))
    encoded = stage(base.mapInArrow(_encode(vocabulary), _TOKENS), "tokens")
    sums = stage(encoded.groupBy("queue", "block").agg(F.sum("n").alias("sum")), "sums")
    totals = {r["queue"]: r["sum"] for r in sums.groupBy("queue").agg(F.sum("sum").alias("sum")).collect()}
    bases = sums.select("queue", "block", F.expr("sum(sum) over (partition by queue order by block rows between unbounded preceding and current row) - sum").alias("base"))
    bases = stage(bases, "bases")
    shares = {f"q:{k}": float(v) for k, v in targets.items()} if targets else {k: float(v) ** temperature for k, v in totals.items()}
    mixture = Mixture(totals, shares, window)
    placed = encoded.join(bases, ["queue", "block"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("place"), "n", "ids")
    return placed.mapInArrow(_cut(mixture, mixture.end, sequence), _PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, queues by source with targets by TEMPERATURE, sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), temperature=TEMPERATURE)


#: SQL has no tokenizer; tests hold the query against the library's ids.
SQL: dict[str, str] = {}
QUERIES = {"op4_packing": op4_packing}
