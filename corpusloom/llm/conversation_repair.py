"""Operator 13: conversations repaired by A-star search on their edit lattice.

A node of the lattice is (rows read, state of the grammar): nothing yet, after a system turn, after a user
turn, after an assistant turn. Edits lead on: keep (0), give another role (2), delete (3, the
only way on for a blank or repeated row), insert an empty turn (2); a truncated row that stays adds 1. The
heuristic is the suffix sum of what no path escapes: 3 for each row that must go, 1 for each truncated one.
The queue is ordered by (cost + heuristic, audit), so the first goal that leaves it is the
cheapest and, of the cheapest, the least in ASCII. Two audits of equal cost that lead to one node are never
prefixes of one another (what one has more would be inserts, which cost), so a node is closed when it first leaves the queue.

Rows are put in order by a range sort of the whole table and read in runs of at most ROWS rows, so a conversation of any
length is worked on by many tasks. A run that is a whole conversation is solved at once. The others are solved from
each state of the grammar, and the runs of a conversation are joined at the states where they meet.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage

#: A run of rows that one search covers, at most, and about so many characters.
ROWS, CHARACTERS = 256, 1 << 20
#: White space: blank rows hold nothing else, and it doesn't count as the last character.
SPACE = " \t\n\x0b\x0c\r"
#: The turns that may follow in each state (nothing yet, system, user, assistant) and the state after them; states in which a conversation may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = ("u", "u", "a", "u")
ENDS = (0, 3)
#: What ends a conversation from each state: cost and inserts.
TAIL = ((0, ""), (4, "II"), (2, "I"), (0, ""))
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def cheapest(initials: str, faults: str, entry: int = 0, ends: tuple[int, ...] | None = ENDS) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) from state ``entry`` over all rows by the state reached: of the first of ``ends`` that is reached, or, without inserts after the last row, of all states.

    ``initials`` has one role initial a row; ``faults`` one letter: b(lank), d(uplicate), t(runcated) or -.
    """
    n = len(initials)
    due = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        due[i] = due[i + 1] + (3 if faults[i] in "bd" else 1 if faults[i] == "t" else 0)
    queue, closed, found = [(due[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - due[i]
        if i == n:
            if ends is None:
                found[state] = (cost, audit)
            elif state in ends:
                return {state: (cost, audit)}
        after = NEXT[state][DUE[state]]
        if i < n or ends is not None:  # between runs, inserts belong to the later one
            heapq.heappush(queue, (f + 2, audit + "I", i, after))
        if i < n:
            to = due[i + 1] + cost
            heapq.heappush(queue, (to + 3, audit + "D", i + 1, state))
            if faults[i] not in "bd":
                stays = to + (faults[i] == "t")
                if initials[i] in NEXT[state]:
                    heapq.heappush(queue, (stays, audit + "K", i + 1, NEXT[state][initials[i]]))
                heapq.heappush(queue, (stays + 2, audit + "R", i + 1, after))
    return found


def edited(audit: str, entry: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stand after the edits."""
    state, rows = entry, zip(roles, texts, strict=True)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else DUE[state]
        yield edit, role if edit == "K" else ROLE[initial], text
        state = NEXT[state][initial]


def _joined(turns: Iterable[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in turns)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text after the faults that crc32 of ``conv:turn`` deals out (modulo 20); nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes the signs that end sentences out of it, 3 repeats the row, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return out.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


class _Run:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, first: bool) -> None:
        self.conv, self.first = conv, first
        self.roles, self.texts, self.turns, self.initials, self.faults, self.size = [], [], [], [], [], 0

    def add(self, r: dict, again: bool) -> None:
        self.roles.append(r["role"])
        self.texts.append(r["text"])
        self.turns.append(r["turn"])
        self.initials.append(r["role"][:1] or " ")
        self.faults.append("b" if r["blank"] else "d" if again or r["earlier"] else "t" if r["cut"] else "-")
        self.size += len(r["text"])

    def row(self, seq: int, whole: bool) -> dict:
        initials, faults = "".join(self.initials), "".join(self.faults)
        known = [t for t in self.turns if t is not None]
        out = {
            "conv": self.conv, "seq": seq, "whole": whole, "roles": self.roles, "texts": self.texts, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1],
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)), "paths": [], "cost": None, "audit": None, "sha": None,
        }
        if whole:
            ((out["cost"], out["audit"]),) = cheapest(initials, faults).values()
            out["sha"] = hashlib.sha256(_joined(edited(out["audit"], 0, self.roles, self.texts)).encode("utf-8", "replace")).hexdigest()
        else:
            out["paths"] = [{"entry": e, "exit": x, "cost": c, "audit": a} for e in range(4) for x, (c, a) in cheapest(initials, faults, e, None).items()]
        return out


def runs(rows: DataFrame, most: int = ROWS, name: str = "runs") -> DataFrame:
    """Faults and searches of ``rows`` (conv, turn, role, text; texts and roles not null), one row per run.

    A conversation's rows are ordered by turn (nulls first), role and text. ``whole`` runs have cost, audit and sha; of the others
    ``paths`` tells the cheapest way between all states.
    """
    small_batches(rows.sparkSession)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # the first place of each role and text that a conversation repeats; what is shuffled are digests
    repeated = rows.select("conv", same.alias("same"), at.alias("at")).groupBy("conv", "same").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n > 1")
    repeated = repeated.select(F.col("conv").alias("_conv"), "same", F.col("at").alias("since"))
    held = rows.withColumn("same", same).join(repeated.withColumnRenamed("same", "_same"), F.expr("conv <=> _conv and same = _same"), "left")
    held = held.select("conv", "turn", "role", "text", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"), F.coalesce(F.col("since") < at, F.lit(False)).alias("earlier"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    path = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("exit", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    schema = T.StructType([T.StructField("conv", kinds["conv"])] + [
        T.StructField(c, k) for c, k in (
            ("seq", T.LongType()), ("whole", T.BooleanType()), ("roles", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.StringType())), ("blank", T.LongType()), ("duplicate", T.LongType()),
            ("truncated", T.LongType()), ("illegal", T.LongType()), ("first_initial", T.StringType()), ("last_initial", T.StringType()), ("first_turn", kinds["turn"]), ("last_turn", kinds["turn"]),
            ("turns", T.LongType()), ("paths", T.ArrayType(path)), ("cost", T.LongType()), ("audit", T.StringType()), ("sha", T.StringType()),
        )
    ])
    arrow = None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        if arrow is None:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
        seq = TaskContext.get().partitionId() << 33
        run, before, first = None, None, True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if run is not None and r["conv"] != run.conv:
                    out.append(run.row(seq, not run.first))
                    seq, run, first, before = seq + 1, None, False, None
                elif run is not None and (len(run.roles) >= most or run.size >= CHARACTERS):
                    out.append(run.row(seq, False))
                    seq, run, first = seq + 1, None, True
                run = run or _Run(r["conv"], first)
                this = (r["turn"], r["role"], r["text"])
                run.add(r, this == before)
                before = this
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if run is not None:  # it may go on in the next partition
            yield pa.RecordBatch.from_pylist([run.row(seq, False)], schema=arrow)

    # Equal rows are never split by the sort, so that copies of a row are seen side by side.
    ordered = held.orderBy(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")
    return stage(ordered.mapInArrow(read, schema), name)


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cheapest way through the runs of one conversation: entry state, cost and audit of each run, and what its border adds."""
    pdf = pdf.sort_values("seq")
    # By state: cost so far, and the place of the audit so far among those of all states. No audit up to a border is a prefix of
    # another (a run that isn't the last ends with an edit of a row), so these places and the run's own audits order whole audits.
    best: dict[int, tuple[int, int]] = {0: (0, 0)}
    back: list[dict[int, tuple]] = []
    for paths in pdf["paths"]:
        reached: dict[int, tuple] = {}
        for p in paths:
            if p["entry"] in best:
                cost, place = best[p["entry"]]
                way = (cost + p["cost"], place, p["audit"], p["entry"], p["cost"])
                if p["exit"] not in reached or way[:3] < reached[p["exit"]][:3]:
                    reached[p["exit"]] = way
        back.append(reached)
        order = sorted(reached, key=lambda x: reached[x][1:3])
        best = {x: (reached[x][0], order.index(x)) for x in reached}
    state = min(best, key=lambda x: (best[x][0] + TAIL[x][0], best[x][1]))
    tail = TAIL[state]
    chosen = []
    for reached in reversed(back):
        _, _, audit, entry, cost = reached[state]
        chosen.append((entry, cost + tail[0], audit + tail[1]))
        state, tail = entry, TAIL[0]
    out = pd.DataFrame({"seq": pdf["seq"].to_numpy(), "entry": [c[0] for c in chosen[::-1]], "cost": [c[1] for c in chosen[::-1]], "audit": [c[2] for c in chosen[::-1]]})
    last, first = pdf["last_initial"].shift(), pdf["first_initial"]
    out["edge"] = [int(isinstance(a, str) and a + b not in LEGAL) for a, b in zip(last, first)]
    seen, shared = None, []
    for a, b in zip(pdf["first_turn"], pdf["last_turn"]):
        shared.append(int(a is not None and not pd.isna(a) and a == seen))
        seen = seen if b is None or pd.isna(b) else b
    out["shared"] = shared
    return out


def settled(found: DataFrame, name: str = "settled") -> DataFrame:
    """``found`` (of :func:`runs`) with the way through every run: entry, cost, audit, and edge and shared, which borders between runs add to illegal and take from turns."""
    parts = found.where("not whole")
    ways = parts.select("conv", "seq", "paths", "first_initial", "last_initial", "first_turn", "last_turn").groupBy("conv").applyInPandas(_chosen, "seq long, entry int, cost long, audit string, edge long, shared long")
    ways = stage(ways, name)
    zero = F.lit(0)
    whole = found.where("whole").withColumns({"entry": zero, "edge": zero.cast("long"), "shared": zero.cast("long")})
    return whole.unionByName(parts.drop("cost", "audit").join(ways, "seq")).drop("paths")


def report(settled_runs: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    gaps = lambda lo, hi, n: F.coalesce(hi - lo + 1 - n, F.lit(0)).cast("long").alias("gaps")
    counts = ("blank", "duplicate", "truncated")
    whole = settled_runs.where("whole").select("conv", gaps(F.col("first_turn"), F.col("last_turn"), F.col("turns")), *counts, "illegal", "cost", "audit", "sha")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "audit"))), lambda x: x["audit"]), "")
    parts = settled_runs.where("not whole").groupBy("conv").agg(
        gaps(F.min("first_turn"), F.max("last_turn"), F.sum(F.col("turns") - F.col("shared"))), *(F.sum(c).alias(c) for c in counts),
        F.sum(F.col("illegal") + F.col("edge")).alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"),
    )
    sums = digests(settled_runs.where("not whole")).withColumnRenamed("conv", "_conv")
    return whole.unionByName(parts.join(sums, F.expr("conv <=> _conv")).drop("_conv"))


def digests(settled_runs: DataFrame) -> DataFrame:
    """conv, sha of the repaired conversations, their runs read in order; a task holds one run at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, conv, sha, some = None, None, None, False
        done: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field("conv").type
            for r in batch.to_pylist():
                if sha is None or r["conv"] != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, some = r["conv"], hashlib.sha256(), False
                turns = list(edited(r["audit"], r["entry"], r["roles"], r["texts"]))
                if turns:
                    sha.update((("\n" if some else "") + _joined(turns)).encode("utf-8", "replace"))
                    some = True
        if sha is not None:
            done.append((conv, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([s for _, s in done], pa.string())], names=["conv", "sha"])

    ordered = settled_runs.select("conv", "seq", "entry", "audit", "roles", "texts").repartition("conv").sortWithinPartitions("conv", "seq")
    return ordered.mapInArrow(read, T.StructType([settled_runs.schema["conv"], T.StructField("sha", T.StringType())]))


def repaired(settled_runs: DataFrame) -> DataFrame:
    """The turns of all repaired conversations: conv, seq and place (in order within the conversation), edit (K, R or I), role, text."""

    @F.pandas_udf("array<struct<edit string, role string, text string>>")
    def of(audit: pd.Series, entry: pd.Series, roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("edit", "role", "text"), t)) for t in edited(a, e, list(r), list(x))] for a, e, r, x in zip(audit, entry, roles, texts)], dtype=object)

    turns = settled_runs.select("conv", "seq", F.posexplode(of("audit", "entry", "roles", "texts")).alias("place", "t"))
    return turns.select("conv", "seq", "place", "t.edit", "t.role", "t.text")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of the conversations in ``rows``.

    Null roles and texts count as one space; null turns come first and null conversation ids form one conversation.
    Rows of one turn are ordered by role, then text, so that the result doesn't depend on how rows lie; equal rows are repeats. A role without
    characters fits nowhere and is renamed or deleted. Texts are of any length; extra columns are not read. An empty table
    gives empty results.
    """
    space = F.lit(" ")
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    found = settled(runs(plain))
    return report(found), repaired(found)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged and repaired; those of which no row is left have zeros."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    there = damaged(rows)
    told = report(settled(runs(there)))
    space, zero = F.lit(" "), F.lit(0).cast("long")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    gone = rows.groupBy("conv_id").agg(F.max((F.crc32(key) % 20 != 0).cast("int")).alias("some")).where("some = 0")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    gone = gone.select("conv_id", *(zero.alias(c) for c in counts), F.lit("").alias("audit"), F.lit(EMPTY_SHA).alias("repaired_sha256"))
    return told.select(F.col("conv").alias("conv_id"), *counts, "audit", F.col("sha").alias("repaired_sha256")).unionByName(gone)


#: crc32 and searches have no SQL in the oracle's engine; tests hold the query against a brute-force version.
SQL: dict[str, str] = {}
QUERIES = {"op13_conversation_repair": op13_conversation_repair}
