"""Operator 13 against a brute-force version: all edit scripts of short conversations, dynamic programming for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusloom.llm import conversation_repair as cr
from corpusloom.llm import queries

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def by_all_scripts(initials, faults):
    """Every script with at most two inserts between rows."""
    best = None
    places = [["D"] if f in "bd" else ["D", "K", "R"] for f in faults]
    for edits in itertools.product(*places):
        for gaps in itertools.product(range(3), repeat=len(edits) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            cost = 2 * sum(gaps) + sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and f == "t") for e, f in zip(edits, faults))
            kept = [None if e == "R" else i for e, i in zip(edits, initials)]
            slots, rows = [], iter(kept)
            for e in audit:
                x = next(rows) if e != "I" else None
                if e != "D":
                    slots.append(x)
            # unknown roles follow from their places
            for system in (False, True):
                want = ["s"] * system + [x for _, x in zip(range(len(slots) - system), itertools.cycle("ua"))]
                fits = len(want) == len(slots) and all(a is None and w != "s" or a == w for a, w in zip(slots, want))
                if fits and SHAPE.match("".join(want)) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def by_tables(initials, faults):
    """Bellman rounds over (rows read, state) with (cost, audit) as values."""
    n = len(initials)
    at = {(0, 0): (0, "")}
    for i in range(n + 1):
        for _ in range(4):
            for s in range(4):
                if (i, s) in at:
                    c, a = at[i, s]
                    to = (i, 3 if s == 2 else 2)
                    at[to] = min(at.get(to, (10**9, "")), (c + 2, a + "I"))
        if i == n:
            break
        for s in range(4):
            if (i, s) not in at:
                continue
            c, a = at[i, s]
            ways = [(s, c + 3, a + "D")]
            if faults[i] not in "bd":
                c += faults[i] == "t"
                due = 3 if s == 2 else 2
                ways.append((due, c + 2, a + "R"))
                if initials[i] == ("a" if s == 2 else "u"):
                    ways.append((due, c, a + "K"))
                if initials[i] == "s" and s == 0:
                    ways.append((1, c, a + "K"))
            for to, *value in ways:
                at[i + 1, to] = min(at.get((i + 1, to), (10**9, "")), tuple(value))
    return min(at[n, s] for s in (0, 3) if (n, s) in at)


def test_search_finds_the_least_script():
    for n in range(4):
        for initials in itertools.product("sua ", repeat=n):
            for faults in itertools.product("-tb", repeat=n):
                (got,) = cr.cheapest("".join(initials), "".join(faults)).values()
                assert got == by_tables(initials, faults)
                assert got == by_all_scripts(initials, faults)
    pick = random.Random(3)
    for _ in range(300):
        n = pick.randint(4, 30)
        initials, faults = "".join(pick.choices("suax", (1, 5, 5, 1), k=n)), "".join(pick.choices("-tbd", (6, 2, 1, 1), k=n))
        (got,) = cr.cheapest(initials, faults).values()
        assert got == by_tables(initials, faults)


def brute(rows):
    """The contract, row by row. ``rows``: (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = "", set()
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[1][:1] or " " for r in kept]
        turns = {r[0] for r in kept} - {None}
        cost, audit = by_tables(initials, faults)
        repaired, rest, due = [], iter(kept), "u"
        for e in audit:
            _, role, text = next(rest) if e != "I" else (None, "", "")
            if e != "D":
                role = role if e == "K" else {"u": "user", "a": "assistant"}[due]
                repaired.append(f"{role}:{text}")
                due = "a" if role[0] == "u" else "u"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def test_query_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, sf_dir).collect()
    assert {r["conv_id"]: tuple(r[f] for f in (*FIELDS, "repaired_sha256")) for r in got} == brute(rows)
    assert len(got) == len({r["conv_id"] for r in got})


@pytest.mark.parametrize("most", [1, 3, 256])
def test_runs_meet(spark, most):
    """Long conversations, nulls in every column, repeats, gaps, odd roles and a clashing column, cut into short runs."""
    pick = random.Random(most)
    texts = ["Hello there.", "And then", "  \n", "", None, "Why?", "word " * 3_000 + "!", "same.", "same."]
    rows = [(c, t, pick.choice(["user", "assistant", "system", "tool", "", None]), pick.choice(texts)) for c in (1, 2) for t in range(0, 160, pick.randint(1, 3))]
    rows += [(3, None, "user", "x."), (3, None, None, None), (None, 5, "user", "a."), (None, None, "assistant", "b."), (4, 7, "system", "")] + rows[5:40] + rows[5:9]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(4)
    found = cr.settled(cr.runs(cr.damaged(df), most=most))
    got = {r["conv"]: tuple(r[f] for f in (*FIELDS, "sha")) for r in cr.report(found).collect()}
    want = {k: v for k, v in brute(rows).items() if k in got or v[6]}
    assert got == want
    turns = {}
    for r in cr.repaired(found).orderBy("seq", "place").collect():
        turns.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    assert {k: hashlib.sha256("\n".join(turns.get(k, [])).encode()).hexdigest() for k in got} == {k: v[7] for k, v in want.items()}


def test_empty_table_and_undamaged_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Well")], "conv_id long, turn long, role string, text string")
    told, turns = cr.repair(df)
    assert {r["conv"]: (r["cost"], r["audit"]) for r in told.collect()} == {1: (0, "KK"), 2: (3, "D")}
    assert sorted((r["conv"], r["edit"], r["role"], r["text"]) for r in turns.collect()) == [(1, "K", "assistant", "Yes."), (1, "K", "user", "Hi.")]
    told, turns = cr.repair(df.limit(0))
    assert told.collect() == [] and turns.collect() == []
