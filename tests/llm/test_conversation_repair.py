"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import pytest
from oracle import compare, connect

from tracewell.llm import conversation_repair as C
from tracewell.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies int"
SPACES = " \t\n\x0b\x0c\r"
#: state -> initial -> state of (s?(ua)+)?
PATTERN = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def search(rows):
    """Cheapest edits of rows (initial, must go, truncated): Dijkstra over (row, state), ties by letters."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, letters
        for x in "ua":
            if x in PATTERN[state]:
                heapq.heappush(heap, (cost + 3, letters + "I", i, PATTERN[state][x]))
        if i < len(rows):
            initial, gone, truncated = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state))
            if not gone:
                extra = 3 * truncated
                if initial in PATTERN[state]:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, PATTERN[state][initial]))
                for x in "ua":
                    if x in PATTERN[state]:
                        heapq.heappush(heap, (cost + extra + 3, letters + "R", i + 1, PATTERN[state][x]))


def plain(table):
    kept = {}
    for conv, turn, role, text in table:
        kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        chance = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if chance == 0:
            continue
        text = "" if chance == 1 else "".join(c for c in text if c not in ".!?") if chance == 2 else text
        kept[conv] += [(turn, "user" if chance == 4 else role, text)] * (2 if chance == 3 else 1)
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = search([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
        out, left, expect = [], iter(rows), "u"
        for letter in audit:
            _, role, text = next(left) if letter != "I" else (None, None, None)
            if letter == "D":
                continue
            if letter == "K":
                out.append(f"{role}:{text}")
                expect = "u" if role[0] in "sa" else "a"
                continue
            out.append({"u": "user", "a": "assistant"}[expect] + ":" + (text or "" if letter == "R" else ""))
            expect = "a" if expect == "u" else "u"
        yield (conv, gaps, *(faults.count(f) for f in C.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_edits_equal_search(block):
    tables, rng = C.BlockTables(block), random.Random(block)
    assert len(tables.vectors) < 200
    every = [(i, g, t) for i in "sua?" for g in (False, True) for t in (False, True)]
    cases = [list(c) for n in range(3) for c in itertools.product(every, repeat=n)] + [[rng.choice(every) for _ in range(rng.randrange(3, 14))] for _ in range(1500)]
    for rows in cases:
        symbols = [C.GONE if gone else 4 * t + "sua?".index(i) for i, gone, t in rows]
        assert tables.repair(np.array(symbols, dtype=int)) == search(rows), rows


def test_report_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["Hello.", "No end", "", " \t ", "Wow!", "Really? \n", " ", "a.b", "é…", "x" * 50_000 + "!", None]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "tool", "", None, "Users", "use"]), rng.choice(texts))
            for i in [*range(60), None] for t in [*range(rng.randrange(12)), *([None] * (i is None or i % 7 == 0)), *([3] * (i is not None and i % 5 == 0))]]
    rows += [(900, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), f"Turn {t}.") for t in range(500)]
    rows += rows[:20] + [(901, 10**12, "user", "Far."), (901, -5, "user", "Near."), (902, None, None, None)]
    got = C.repair_report(frame(spark, rows))
    assert found(got) == sorted(plain(rows), key=str)


def test_all_rows_dropped_and_no_rows(spark):
    turn = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(C.repair_report(frame(spark, [(5, turn, "user", "Hi.")]))) == [(5, 0, 0, 0, 0, 0, 0, "", empty)]
    assert C.repair_report(frame(spark, [])).count() == 0


def test_query_equals_brute_force_and_sql(spark):
    sf, name = "/root/testdata/sf0.001", "op11_conversation_repair"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES[name](spark, sf)) == sorted(plain(rows), key=str)
    got = compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES[name])
    assert got.startswith("ok") and "TYPES" not in got
