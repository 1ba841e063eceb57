"""Contamination against a word-by-word search, on both ways of finding windows."""

import hashlib
import random

import pytest

from tracewell.llm import decontaminate as D

DOCS = "doc_id long, text string, words int, item string, start string"


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or ord(c) >= 128 else " " for c in text).split(" ")


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        have = [w for w in words(text) if w]
        hit, found = set(), set()
        for item_id, item in items:
            need = [w for w in words(item) if w]
            width = min(13, len(need))
            for i in range(len(need) - width + 1 if width and item_id is not None else 0):
                for j in range(len(have) - width + 1):
                    if have[j : j + width] == need[i : i + width]:
                        hit |= set(range(j, j + width))
                        found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(have), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(have)))
    return sorted(out, key=str)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "délta", "e9", "zeta"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 13, 14, 30])))) for i in range(12)]
    items += [(100, None), (101, " .,"), (None, items[0][1]), (3, items[4][1]), (9, "solo")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(items[:12])[1].split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(200, None), (201, ""), (202, "!?"), (203, "Solo!"), (203, "Solo!"), (None, "a solo b"), (204, "pad " * 50_000 + items[2][1])]
    return docs, items


@pytest.mark.parametrize("bound", [D.MAX_BENCHMARK_WORDS, 10])
def test_both_ways_equal_brute_force(spark, bound):
    docs, items = data()
    frame = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(frame, bench, max_benchmark_words=bound)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    assert D.contamination(frame.limit(0), bench, max_benchmark_words=bound).count() == 0
    assert D.contamination(frame, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("bound", [D.MAX_BENCHMARK_WORDS, 0])
def test_rows_are_judged_by_their_own_text(spark, bound):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, "clean", "a"), (1, passage, "b"), (None, f"x {passage}", "c"), (None, "y", "d"), (2, None, "e"), (2, f"{passage}, z", "f"), (2, f"{passage}, z", "g")]
    docs = spark.createDataFrame([(i, t, n, "w", 7) for i, t, n in rows], "doc_id long, text string, row string, text_key string, n_words int")
    bench = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    stays = D.drop_contaminated(docs, bench, max_benchmark_words=bound)
    assert stays.columns == docs.columns and sorted(r.row for r in stays.collect()) == ["a", "d", "e"]
    cut = D.remove_spans(docs, bench, max_benchmark_words=bound)
    assert cut.columns == docs.columns
    assert {r.row: r.text for r in cut.collect()} == {"a": "clean", "b": "", "c": "x ", "d": "y", "e": None, "f": ", z", "g": ", z"}
    assert D.drop_contaminated(docs.limit(0), bench, max_benchmark_words=bound).count() == 0


@pytest.mark.parametrize("bound", [D.MAX_BENCHMARK_WORDS, 0])
def test_removal_is_the_same_for_every_benchmark_size(spark, bound):
    docs, items = data()
    frame = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = D.WindowSet.of([(i, t) for i, t in items if i is not None and t is not None])
    want = [(i, None if t is None else D.without_hits(t, windows)) for i, t in docs]
    got = D.remove_spans(frame, bench, max_benchmark_words=bound)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame(
        [(1, f"Before, {passage.upper()}! after é", 5), (2, "clean", 6), (3, None, 7), (4, f"{passage} {passage}", 8)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert cut == {1: "Before, ! after é", 2: "clean", 3: None, 4: ""}
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, bench).collect()) == [2, 3]
    long_doc = spark.createDataFrame([(5, passage + " filler" * 248), (6, passage + " filler" * 247)], "doc_id long, text string")
    assert [r.doc_id for r in D.drop_contaminated(long_doc, bench).collect()] == [5]
