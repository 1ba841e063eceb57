"""Budgets against one-by-one water filling, selections against an ordered walk."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, domain string, epoch int, budget int"
WEIGHTS = {"d0": 5, "d1": 3, "d2": 0, "d0/en": 4, "d1/de": 2, "d0/en/s1": 7}


def split(budget, children):
    """Round after round: full children leave, the rest share what remains."""
    got, left, open_ = {}, budget, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while open_:
        name, weight, capacity = open_[0]
        share = sum(w for _, w, _ in open_)
        if capacity * share > left * weight:
            return got | {n: math.floor(left * w / share) for n, w, _ in open_}
        got[name] = capacity
        left -= capacity
        open_ = open_[1:]
    return got


def brute(rows, weights, budget_share, epochs, seed):
    docs = [(i, d or "", lang or "", s or "", len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, t, lang, s, d, *_ in rows]
    held = {}
    for _, d, lang, s, n in docs:
        held[d, lang, s] = held.get((d, lang, s), 0) + n
    total = sum(held.values()) * epochs
    budgets = {(): min(total, math.floor(total / epochs * budget_share))}
    for depth in range(3):
        nxt = {}
        for parent, budget in budgets.items():
            names = sorted({k[depth] for k in held if k[:depth] == parent})
            children = [
                (n, weights.get("/".join((*parent, n)), 1), epochs * sum(v for k, v in held.items() if k[: depth + 1] == (*parent, n))) for n in names]
            for name, got in split(budget, [c for c in children if c[1] > 0]).items():
                nxt[(*parent, name)] = got
        budgets = nxt
    out = []
    for leaf, budget in budgets.items():
        if not held[leaf] or not budget:
            continue
        whole, rest = divmod(budget, held[leaf])
        mine = [x for x in docs if x[1:4] == leaf]
        out += [(*x, e) for e in range(whole) for x in mine]
        key = lambda x: (hashlib.md5(f"{seed}:{whole}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[4])
        upto = 0
        for x in sorted(mine, key=key) if rest else []:
            upto += x[4]
            if upto > rest:
                break
            out.append((*x, whole))
    return sorted(out, key=str)


def data(count, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        domain = rng.choice(["d0", "d0", "d1", "d2", "d3"])
        text = " ".join("w" for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s0", "s1", "s2"]), domain, 1, 2))
    return rows + [(9000, None, None, None, "d0", 1, 2), (9001, "a\tb  c", None, None, "d0", 1, 2), (9002, "long " * 30_000, "en", "s9", "d1", 1, 2),
                   (7, rows[7][1], *rows[7][2:]), (None, "one two", "en", "s0", "d1", 1, 2)]


def found(df):
    row = ["document.doc_id", "domain", F.coalesce("document.lang", F.lit("")), F.coalesce("document.source", F.lit("")), "n_tokens", "epoch"]
    return sorted(map(tuple, df.select(*row).collect()), key=str)


@pytest.mark.parametrize(("share", "epochs", "bucket_rows"), [(0.75, 2, 1024), (0.3, 1, 3), (2.5, 4, 7), (9.0, 2, 5)])
def test_mixture_equals_brute_force(spark, share, epochs, bucket_rows):
    rows = data(250, 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = M.mix(docs, WEIGHTS, F.col("domain"), budget_share=share, max_epochs=epochs, seed=5, bucket_rows=bucket_rows)
    assert found(mixed) == brute(rows, WEIGHTS, share, epochs, 5)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "s", 10), ("a", "y", "s", 500), ("b", "x", "s", 500), ("b", "y", "s", 500)], "domain string, lang string, source string, capacity long")
    got = {(r.domain, r.lang): r.budget for r in M.leaf_budgets(leaves, {}, F.lit(400)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    tight = leaves.withColumn("capacity", F.when(F.col("domain") == "a", 10).otherwise(F.col("capacity")))
    got = {(r.domain, r.lang): r.budget for r in M.leaf_budgets(tight, {}, F.lit(400)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 10, ("b", "x"): 190, ("b", "y"): 190}


def test_empty_tables(spark):
    docs = spark.createDataFrame(data(9, 1), SCHEMA)
    assert M.mix(docs.limit(0)).count() == 0
    assert M.mix(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
