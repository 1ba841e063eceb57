"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tracewell.llm import simhash as S
from tracewell.plans import components as C

SCHEMA = "doc_id long, text string, key string, fingerprint int, part double"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows, prints):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return sorted(((doc_id, f"{prints[i]:016x}", best.get(find(i))) for i, (doc_id, _) in enumerate(rows)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 0.5) for i, t in rows], SCHEMA)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def texts(count, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 300))] for _ in range(count // 4)]
    for i in range(count):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(900)}"
        yield " ".join(words)


@pytest.mark.parametrize("heavy", [S.HEAVY, 4, 0])
def test_components_equal_all_pairs(spark, heavy):
    rows = list(enumerate(texts(160, 1))) + [
        (500, None), (501, ""), (502, " \t\x0b"), (503, "One"), (504, "ONE"), (505, "one two"), (506, "a b c d e"),
        (507, "É é Ä"), (508, "x " * 40_000), (509, "y" * 200_000), (None, "one"), (510, "one two"), (510, "one two"), (None, None)]
    prints = [plain_fingerprint(t or "") for _, t in rows]
    assert found(S.near_groups(frame(spark, rows), heavy=heavy)) == brute(rows, prints)


def test_bucket_links_connect_what_is_near():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 20, 90).astype(np.uint64)) for c in centre])
    keys = np.sort(rng.integers(0, 3, len(prints)))
    keys[:300] = 0
    keys = np.sort(keys)
    a, b = S.bucket_links(keys, prints, 4)

    def classes(pairs):
        label = {(k, int(p)): (k, int(p)) for k, p in zip(keys, prints)}
        for _ in range(len(prints)):
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        return label

    linked = [((k, int(x)), (k, int(y))) for x, y in zip(a, b) for k in {0, 1, 2} if (k, int(x)) in set(zip(keys, map(int, prints))) and (k, int(y)) in set(zip(keys, map(int, prints)))]
    every = [((k, int(p)), (k, int(q))) for k in {0, 1, 2} for p in prints[keys == k] for q in prints[keys == k] if (int(p) ^ int(q)).bit_count() <= 4]
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))
    assert len(a) < len(every)
    one, all_ = classes(sorted(set(linked))[:0] + list(dict.fromkeys(linked))), classes(list(dict.fromkeys(every)))
    assert one == all_


def test_stage_keeps_one_of_each_group(spark):
    docs = frame(spark, [(3, "same words here now again"), (1, "same words here now again"), (2, "other text of its own kind"), (None, "same words here now again")])
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert S.near_groups(docs.limit(0)).count() == 0


def near_prints(count, seed):
    """Distinct fingerprints around one, that differ from it by up to three bits."""
    rng = random.Random(seed)
    centre, found = rng.getrandbits(63), set()
    while len(found) < count:
        found.add(centre ^ sum({1 << rng.randrange(63) for _ in range(rng.randrange(1, 4))}))
    return sorted(found)


def test_runs_give_fewer_links_than_rows():
    for count in (2, 40, S.SMALL, S.SMALL + 1, 300):
        prints = np.array(near_prints(count, count), dtype=np.uint64)
        a, b = S.bucket_links(np.repeat([1, 2], count), np.tile(prints, 2), 4)
        assert len(a) <= 2 * (count - 1)
        assert (np.bitwise_count(a ^ b) <= 4).all()


@pytest.mark.parametrize("heavy", [S.HEAVY, 4])
def test_edges_grow_with_the_group_not_its_square(spark, monkeypatch, heavy):
    plain, seen = C.connected_components, []
    monkeypatch.setattr(C, "connected_components", lambda edges: seen.append(edges.count()) or plain(edges))
    for count in (60, 240):
        prints = near_prints(count, 7)
        seen.clear()
        got = S.fingerprint_components(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), heavy=heavy).collect()
        every = brute([(p, "") for p in prints], prints)
        assert sorted((r.fingerprint, f"{r.fingerprint:016x}", r.component) for r in got) == sorted(e for e in every if [x[2] for x in every].count(e[2]) > 1)
        assert seen and sum(seen) <= 1.5 * count


def test_contraction_changes_no_component(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(150), rng.randrange(150)) for _ in range(110)} | {(1000 + i, 1001 + i) for i in range(40)}
    edges |= {(3000 + i, 3000 + j) for i in range(12) for j in range(i)} | {(4000 - i, 4100 + j) for i in range(9) for j in range(9)} | {(5000, 5000)}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    assert sorted(C.contracted_components(df).collect()) == sorted(C.connected_components(df).collect())
    assert C.contracted_components(df.limit(0)).count() == 0
