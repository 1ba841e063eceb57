import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import similarity as J
from tracewell.plans import contains
from tracewell.plans.components import connected_components
from tracewell.plans.contains import contains_pairs


def _jac(a, b):
    return len(a & b) / len(a | b)


def _items(spark, sets):
    return spark.createDataFrame([(k, "", sorted(v)) for k, v in sets.items()], "sid string, created_at string, grams array<string>")


def _brute(sets, t):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and _jac(sets[a], sets[b]) >= t - 1e-12:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    out = {}
    for i in ids:
        if find(i) != i:
            j = _jac(sets[i], sets[find(i)])
            out[i] = (find(i), round(j, 3) if j >= t - 1e-12 else None)
    return out


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    sets = {}
    for c in range(6):
        base = set(rng.sample(words, 60))
        for m in range(8):
            drop = set(rng.sample(sorted(base), rng.randrange(0, 6)))
            sets[f"s{c}{m}"] = (base - drop) | set(rng.sample(words, rng.randrange(0, 3)))
    for i in range(10):
        sets[f"z{i}"] = set(rng.sample(words, 40))
    base = set(words[:100])
    for i in range(5):  # a chain: neighbours are close, the ends are not
        sets[f"c{i}"] = (base - set(words[i * 4 : i * 4 + 4])) if i else base
    sets["copy"] = set(sets["z0"])
    got = {r.sid: (r.rep, r.jaccard) for r in J.duplicate_clusters(_items(spark, sets)).collect()}
    assert got == _brute(sets, 0.9)


def test_chain_members_have_no_similarity(spark):
    words = [f"w{i:03d}" for i in range(120)]
    sets = {f"c{i}": set(words[i * 5 : 100 + i * 5]) for i in range(4)}
    got = {r.sid: (r.rep, r.jaccard) for r in J.duplicate_clusters(_items(spark, sets)).collect()}
    assert got["c1"][0] == "c0" and got["c1"][1] is not None
    assert got["c3"] == ("c0", None)


def test_components_on_a_chain_and_a_star(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"x{i}") for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert {got[f"x{i}"] for i in range(50)} == {"hub"}


@pytest.mark.parametrize("chars", [contains.AUTOMATON_CHARS, 0])
def test_contains_pairs(spark, monkeypatch, chars):
    monkeypatch.setattr(contains, "AUTOMATON_CHARS", chars)
    rng = random.Random(2)
    texts = {f"t{i}": "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60))) for i in range(30)}
    needles = {f"n{i}": "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 12))) for i in range(40)}
    t = spark.createDataFrame(list(texts.items()), "tid string, body string")
    n = spark.createDataFrame(list(needles.items()), "nid string, word string")
    got = {(r.tid, r.nid) for r in contains_pairs(t, n, "tid", "body", "nid", "word").collect()}
    assert got == {(a, b) for a, x in texts.items() for b, y in needles.items() if y and y in x}
    assert contains_pairs(t, n.limit(0), "tid", "body", "nid", "word").count() == 0
    held = contains_pairs(t.withColumn("g", F.length("body") % 2), n.withColumn("g", F.length("word") % 2), "tid", "body", "nid", "word", ["g"])
    same = {(a, b) for a, x in texts.items() for b, y in needles.items() if y and y in x and len(x) % 2 == len(y) % 2}
    assert held.columns == ["g", "tid", "nid"] and {(r.tid, r.nid) for r in held.collect()} == same


def test_seed_clusters_equal_the_sequential_greedy(spark):
    rng = random.Random(9)
    nodes = [f"s{i:02d}" for i in range(40)]
    sims = {}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if rng.random() < 0.08:
                sims[a, b] = round(0.35 + rng.random() / 2, 3)
    degree = {}
    for a, b in sims:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    taken, want = set(), set()
    for seed in sorted(degree, key=lambda x: (-degree[x], x)):
        if seed in taken:
            continue
        taken.add(seed)
        rows = {(seed, seed, 1.0)}
        for (a, b), s in sims.items():
            other = a if b == seed else b if a == seed else None
            if other and other not in taken:
                taken.add(other)
                rows.add((seed, other, s))
        if len(rows) >= 2:
            want |= rows
    df = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a string, b string, sim double")
    for limit in (J.COMPONENT_EDGES, 3, 0):  # components in tasks of their own, some of them, none
        assert {(r.seed, r.sid, r.sim) for r in J.seed_clusters(df, component_edges=limit).collect()} == want


def test_candidate_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    sets = []
    for i in range(140):
        pick = lambda n, names: rng.sample(names, rng.randrange(n + 1))
        base = f"{rng.randrange(8)}"
        title = [f"{base}{c}" for c in rng.sample("abcdefgh", rng.randrange(3, 8))] if rng.random() < 0.85 else []
        first = pick(9, [f"{base}{c}" for c in "efghijklmnop"]) if rng.random() < 0.8 else []
        sets.append((f"s{i:03d}", title, first, pick(3, ["t1", "t2", "t3"]) if rng.random() < 0.5 else []))
    w = {"title": 0.5, "first": 0.3, "tools": 0.2}
    want = {}
    for i, x in enumerate(sets):
        for y in sets[i + 1 :]:
            if not (set(x[1]) | set(x[2])) & (set(y[1]) | set(y[2])):
                continue
            present = [(n, set(a), set(b)) for n, a, b in zip(w, x[1:], y[1:]) if a and b]
            base = sum(w[n] for n, _, _ in present)
            sim = sum(w[n] * _jac(a, b) for n, a, b in present) / base if base else 0.0
            if sim >= 0.35:
                want[x[0], y[0]] = round(sim, 9)
    df = spark.createDataFrame(sets, "sid string, title_grams array<string>, first_grams array<string>, tools array<string>")
    assert {(r.a, r.b): round(r.sim, 9) for r in J.candidate_pairs(df).collect()} == want and len(want) > 50


def test_user_text_across_messages(spark):
    rows = [("s", 0, "user", "ab"), ("s", 1, "assistant", "zz"), ("s", 2, "user", " "), ("s", 3, "user", "c d"), ("t", 0, "assistant", "q")]
    messages = spark.createDataFrame(rows, "sid string, seq int, role string, raw string")
    assert {r.sid: sorted(r.grams) for r in J.session_grams(messages).collect()} == {"s": ["ab", "bc", "cd"]}
    assert {r.sid: sorted(r.g) for r in J.session_grams(messages, 3, "g").collect()} == {"s": ["ab"]}
    sessions = spark.createDataFrame([("s", "x"), ("t", "y")], "sid string, title string")
    assert [r.sid for r in J.zero_user_sessions(sessions, messages).collect()] == ["t"]


@pytest.mark.parametrize("rows, tile, bitmap", [(7, 2, 32_768), (1000, 5, 0), (1000, 2048, 32_768)])
def test_blocks_equal_brute_force_within_groups(spark, monkeypatch, rows, tile, bitmap):
    from tracewell.plans import similar

    monkeypatch.setattr(similar, "BLOCK_ROWS", rows)
    rng = random.Random(4)
    words = list(range(-60, 60))
    sets = {}
    for i in range(90):
        near = sets.get(f"s{rng.randrange(90):02d}")
        grams = set(near[1]) if near and rng.random() < 0.6 else set(rng.sample(words, rng.randrange(1, 60)))
        grams -= set(rng.sample(words, 3))
        sets[f"s{i:02d}"] = (i % 2, grams or {7})
    df = spark.createDataFrame([(g, k, sorted(v), len(v)) for k, (g, v) in sets.items()], "g int, cls string, grams array<bigint>, n int")
    for t in (0.5, 0.8, 0.9):
        want = {(a, b) for a, (g, x) in sets.items() for b, (h, y) in sets.items() if a < b and g == h and _jac(x, y) >= t - 1e-12}
        found = similar._blocks(df, ["g"], t, []).toPandas()
        got, forest = set(), []
        monkeypatch.setattr(similar, "TILE", tile)
        monkeypatch.setattr(similar, "BITMAP_GRAMS", bitmap)
        for _, part in found.groupby(["g", "band", "x", "y"]):
            pairs = [tuple(r) for r in similar._compared(t, [], False)(part)[["a", "b"]].to_numpy()]
            assert len(pairs) == len(set(pairs)) and not got & set(pairs)
            got |= set(pairs)
            forest += [tuple(r) for r in similar._compared(t, [], True)(part)[["a", "b"]].to_numpy()]
        assert got == want and set(forest) <= want and len(want) > 5
        label = {k: k for k in sets}
        for a, b in forest * 30:
            label[a] = label[b] = min(label[a], label[b])
        assert all(label[a] == label[b] for a, b in want)  # the forest links all that is similar
        assert {(r.a, r.b) for r in similar.class_pairs(df, t, ["g"]).collect()} == want


@pytest.mark.parametrize("prefix", [4, 4096])
def test_candidate_clusters_list_no_pairs(spark, monkeypatch, prefix):
    rng = random.Random(5)
    names = [f"{c}{d}" for c in "abcdef" for d in "xyz"]
    pick = lambda n: sorted(rng.sample(names, rng.randrange(n)))
    rows = [(f"s{i:03d}", pick(9), pick(12), sorted(rng.sample(["t1", "t2", "t3"], rng.randrange(3)))) for i in range(150)]
    rows += [("n", ["ax", "by"], None, ["t1"]), ("n2", ["ax", "by"], None, None)]
    df = spark.createDataFrame(rows, "sid string, title_grams array<string>, first_grams array<string>, tools array<string>")
    want = {(r.seed, r.sid, r.sim, r.size) for r in J.seed_clusters(J.candidate_pairs(df)).collect()}
    for name, value in (("PREFIX", prefix), ("TILE", 16), ("COLUMNS", 5), ("BLOCK_ROWS", 40)):
        monkeypatch.setattr(J.alike, name, value)
    raised = lambda *a, **b: pytest.fail("pairs were listed")
    for name in ("candidate_pairs", "connected_components"):
        monkeypatch.setattr(J, name, raised)
    got = {(r.seed, r.sid, r.sim, r.size) for r in J.candidate_clusters(df).collect()}
    assert got == want and len({r[0] for r in got}) > 3
    assert J.candidate_clusters(df.limit(0)).count() == 0


def _like_sets(rng, n, groups):
    words = list(range(-60, 60))
    sets = {}
    for i in range(n):
        near = sets.get(f"s{rng.randrange(n):03d}")
        grams = set(near[1]) if near and rng.random() < 0.6 else set(rng.sample(words, rng.randrange(30, 60)))
        sets[f"s{i:03d}"] = (i % groups, grams - set(rng.sample(words, 3)))
    return sets


@pytest.mark.parametrize("forest", [False, True])
def test_sets_of_many_blocks_are_written_once(spark, monkeypatch, forest):
    """Sets went by shuffle to every block of their band and the two beside it."""
    from tracewell.plans import similar

    written = []
    monkeypatch.setattr(similar, "materialize", lambda df, f=similar.materialize: written.append(f(df)) or written[-1])
    monkeypatch.setattr(similar, "BLOCK_ROWS", 8)
    sets = _like_sets(random.Random(6), 120, 1)
    df = spark.createDataFrame([(k, sorted(v, reverse=True), len(v), i) for i, (k, (_, v)) in enumerate(sets.items())], "cls string, grams array<bigint>, n int, place int")
    pairs = similar._met(df, 0.8, [], ["place"], forest)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {(r.a, r.b): (round(r.j, 9), r.a_place, r.b_place) for r in pairs.collect()}
    ids = sorted(sets)
    want = {(a, b): (round(_jac(sets[a][1], sets[b][1]), 9), int(a[1:]), int(b[1:])) for a in ids for b in ids if a < b and _jac(sets[a][1], sets[b][1]) >= 0.8}
    assert got.items() <= want.items() and len(want) > 20 and (forest or got == want)
    blocks = [bytes(r.block) for df in written if "block" in df.columns for r in df.collect()]
    held = {}
    for block in blocks:
        cls, n, vocabulary, grams, _ = similar._unpack(block)
        ends = n.cumsum()
        for c, size, end in zip(cls, n, ends):
            assert c not in held
            held[c] = set(vocabulary[grams[end - size : end]].tolist())
    assert held == {k: v for k, (_, v) in sets.items()} and len(blocks) > 12


@pytest.mark.parametrize("rows", [5, 32_768])
def test_clusters_of_large_and_small_groups(spark, monkeypatch, rows):
    """Also with copies, items without grams, a missing group and items that are known."""
    from tracewell.plans import similar

    monkeypatch.setattr(similar, "BLOCK_ROWS", rows)
    sets = _like_sets(random.Random(8), 90, 4)
    large = {k: (min(g, 2), {f"w{x}" for x in v}) for k, (g, v) in sets.items()}
    large |= {f"z{i}": (i % 3, large["s002"][1]) for i in range(6)} | {"y0": (7, {"a", "b"}), "y1": (7, {"b", "a"}), "y2": (7, set()), "x0": (None, {"a", "b"})}
    df = spark.createDataFrame([(k, None, g, sorted(v)) for k, (g, v) in large.items()], "sid string, created_at string, g int, grams array<string>")
    want = {}
    for g in (0, 1, 2, 7):
        want |= _brute({k: v for k, (h, v) in large.items() if h == g}, 0.9)
    got = J.duplicate_clusters(df, group=["g"])
    assert {r.sid: (r.rep, r.jaccard) for r in got.collect()} == want and len(want) > 10
    known = spark.createDataFrame([("s002",), ("y0",), ("s010",), ("none",)], "sid string")
    rest = {k: v for k, (_, v) in large.items() if k not in ("s002", "y0", "s010")}
    assert {r.sid: (r.rep, r.jaccard) for r in J.duplicate_candidates(df.drop("g"), known).collect()} == _brute(rest, 0.9)


def test_known_items_leave_by_their_ids(spark, monkeypatch):
    """Their join had gone below the grams and shuffled whole texts."""
    given = []
    monkeypatch.setattr(J, "stored", lambda df, f=J.stored: given.append(df) or f(df))
    df = _items(spark, {"a": {"x", "y"}, "b": {"x", "y"}, "c": {"x", "y"}})
    known = spark.createDataFrame([("a",)], "sid string")
    assert [(r.rep, r.sid, r.jaccard) for r in J.duplicate_candidates(df, known).collect()] == [("b", "c", 1.0)]
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_large_groups_send_no_copies(spark, monkeypatch):
    from oracle import compare, connect
    from tracewell.plans import similar
    from tracewell.workloads import ORACLES, QUERIES

    sf, name = "/root/testdata/sf0.001", "J4_filtered_clusters"
    monkeypatch.setattr(similar, "BLOCK_ROWS", 40)
    monkeypatch.setattr(similar, "_blocks", lambda *a, **b: pytest.fail("sets were sent to every block of three bands"))
    assert compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES[name]).startswith("ok")


def test_pairs_of_large_groups_send_no_copies(spark, monkeypatch):
    from tracewell.plans import similar

    monkeypatch.setattr(similar, "BLOCK_ROWS", 10)
    monkeypatch.setattr(similar, "_blocks", lambda *a, **b: pytest.fail("sets were sent to every block of three bands"))
    sets = {k: (f"g{g}", {f"w{x}" for x in v}) for k, (g, v) in _like_sets(random.Random(3), 60, 2).items()}
    sets |= {f"t{i}": sets[f"s{i:03d}"] for i in range(0, 60, 4)}
    holders = {}
    for k in sorted(sets):
        holders.setdefault((sets[k][0], frozenset(sets[k][1])), []).append(k)
    want = set()
    for (g, x), a in holders.items():
        for (h, y), b in holders.items():
            if g == h and a[0] < b[0] and (j := _jac(x, y)) >= 0.8:
                want.add((a[0], b[0], len(a), len(b), round(j, 3), "duplicate" if j >= 0.9 else "band"))
    df = spark.createDataFrame([(k, "", g, sorted(v)) for k, (g, v) in sets.items()], "sid string, created_at string, source string, grams array<string>")
    got = [(r.a, r.b, r.a_copies, r.b_copies, r.jaccard, r.kind) for r in J.similar_pairs(df, group=["source"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5 and any(x[2] + x[3] > 2 for x in want)
