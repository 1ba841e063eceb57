"""Whitening against numpy's eigensolver and exact integers."""

import math

import numpy as np
import pytest

from tracewell.llm import whitening as W
from tracewell.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5) for i, v in rows], SCHEMA)


def symmetric(n, spectrum, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return (q * spectrum) @ q.T


@pytest.mark.parametrize(
    "matrix",
    [
        symmetric(40, np.linspace(1, 9, 40)),
        symmetric(30, np.array([5.0] * 6 + [4.999999] * 4 + [1.0] * 20)),
        symmetric(25, np.geomspace(1e-12, 1e6, 25)),
        np.diag([3.0, 3.0, 2.0, 7.0, 7.0, 0.0]),
        np.zeros((4, 4)),
        np.array([[2.5]]),
        np.ones((12, 12)),
        symmetric(2, np.array([1.0, 1.0 + 1e-15])),
    ],
)
def test_leading_components_equal_numpy(matrix):
    k = min(8, len(matrix))
    values, vectors = W.leading_components(matrix, k)
    norm = max(np.abs(matrix).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-13 * norm * len(matrix))
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-11)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * norm * len(matrix)


def brute(rows):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    total = [sum(x[j] for _, x in kept) for j in range(d)]
    centred = np.array([[(n * x[j] - total[j]) / n for j in range(d)] for _, x in kept])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:8]
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    deviation = [sum((n * x[j] - total[j]) ** 2 for j in range(d)) for _, x in kept]
    return n, [i for i, _ in kept], deviation, white, values[order] / values.sum()


def check(got, rows):
    n, ids, deviation, white, explained = brute(rows)
    assert len(got) == n * white.shape[1] and {r.n for r in got} == {n}
    assert {r.component for r in got} == set(range(1, white.shape[1] + 1))
    assert max(r.identity_error for r in got) <= 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for i, vec_id in enumerate(ids):
        assert by[vec_id, 1].deviation == deviation[i]
    for c in range(1, white.shape[1] + 1):
        mine = np.array([by[i, c].whitened for i in ids])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.allclose(mine * sign, white[:, c - 1], atol=1e-7)
        assert np.isclose(by[ids[0], c].explained, explained[c - 1], rtol=1e-9)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_embedding_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["component"] == "int" and dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(got.collect(), rows)


def test_unusable_vectors_are_dropped_and_repeats_counted(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.standard_normal(10) * (i % 3 + 1)).astype(np.float32).tolist()) for i in range(60)]
    bad = [(90, None), (91, [None] + [0.0] * 9), (92, [float("nan")] * 10), (93, [float("inf")] * 10), (94, []), (95, [1.0, 2.0]), (96, [1e30] * 10)]
    check(W.whiten(frame(spark, good + bad)).collect(), good)
    twice = W.whiten(frame(spark, good + good[:1] + [(None, good[1][1])]), components=3).collect()
    assert len(twice) == 62 * 3 and sum(r.vec_id == 0 for r in twice) == 6 and sum(r.vec_id is None for r in twice) == 3


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float(1 << 49), float(i)] if i else [0.0, 0.0]) for i in range(5)]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {None}
    mid = [(i, [float(i * 30_000), 1.0]) for i in range(9)]
    n, _, deviation, _, _ = brute(mid)
    assert sorted({(r.vec_id, r.deviation) for r in W.whiten(frame(spark, mid)).collect()}) == list(enumerate(deviation))


def test_nothing_to_whiten(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None)])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    two = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0])])).collect()
    assert {r.component for r in two} == {1}
