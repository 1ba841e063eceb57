"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

from tracewell.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, node string, tile int, copies double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 0.5) for i, v, label in rows], SCHEMA)


def brute(rows, threshold=0.98):
    def fine(v):
        return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a is None or a != b or not fine(v) or not fine(w) or len(v) != len(w):
                continue
            v, w = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
            if v @ w / math.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    best = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            best[find(i)] = min(best.get(find(i), vec_id), vec_id)
    return sorted(((vec_id, links[i], best.get(find(i)), vec_id == best.get(find(i))) for i, (vec_id, _, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def vectors(count, seed, width=24, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((count // 5, width))
    for i in range(count):
        c = centres[rng.integers(len(centres))] if i % 3 else rng.standard_normal(width)
        yield i, ((c + rng.standard_normal(width) * spread) * 10.0 ** rng.integers(-3, 3)).astype(np.float32).tolist(), int(rng.integers(3))


@pytest.mark.parametrize("tile", [E.TILE, 16, 1])
def test_components_equal_all_pairs(spark, tile):
    rows = list(vectors(150, 1))
    rows += [(i, rows[7][1], rows[7][2]) for i in (300, 301, 301, None, None)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 24, 1), (403, [float("nan")] * 24, 1), (404, [None] * 24, 1), (405, [float("inf")] * 24, 1),
             (406, rows[3][1], None), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [3.0], 1), (410, [5.0], 1), (411, [-5.0], 1), (None, None, None),
             (412, [3e38] * 24, 2), (413, [1e-44] * 24, 2)]
    assert found(E.near_vectors(frame(spark, rows), tile=tile)) == brute(rows)


def test_one_dense_group(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS", 16)
    monkeypatch.setattr(E, "PAIRS", 50)
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(vectors(120, 2, spread=0.05))]
    rows += [(500 + i, (np.ones(24) + np.eye(24)[i % 24] * 0.01 * i).astype(np.float32).tolist(), 0) for i in range(80)]
    assert found(E.near_vectors(frame(spark, rows), tile=64)) == brute(rows)


def test_pairs_of_tiles_give_no_more_rows_than_vectors(spark):
    rows = [(i, [1.0, 0.001 * i, 0.0], 3) for i in range(60)]
    table = frame(spark, rows)
    assert found(E.near_vectors(table)) == brute(rows)
    nodes = table.select(E.F.col("vec_id").alias("node"), E.F.lit(1).cast("long").alias("copies"), "label", E.F.lit(3).alias("width"), E.F.col("embedding").cast("array<double>").alias("embedding"))
    axes = {3: np.eye(3)}
    tiles = E._tiles(nodes, axes, 1000)
    assert E._links(tiles, E._tile_pairs(tiles, 0.98), axes, 0.98).count() <= 60


def test_far_tiles_are_left_out(spark):
    rows = [(i, [math.cos(i / 100), math.sin(i / 100), 0.0], 0) for i in range(157)]
    nodes = frame(spark, rows).select(E.F.col("vec_id").alias("node"), E.F.lit(1).cast("long").alias("copies"), "label", E.F.lit(3).alias("width"), E.F.col("embedding").cast("array<double>").alias("embedding"))
    tiles = E.stored(E._tiles(nodes, {3: np.eye(3)}, 10), "tiles-test")
    every = 16 * 17 // 2
    assert 16 <= E._tile_pairs(tiles, 0.98).count() < every // 2
    assert found(E.near_vectors(frame(spark, rows), tile=10)) == brute(rows)


def test_empty_table(spark):
    assert E.near_vectors(frame(spark, [])).count() == 0
    assert found(E.near_vectors(frame(spark, [(1, None, None)]))) == [(1, 0, 1, True)]
