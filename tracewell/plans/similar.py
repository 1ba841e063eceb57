"""Exact set-similarity clusters and pairs.

Grams are 64-bit hashes.  Equal sets are collapsed to one class first, so a mass of copies costs one
comparison.

Classes are dealt into blocks by size: sets with Jaccard >= t have sizes in one band or in neighbouring ones.
In groups that fit one block every pair of neighbouring bands is one group of a grouped map, so a set is sent three
times at most.  The blocks of larger groups are rows of a table, written once with their sets packed; tasks
read the pairs of blocks that may hold similar sets (a Cartesian product of partitions), and no copies are shuffled.
Inside, a product of parity sketches bounds the difference of all sets of two tiles at once, and only what passes is counted gram by gram.  Where most
sets share most of their grams (character bigrams of one language) no key of few grams separates them, so the
comparisons grow with the square of a band; a comparison is a few hundred multiplications of a matrix product.

Clusters do not need all pairs: a group of blocks returns the links of a spanning forest, and sets that are
linked already are not compared again.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans.components import connected_components
from tracewell.session import materialize

Verify = Callable[[Column, Column], Column]
_EPS = 1e-9
#: Grams and classes that a block holds at most, about (two blocks meet in a task).
BLOCK_GRAMS = 6_000_000
BLOCK_ROWS = 32_768
#: Classes of a side that are compared at once.
TILE = 2048
#: Different grams up to which the sets of a task are held as bitmaps.
BITMAP_GRAMS = 32_768
#: Partitions of packed blocks at least; tasks are pairs of partitions.
LEAST_BINS = 12


def with_class(sets: DataFrame, group: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Add ``class_key``, 128 bits: equal for rows of one group with equal sets (arrays of hashed grams)."""
    parts = [*[F.col(g) for g in group], *[F.array_sort(a) for a in arrays]]
    halves = [F.hex(F.xxhash64(F.lit(seed), *parts)) for seed in (1, 2)]
    return sets.withColumn("class_key", F.concat_ws("-", *halves))


def _verify(pairs: DataFrame, classes: DataFrame, threshold: float, extra: Verify | None) -> DataFrame:
    """Keep pairs (a, b) whose sets reach the threshold; adds j."""
    columns = [c for c in classes.columns if c not in ("n",)]
    payload = F.struct(*columns)
    left = classes.select(F.col("cls").alias("a"), payload.alias("sa"))
    right = classes.select(F.col("cls").alias("b"), payload.alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("sa.grams", "sb.grams"))
    j = both / (F.size("sa.grams") + F.size("sb.grams") - both)
    out = joined.withColumn("j", j).filter(F.col("j") >= F.lit(threshold) - F.lit(1e-12))
    if extra is not None:
        out = out.filter(extra(F.col("sa"), F.col("sb")))
    return out.select("a", "b", "j")


def _band(threshold: float) -> Column:
    step = math.log(1 / threshold) * (1 + 1e-9)  # sizes that may match are at most one band apart
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).alias("band")


def _slots(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    held = rows.groupBy(*group, "band").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("rows"))
    return held.select(*group, "band", F.ceil(F.greatest(F.col("grams") / BLOCK_GRAMS, F.col("rows") / BLOCK_ROWS)).alias("slots"))


def _blocks(classes: DataFrame, group: Sequence[str], threshold: float, keep: Sequence[str]) -> DataFrame:
    """Classes once for every pair of blocks (``at``) in which they are compared, ``second`` for rows of its second block."""
    rows = classes.select(*group, "cls", *keep, "grams", F.col("n").cast("long").alias("n"), _band(threshold))
    slots = materialize(_slots(rows, group))
    near = lambda shift, name: slots.select(*group, (F.col("band") + shift).alias("band"), F.col("slots").alias(name))
    around = slots.join(near(1, "below"), [*group, "band"], "left").join(near(-1, "above"), [*group, "band"], "left")
    own = F.pmod(F.xxhash64("cls"), F.col("slots"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def met(count: Column, band: Column, pair: Callable, second: Callable) -> Column:
        places = F.when(count > 0, F.sequence(zero, count - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(places, lambda o: F.struct(band.alias("band"), pair(o)[0].alias("x"), pair(o)[1].alias("y"), second(o).alias("second")))

    placed = rows.join(around, [*group, "band"]).withColumn("own", own)
    mine = F.col("own")
    kinds = F.concat(
        # bands count twice: even numbers are pairs inside a band, odd ones with the next
        met(F.col("slots"), F.col("band") * 2, lambda o: (F.least(mine, o), F.greatest(mine, o)), lambda o: mine > o),
        met(F.coalesce("above", zero), F.col("band") * 2 + one, lambda o: (mine, o), lambda o: F.lit(False)),
        met(F.coalesce("below", zero), F.col("band") * 2 - one, lambda o: (o, mine), lambda o: F.lit(True)),
    )
    return placed.select(*group, F.explode(kinds).alias("at"), "cls", *keep, "grams").select(
        *group, "at.band", "at.x", "at.y", "at.second", "cls", *keep, "grams"
    )


class _Sets:
    """Sets of a task in order of size, for comparison in tiles: sizes, and places of all grams in the vocabulary."""

    def __init__(self, n: np.ndarray, vocabulary: np.ndarray, grams: np.ndarray, threshold: float) -> None:
        self.n, self.vocabulary, self.t = n, vocabulary, threshold
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.grams = grams.astype(np.int32, copy=False)
        self.bits = 256
        while self.bits < min(self.n.max() * (0.7 if threshold >= 0.85 else 3), 4096):
            self.bits *= 2
        mixed = (self.vocabulary.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        self.place = (mixed % np.uint64(self.bits)).astype(np.int64)
        self.sketch = np.empty((len(n), self.bits), np.int8)
        wide = len(self.vocabulary) > BITMAP_GRAMS
        self.map = None if wide else np.empty((len(n), -(-len(self.vocabulary) // 64)), np.uint64)
        for at in range(0, len(n), TILE):
            part = slice(at, min(at + TILE, len(n)))
            size = part.stop - at
            held = self.grams[self.ends[at] : self.ends[part.stop]]
            row = np.repeat(np.arange(size), self.n[part])
            odd = np.bincount(row * self.bits + self.place[held], minlength=size * self.bits) & 1
            self.sketch[part] = (1 - 2 * odd).reshape(size, self.bits)
            if not wide:
                dense = np.zeros((size, self.map.shape[1] * 64), np.uint8)
                dense[row, held] = 1
                self.map[part] = np.packbits(dense, axis=1).view(np.uint64)

    def tile(self, rows: np.ndarray, first: bool) -> np.ndarray:
        """Sketches with two more columns, so that a product is at least ``bits`` where the sets may match."""
        size, one = 2 * (1 - self.t) / (1 + self.t) * self.n[rows], np.ones(len(rows))
        more = (size, one) if first else (one, size)
        return np.column_stack([self.sketch[rows], *more]).astype(np.float32)

    def jaccard(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.map is not None:
            both = np.concatenate([np.zeros(0, np.int64), *[np.bitwise_count(self.map[i[c : c + 50_000]] & self.map[j[c : c + 50_000]]).sum(1) for c in range(0, len(i), 50_000)]])
        else:
            of = lambda k: self.grams[self.ends[k] : self.ends[k + 1]]
            both = np.array([len(np.intersect1d(of(a), of(b), assume_unique=True)) for a, b in zip(i, j)], np.int64)
        both = both.astype(np.int64)
        return both / (self.n[i] + self.n[j] - both)


def _unlinked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) link what was apart; ``label`` follows."""
    parent = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    new = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(label[i].tolist(), label[j].tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            new[k] = True
    if parent:
        known, place = np.unique(label, return_inverse=True)
        label[:] = np.array([root(x) for x in known.tolist()])[place]
    return new


def _matches(sets: _Sets, second: np.ndarray | None, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, Jaccard) of sets that match, a row of tiles at a time: with each other, or with those that are ``second``."""
    threshold, label = sets.t, np.arange(len(sets.n))
    left = label.copy() if second is None else np.flatnonzero(~second)
    right = left if second is None else np.flatnonzero(second)
    for x in range(0, len(left), TILE):
        xs, found = left[x : x + TILE], []
        tile = sets.tile(xs, True)
        for y in range(x if second is None else 0, len(right), TILE):
            ys = right[y : y + TILE]
            if sets.n[xs[-1]] < threshold * sets.n[ys[0]] - _EPS or sets.n[ys[-1]] < threshold * sets.n[xs[0]] - _EPS:
                continue
            i, j = np.nonzero(tile @ sets.tile(ys, False).T >= sets.bits - 0.5)
            i, j = xs[i], ys[j]
            left_over = (i < j) if second is None else np.ones(len(i), bool)
            if forest:
                left_over &= label[i] != label[j]
            i, j = i[left_over], j[left_over]
            value = sets.jaccard(i, j)
            good = value >= threshold - 1e-12
            i, j, value = i[good], j[good], value[good]
            if forest and len(i):
                good = _unlinked(label, i, j)
                i, j, value = i[good], j[good], value[good]
            found.append((i, j, value))
        if any(len(i) for i, _, _ in found):
            yield tuple(np.concatenate(c) for c in zip(*found))


def _named(i: np.ndarray, j: np.ndarray, value: np.ndarray, cls: np.ndarray, kept: dict[str, np.ndarray]) -> pd.DataFrame:
    swap = cls[i] > cls[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    more = {f"{side}_{c}": held[k] for side, k in (("a", i), ("b", j)) for c, held in kept.items()}
    ids = {"a": pd.Series(cls[i], dtype=object), "b": pd.Series(cls[j], dtype=object)}
    return pd.DataFrame({**ids, "j": value.astype(float), **more})


def _compared(threshold: float, keep: Sequence[str], forest: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        # of blocks that meet themselves only, no row is second
        rows = rows.iloc[np.argsort(rows["grams"].map(len).to_numpy(), kind="stable")].reset_index(drop=True)
        second = rows["second"].to_numpy(bool)
        inside = rows["x"].iat[0] == rows["y"].iat[0] and rows["band"].iat[0] % 2 == 0
        found = []
        if len(rows) > 1 and (inside or second.any() and not second.all()):
            vocabulary, grams = np.unique(np.concatenate(rows["grams"].to_numpy()), return_inverse=True)
            sets = _Sets(rows["grams"].map(len).to_numpy(), vocabulary, grams, threshold)
            found = list(_matches(sets, None if inside else second, forest))
        i, j, value = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 3
        return _named(i, j, value, rows["cls"].to_numpy(object), {c: rows[c].to_numpy() for c in keep})

    return compare


def _pack(rows: pd.DataFrame, keep: Sequence[str]) -> bytes:
    """Sets of a block in order of size: own vocabulary, and steps from gram to gram in it."""
    rows = rows.iloc[np.argsort(rows["grams"].map(len).to_numpy(), kind="stable")]
    n = rows["grams"].map(len).to_numpy()
    vocabulary, grams = np.unique(np.concatenate(rows["grams"].to_numpy()), return_inverse=True)
    start = np.repeat(np.arange(len(n)) * len(vocabulary), n)
    grams = np.sort(start + grams) - start
    steps = np.diff(grams, prepend=0)
    first = np.cumsum(n) - n
    steps[first] = grams[first]
    kind = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
    kept = {c: rows[c].to_numpy() for c in keep}
    return zlib.compress(pickle.dumps((rows["cls"].to_numpy(object), n, vocabulary, steps.astype(kind), kept), 5), 1)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    cls, n, vocabulary, steps, kept = pickle.loads(zlib.decompress(block))
    total = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
    return cls, n, vocabulary, total[1:] - np.repeat(total[np.cumsum(n) - n], n), kept


def _packed(keys: Sequence[str], keep: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows in order of the keys become a row per block."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block() -> pd.DataFrame:
            return pd.DataFrame({**{k: held[0][k].iloc[:1].array for k in keys}, "block": [_pack(pd.concat(held), keep)]})

        held, key = [], None
        for batch in batches:
            values = [batch[k].to_numpy() for k in keys]
            turns = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
            for a, b in zip([0, *turns], [*turns, len(batch)]):
                at = tuple(v[a] for v in values)
                if held and at != key:
                    yield block()
                    held = []
                key = at
                held.append(batch.iloc[a:b])
        if held:
            yield block()

    return pack


def _compared_blocks(threshold: float, forest: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for inside, x, y in zip(batch["inside"], batch["x"], batch["y"]):
                cls, n, vocabulary, grams, kept = _unpack(x)
                second = None
                if not inside:
                    of_y = _unpack(y)
                    second = np.repeat([False, True], [len(n), len(of_y[1])])
                    both = np.union1d(vocabulary, of_y[2])
                    grams = np.concatenate([np.searchsorted(both, v)[g] for v, g in ((vocabulary, grams), of_y[2:4])])
                    vocabulary, n, cls = both, np.concatenate([n, of_y[1]]), np.concatenate([cls, of_y[0]])
                    kept = {c: np.concatenate([v, of_y[4][c]]) for c, v in kept.items()}
                    order = np.argsort(n, kind="stable")
                    first, n, second, cls = (np.cumsum(n) - n)[order], n[order], second[order], cls[order]
                    grams = grams[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(grams))]
                    kept = {c: v[order] for c, v in kept.items()}
                for i, j, value in _matches(_Sets(n, vocabulary, grams, threshold), second, forest):
                    yield _named(i, j, value, cls, kept)

    return compare


def _met_blocks(
    classes: DataFrame, threshold: float, group: Sequence[str], keep: Sequence[str], forest: bool, schema: str, bins: int
) -> DataFrame:
    """Pairs in groups of many blocks.  The blocks lie in ``bins`` partitions, and a task compares those of two partitions."""
    rows = classes.select(*group, "cls", *keep, "grams", F.col("n").cast("long").alias("n"), _band(threshold))
    shared = _slots(rows, group).filter(F.col("slots") > 1)  # no more rows than all sets fill blocks
    placed = rows.join(F.broadcast(shared), [*group, "band"], "left")
    keys = [*group, "band", "slot"]
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("cls"), F.coalesce("slots", F.lit(1).cast("long"))))
    kind = dict(placed.dtypes)
    dealt = placed.select(*keys, "cls", *keep, "grams").repartitionById(bins, F.pmod(F.hash(*keys), F.lit(bins)))
    form = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    blocks = materialize(dealt.sortWithinPartitions(*keys).mapInPandas(_packed(keys, keep), f"{form}, block binary"))
    x, y = (blocks.select(*[F.col(k).alias(f"{side}_{k}") for k in keys], F.col("block").alias(side)) for side in "xy")
    same = F.col("x_band") == F.col("y_band")
    near = (same & (F.col("x_slot") <= F.col("y_slot"))) | (F.col("x_band") + 1 == F.col("y_band"))
    for g in group:
        near &= F.col(f"x_{g}") == F.col(f"y_{g}")
    pairs = x.join(y.hint("shuffle_replicate_nl"), near)
    inside = same & (F.col("x_slot") == F.col("y_slot"))
    return pairs.select(inside.alias("inside"), "x", "y").mapInPandas(_compared_blocks(threshold, forest), schema)


def _met(classes: DataFrame, threshold: float, group: Sequence[str], keep: Sequence[str] = (), forest: bool = False) -> DataFrame:
    kind = dict(classes.dtypes)
    schema = f"a {kind['cls']}, b {kind['cls']}, j double" + "".join(f", {side}_{c} {kind[c]}" for side in "ab" for c in keep)
    group = list(group)
    for g in group:
        classes = classes.filter(F.col(g).isNotNull())
    held = classes.groupBy(*group).agg(F.sum(F.col("n").cast("long")).alias("grams"), F.count(F.lit(1)).alias("rows"))
    held = held.withColumn("large", (F.col("grams") > BLOCK_GRAMS) | (F.col("rows") > BLOCK_ROWS))
    large = F.col("large")
    total = held.agg(
        F.count_if(large).alias("large"), F.count_if(~large).alias("small"),
        F.sum(F.when(large, F.greatest(F.col("grams") / BLOCK_GRAMS, F.col("rows") / BLOCK_ROWS))).alias("blocks"),
    ).first()
    found = []
    if total.large:
        of_large = classes
        if total.small:  # no more rows than all sets fill blocks
            of_large = classes.join(F.broadcast(held.filter(large).select(*group)), group, "left_semi")
            classes = classes.join(F.broadcast(held.filter(large).select(*group)), group, "left_anti")
        found.append(_met_blocks(of_large, threshold, group, keep, forest, schema, max(LEAST_BINS, math.ceil(total.blocks))))
    if total.small or not total.large:
        blocks = _blocks(classes, group, threshold, keep)
        found.append(blocks.groupBy(*group, "band", "x", "y").applyInPandas(_compared(threshold, keep, forest), schema))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def class_pairs(
    classes: DataFrame, threshold: float, group: Sequence[str] = (), extra: Verify | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """All pairs (a < b, j) of distinct classes at or above the threshold, with columns to ``keep`` as a_ and b_.

    ``classes`` has group columns, cls, grams (distinct, not empty) and n.
    """
    pairs = _met(classes, threshold, group, keep)
    return pairs if extra is None else _verify(pairs.select("a", "b"), classes, threshold, extra)


def class_clusters(
    classes: DataFrame, threshold: float, group: Sequence[str] = (), extra: Verify | None = None
) -> DataFrame:
    """(cls, component) for classes that have a partner; others are absent."""
    links = _met(classes, threshold, group, forest=True) if extra is None else class_pairs(classes, threshold, group, extra)
    return connected_components(materialize(links.select("a", "b"))).withColumnRenamed("node", "cls")
