"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that their principal axes come
first.  Sorted by label and first coordinate they are cut into tiles of bounded
size; pairs of tiles whose boxes over the leading coordinates lie further apart
than linked vectors can are left out.  In a pair of tiles products are summed
over leading coordinates first; what the other coordinates can add is at most the
product of the suffix norms, so a pair of vectors is given up as soon as sum and
bound together miss the threshold.  What is left is compared by the cosine of the
vectors as given, in double precision.

A pair of tiles gives link counts and the edges of a spanning forest, not all
its links.  Equal vectors are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import stored
from tracewell.llm.whitening import covariance, leading_components, matrix_of, summed_products, usable
from tracewell.plans.components import connected_components
from tracewell.plans.ordinal import with_ordinal

THRESHOLD = 0.98
#: Vectors in a tile at most; two tiles are compared by one task.
TILE = 16_384
#: Numbers of leading coordinates after which pairs are given up; tiles have boxes over the first few.
STAGES = (4, 8, 16)
BOX = 4
#: Rounding of sums that decide which pairs are given up; far above the error of double precision.
SLACK = 1e-9
#: Rows of a tile compared at a time, and pairs gathered at a time.
ROWS = 256
PAIRS = 65_536
_LARGEST = 1e150  #: entries beyond are scaled down before squares are summed


def unit_rows(values: np.ndarray) -> np.ndarray:
    top = np.abs(values).max(axis=1, keepdims=True)
    scaled = values / top
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _safe(values: np.ndarray) -> np.ndarray:
    """The vectors, those with entries too large or too small for squares scaled by a power of two."""
    top = np.abs(values).max(axis=1, initial=0.0)
    odd = (top > _LARGEST) | ((top < 1 / _LARGEST) & (top > 0))
    if odd.any():
        values = values.copy()
        values[odd] = np.ldexp(values[odd], -np.frexp(top[odd])[1][:, None])
    return values


class Forest:
    """Components of vertices 0 to n - 1 as links arrive; roots are smallest members."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def compare_tiles(left: np.ndarray, right: np.ndarray | None, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row of left, row of right) that link, in blocks; within ``left`` alone, i < j, without ``right``."""
    sides = []
    for values in (left,) if right is None else (left, right):
        values = _safe(values)
        unit = unit_rows(values)
        turned = unit @ axes
        squares = np.cumsum(turned**2, axis=1)
        steps = [k for k in STAGES if k < turned.shape[1]] + [turned.shape[1]]
        suffix = np.stack([np.sqrt(np.maximum(1.0 - squares[:, k - 1], 0.0)) for k in steps], axis=1)
        sides.append((values, np.sqrt((values**2).sum(axis=1)), turned, suffix))
    (x, nx, px, sx), (y, ny, py, sy) = sides[0], sides[-1]
    first, least = steps[0], threshold - SLACK
    for start in range(0, len(x), ROWS):
        block = slice(start, start + ROWS)
        bound = px[block, :first] @ py[:, :first].T + np.outer(sx[block, 0], sy[:, 0])
        i, j = np.nonzero(bound >= least)
        i += start
        if right is None:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            partial = np.einsum("ij,ij->i", px[a, :first], py[b, :first])
            for n, (k, upto) in enumerate(zip(steps, steps[1:]), start=1):
                partial = partial + np.einsum("ij,ij->i", px[a, k:upto], py[b, k:upto])
                alive = partial + sx[a, n] * sy[b, n] >= least
                a, b, partial = a[alive], b[alive], partial[alive]
            cosine = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
            linked = cosine >= threshold
            yield a[linked], b[linked]


def _leading_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Leading axes of all vectors of one length, scaled to length one, about the origin, from which cosines are seen."""
    sums = summed_products(vectors.filter(F.size("embedding") == width), unit_rows)
    n = round(sums[-1, -1])
    return leading_components(covariance(sums, n, about_mean=False), min(STAGES[-1], width))[1]


def _tiles(distinct: DataFrame, axes: dict[int, np.ndarray], tile: int) -> DataFrame:
    """(node, copies, label, width, embedding, tile, p0..) of all vectors, in tiles along the first axis."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            widths = np.diff(column.offsets.to_numpy()) if batch.num_rows else np.empty(0, dtype=int)
            out = np.zeros((batch.num_rows, BOX))
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                turned = unit_rows(_safe(matrix_of(column.take(pa.array(at))))) @ axes.get(width, np.eye(width))[:, :BOX]
                out[at, : turned.shape[1]] = turned
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(out[:, c]) for c in range(BOX))], names=[*batch.schema.names, *(f"p{c}" for c in range(BOX))]
            )

    schema = T.StructType([*distinct.schema.fields, *(T.StructField(f"p{c}", T.DoubleType()) for c in range(BOX))])
    placed = distinct.mapInArrow(place, schema)
    numbered = with_ordinal(placed, [F.col(c) for c in ("label", "width", "p0", "p1", "node")])
    return numbered.withColumn("tile", F.floor(F.col("ordinal") / tile).cast("long")).drop("ordinal")


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(label, width, a, b): pairs of tiles, a <= b, that may hold linked vectors, judged by their boxes."""
    reach = float(np.sqrt(2 * (1 - threshold))) + 1e-6  # vectors of length one with that cosine are so far apart
    ends = [f(f"p{c}").alias(f"{n}{c}") for c in range(BOX) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = stored(tiles.groupBy("label", "width", "tile").agg(*ends), "tile-boxes")
    x, y = boxes.alias("x"), boxes.alias("y")
    near = (F.col("x.tile") <= F.col("y.tile")) & (F.col("x.label") == F.col("y.label")) & (F.col("x.width") == F.col("y.width"))
    gap = F.lit(0.0)
    for c in range(BOX):
        apart = F.greatest(F.col(f"x.lo{c}") - F.col(f"y.hi{c}"), F.col(f"y.lo{c}") - F.col(f"x.hi{c}"), F.lit(0.0))
        gap = gap + apart * apart
    return x.join(y, near & (gap <= reach * reach)).select("x.label", "x.width", F.col("x.tile").alias("a"), F.col("y.tile").alias("b"))


def _links(tiles: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(node, other, n): n rows that node links to within a pair of tiles, and another node of its component there."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        width, second = group.column("width")[0].as_py(), group.column("second").to_numpy(zero_copy_only=False)
        values = matrix_of(group.column("embedding").combine_chunks())
        nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        turn = axes.get(width, np.eye(width, min(width, STAGES[-1])))
        order = np.concatenate((np.flatnonzero(~second), np.flatnonzero(second)))
        split = int((~second).sum())
        values, nodes, copies = values[order], nodes[order], copies[order]
        found, forest = np.zeros(len(nodes), dtype=np.int64), Forest(len(nodes))
        for a, b in compare_tiles(values[:split], values[split:] if split < len(nodes) else None, turn, threshold):
            b = b + split if split < len(nodes) else b
            np.add.at(found, a, copies[b])
            np.add.at(found, b, copies[a])
            forest.link(a, b)
        hit = np.flatnonzero(found)
        return pa.table({"node": nodes[hit], "other": nodes[forest.root[hit]], "n": found[hit]})

    sent = pairs.withColumn("sides", F.when(F.col("a") == F.col("b"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    sent = sent.select("label", "width", "a", "b", F.explode("sides").alias("second")).withColumn("tile", F.when(F.col("second"), F.col("b")).otherwise(F.col("a")))
    rows = tiles.select("label", "width", "tile", "node", "copies", "embedding").join(sent, ["label", "width", "tile"])
    return rows.groupBy("label", "width", "a", "b").applyInArrow(compare, "node long, other long, n long")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Needs ``vec_id``, ``embedding`` and ``label``; other columns, whatever their names, are left out.  Vectors are
    compared if their labels are equal and not null and their lengths are equal.  Null, empty and zero vectors, and those
    with null, NaN or infinite entries, link with nothing, nor do those without label: they are kept.  ``threshold``
    must be above zero.  Repeated rows are rows of their own: they link with each other and count as links.  Rows without id link
    too; ``component_id`` is the smallest id of the component, null if it has none, and ``kept`` says that the row has that
    id (null for null).  Vectors of any length are read whole.  An empty table gives an empty result.
    """
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    useful = usable() & F.col("label").isNotNull() & F.exists("embedding", lambda c: c != 0)
    keyed = rows.select("vec_id", F.when(useful, F.col("label")).alias("label"), F.when(useful, F.col("embedding")).alias("embedding"))
    apart = keyed.filter("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    distinct = keyed.filter("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "copies", "first_id", "label", F.size("embedding").alias("width"), "embedding"), "vectors")
    widths = [r.width for r in nodes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()]
    axes = {w: _leading_axes(nodes, w) for w in widths}  # other lengths are compared along their own first coordinates

    tiles = stored(_tiles(nodes.drop("first_id"), axes, tile), "vector-tiles")
    links = stored(_links(tiles, _tile_pairs(tiles, threshold), axes, threshold), "vector-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    joined = connected_components(links.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = nodes.join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed.drop("width"), "vector-components")
    ids = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(ids, "component").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = keyed.filter("embedding IS NOT NULL").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
