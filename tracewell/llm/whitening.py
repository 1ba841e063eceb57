"""Embedding whitening by a distributed covariance and a symmetric eigensolver.

Sums, covariance and the error of the result are gathered by passes over the
rows: every task adds up its own rows and sends sums, which Spark adds.  What
reaches the driver depends on the width of the vectors alone.  There the matrix
is brought to tridiagonal form by Householder reflections, leading eigenvalues
are cut out by bisection over Sturm counts, eigenvectors come from inverse
iteration, made orthogonal anew within clusters of close eigenvalues.  The
components go to the tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import stored

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Entries are fixed-point numbers of 64 bits; from here on they no longer fit.
WIDEST = float(1 << 50)
#: Eigenvalues closer than this share of the matrix' norm form a cluster.
CLUSTER = 1e-3
#: Components with less than this share of the largest variance have none.
NO_VARIANCE = 1e-12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors of Householder's reduction of a symmetric matrix."""
    a = np.array(matrix, dtype=float)
    n, reflectors = len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        rest = np.linalg.norm(x[1:])
        if rest == 0:
            reflectors.append(np.zeros(len(x)))
            continue
        x[0] += np.copysign(np.hypot(x[0], rest), x[0])
        v = x / np.linalg.norm(x)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of the values ``at``."""
    tiny = np.finfo(float).tiny
    smallest = np.finfo(float).eps * (np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0)) + tiny
    count = np.zeros(len(at), dtype=int)
    q = np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < smallest * 1e-3, -smallest * 1e-3, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each to the last bits."""
    n = len(diagonal)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    rank = n - np.arange(k)  # the j-th largest is the smallest value with at least n - j below or at it
    for _ in range(120):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        below = sturm_count(diagonal, off, middle) >= rank
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a tridiagonal system by elimination with row exchanges; zero pivots become tiny ones."""
    n = len(diagonal)
    least = np.finfo(float).eps * (np.abs(diagonal).max() + np.abs(off).max(initial=0)) or np.finfo(float).tiny
    u, v, w, x = diagonal.tolist(), off.tolist() + [0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        below, after = off[i], (off[i + 1] if i + 1 < n - 1 else 0.0)
        if abs(u[i]) >= abs(below):
            m = below / (u[i] if abs(u[i]) > least else least)
            u[i + 1] -= m * v[i]
            x[i + 1] -= m * x[i]
        else:
            m = u[i] / below
            u[i], v[i], u[i + 1], w[i] = below, u[i + 1], v[i] - m * u[i + 1], after
            v[i + 1] = -m * after
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
    for i in range(n - 1, -1, -1):
        s = x[i] - (v[i] * x[i + 1] if i + 1 < n else 0.0) - (w[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = s / (u[i] if abs(u[i]) > least else least)
    return np.array(x)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns; largest entries are positive."""
    n, k = len(matrix), min(k, len(matrix))
    scale = np.abs(matrix).max(initial=0.0) or 1.0
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    start = np.random.default_rng(1)
    vectors = np.empty((n, k))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = value - 4 * np.finfo(float).eps * norm * (j - first)  # equal eigenvalues get shifts of their own
        x = start.standard_normal(n)
        for _ in range(5):
            x = _solve(diagonal - shift, off, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[:, first:j] @ (vectors[:, first:j].T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    for i, v in reversed(list(enumerate(reflectors))):
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    top = np.abs(vectors).argmax(axis=0)
    return values * scale, vectors * np.where(vectors[top, range(k)] < 0, -1.0, 1.0)


def usable(vector: str | Column = "embedding", widest: float | None = None) -> Column:
    """True for vectors that are not null, not empty and hold finite entries only."""
    column = F.col(vector) if isinstance(vector, str) else vector
    limit = F.lit(float("inf") if widest is None else widest)
    fine = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < limit, F.lit(False)))  # NaN is greater than all
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & fine, F.lit(False))


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def summed_products(vectors: DataFrame, prepared: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], float]:
    """Sums over all rows of products of entries i <= j of the prepared rows, and of each entry by itself at (-1, j).

    ``vectors`` has one column, ``embedding``, of vectors of one length.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = prepared(matrix_of(batch.column(0)))
                rows = np.concatenate((np.ones((len(rows), 1)), rows), axis=1)
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i - 1), pa.array(j - 1), pa.array(total[i, j])], names=["i", "j", "v"])

    added = vectors.select("embedding").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r.i, r.j): r.v for r in added.collect()}  # (width + 1) * (width + 2) / 2 rows


def covariance(sums: dict[tuple[int, int], float], n: int, about_mean: bool) -> np.ndarray:
    """Mean products of the summed rows, about their mean or about zero."""
    width = 1 + max((j for _, j in sums), default=-1)
    out = np.zeros((width, width))
    for (i, j), v in sums.items():
        if i >= 0:
            out[i, j] = out[j, i] = v / n - (sums[-1, i] / n * sums[-1, j] / n if about_mean else 0.0)
    return out


def _fixed(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _entry_sums(vectors: DataFrame) -> DataFrame:
    """(width, pos, n, high, low): of each length of vectors and entry, the number of vectors and the sums of both halves of its numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column(0)
            widths = np.diff(column.offsets.to_numpy()) if batch.num_rows else np.empty(0, dtype=int)
            for width in np.unique(widths).tolist():
                rows = _fixed(matrix_of(column.filter(pa.array(widths == width))))
                n, high, low = found.get(width, (0, 0, 0))
                found[width] = n + len(rows), high + (rows >> 32).sum(axis=0), low + (rows & 0xFFFFFFFF).sum(axis=0)
        for width, (n, high, low) in found.items():
            parts = [pa.array([width] * width), pa.array(range(width)), pa.array([n] * width), pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(parts, names=["width", "pos", "n", "high", "low"])

    rows = vectors.select("embedding").mapInArrow(partial, "width long, pos long, n long, high long, low long")
    return rows.groupBy("width", "pos").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Needs ``vec_id`` and ``embedding``; other columns, whatever their names, are
    left out.  Dropped are null and empty vectors, vectors with null, NaN or
    infinite entries or entries of 2^50 and more, and, as components need one
    length, vectors of any other than the most frequent length (of equally
    frequent ones the longer).  Repeated rows count and are returned as often as
    they occur; a null id stays.  Components without variance (fewer vectors
    than components, equal vectors) give no row; nor does an empty table.
    ``deviation`` is exact and null where it exceeds 64 bits.  Vectors of any
    length are read whole; the driver holds a square matrix of that length.
    """
    spark = embeddings.sparkSession
    id_type = embeddings.schema["vec_id"].dataType
    schema = T.StructType(
        [T.StructField("vec_id", id_type), *(T.StructField(c, t) for c, t in (
            ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
            ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))]
    )
    rows = embeddings.filter(usable(widest=WIDEST)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sums = stored(_entry_sums(rows), "whitening-sums")
    best = sums.filter("pos = 0").orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not best:
        return spark.createDataFrame([], schema)
    width, n = best[0].width, best[0].n
    total = [(r.high << 32) + r.low for r in sums.filter(F.col("width") == width).orderBy("pos").collect()]
    largest = max(map(abs, total))
    rows = rows.filter(F.size("embedding") == width)

    def numerators(values: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exact: Python's numbers where 64 bits might not do."""
        x = _fixed(values)
        if n * int(np.abs(x).max(initial=0)) + largest >= 1 << 62:
            return n * x.astype(object) - np.array(total, dtype=object)
        return n * x - np.array(total)

    def centred(values: np.ndarray) -> np.ndarray:
        return (numerators(values) / n).astype(float)

    v = covariance(summed_products(rows, centred), n, about_mean=True)
    values, axes = leading_components(v, components)
    held = values > NO_VARIANCE * max(values.max(initial=0.0), 0.0)
    values, axes = values[held], axes[:, held]
    if not len(values):
        return spark.createDataFrame([], schema)
    turn, explained = axes / np.sqrt(values), values / np.trace(v)
    seen = covariance(summed_products(rows, lambda x: centred(x) @ turn), n, about_mean=True)
    error = float(np.abs(seen - np.eye(len(values))).max())

    def deviations(values: np.ndarray) -> list[int | None]:
        apart = numerators(values)
        if len(apart) and float(np.abs(apart).max()) ** 2 * width < 2.0**62:
            return (apart**2).sum(axis=1).tolist()
        exact = (sum(int(x) ** 2 for x in row) for row in apart)
        return [d if d < 1 << 63 else None for d in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix_of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array([d for d in deviations(x) for _ in range(k)], type=pa.int64()),
                    pa.array((centred(x) @ turn).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(project, schema)
