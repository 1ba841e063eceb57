"""Ordered per-key scans that stay parallel inside one hot key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  Here each
key is cut into blocks along its order: rows are scanned inside a block, block
totals (pre-aggregated map side) are scanned across blocks, and the carry of
the earlier blocks is joined back.  All kinds used are associative, so the
result equals the plain window.

Where all rows lie in one block there is no carry and a plain window is the same; windows over one key and
order share one shuffle and one sort then, however many scans follow each other.  Whether that is so is
asked once (``in_one_block``, two numbers to the driver) and handed on by scans of scans.  Otherwise the input of
a blocked scan, which is read twice, is written to the checkpoint folder first, so nested scans
compute what lies before them once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import materialize

#: Rows of one dense sequence that share a block.
BLOCK_ROWS = 262_144
#: A key is cut by position only beyond this many rows, so that at most
#: total_rows / HOT_KEY_ROWS keys are listed (about 250k keys per 10^12 rows).
HOT_KEY_ROWS = 4_000_000
#: Pieces a hot key is cut into at most.
CUTS = 1024

_BLOCK, _CUT = "__block", "__cut"


@dataclass(frozen=True)
class Running:
    """One scan output: ``kind`` in sum, max, min, last, prev."""

    kind: str
    value: Column


def seq_block(seq: str | Column = "seq", rows: int | None = None) -> Column:
    """Block number for a dense 0-based sequence column."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(col / F.lit(rows or BLOCK_ROWS)).cast("long")


def in_one_block(df: DataFrame, block: Column) -> bool:
    """Whether all rows have one block number (true without rows)."""
    ends = df.agg(F.min(block).alias("lo"), F.max(block).alias("hi")).first()
    return ends.lo == ends.hi


def with_adaptive_block(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    name: str = "__pos_block",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Add a block column that is 0 for ordinary keys and cuts hot keys at quantiles of the position; none without hot keys.

    Cuts are approximate quantiles of the key's own rows, so a burst of rows in a short span is cut as
    well as an even flow; only rows of equal position stay together.  The list of hot keys holds at most
    ``rows / hot_rows`` entries of up to ``CUTS`` numbers; it is joined, not broadcast by force.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    if n.isEmpty():
        return df
    quantiles = [i / CUTS for i in range(1, CUTS)]
    hot = (
        df.join(n, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(position, quantiles).alias("__cuts"), F.count(F.lit(1)).alias("__n"))
    )
    wanted = F.least(F.ceil(F.col("__n") / F.lit(hot_rows)), F.lit(CUTS))  # of all cuts every so many-th
    thinned = F.filter("__cuts", lambda c, i: F.floor((i + 1) * wanted / CUTS) > F.floor(i * wanted / CUTS))
    joined = df.join(hot.select(*keys, F.array_distinct(thinned).alias("__cuts")), list(keys), "left")
    block = F.size(F.filter("__cuts", lambda c: c < position))
    return joined.withColumn(name, F.when(F.col("__cuts").isNull(), 0).otherwise(block).cast("long")).drop("__cuts")


def running_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    outputs: dict[str, Running],
    whole: bool | None = None,
) -> DataFrame:
    """Add running outputs over ``order`` inside ``keys``.

    ``block`` must be monotone in ``order``; keys and order must not be null.
    sum/max/min/last (last non-null) include the current row; ``prev`` is the
    value of the row before (nulls kept when the value is a struct).  ``whole``
    says whether all rows lie in one block, where the caller knows.
    """
    keys = list(keys)
    if in_one_block(df, block) if whole is None else whole:
        return df.select(*[F.col(c) for c in df.columns], *[_plain(out, keys, order).alias(name) for name, out in outputs.items()])
    source = materialize(df.withColumn(_BLOCK, block))
    local_window = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    inclusive = local_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.struct(*order)

    local_cols, total_cols, carry_cols, result_cols = [], [], [], []
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    for name, out in outputs.items():
        here, total, carry = F.col(f"__l_{name}"), F.col(f"__t_{name}"), F.col(f"__c_{name}")
        if out.kind in ("sum", "max", "min"):
            fn = {"sum": F.sum, "max": F.max, "min": F.min}[out.kind]
            local_cols.append(fn(out.value).over(inclusive))
            total_cols.append(fn(out.value))
            carry_cols.append(fn(total).over(earlier))
            if out.kind == "sum":
                merged = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            elif out.kind == "max":
                merged = F.greatest(here, carry)
            else:
                merged = F.least(here, carry)
        elif out.kind == "last":
            local_cols.append(F.last(out.value, ignorenulls=True).over(inclusive))
            total_cols.append(F.max_by(out.value, F.when(out.value.isNotNull(), position)))
            carry_cols.append(F.last(total, ignorenulls=True).over(earlier))
            merged = F.coalesce(here, carry)
        elif out.kind == "prev":
            local_cols.append(F.lag(out.value).over(local_window))
            total_cols.append(F.max_by(out.value, position))
            carry_cols.append(F.lag(total).over(across))
            merged = F.coalesce(here, carry)
        else:
            raise ValueError(f"unknown scan kind: {out.kind}")
        local_cols[-1] = local_cols[-1].alias(f"__l_{name}")
        total_cols[-1] = total_cols[-1].alias(f"__t_{name}")
        carry_cols[-1] = carry_cols[-1].alias(f"__c_{name}")
        result_cols.append(merged.alias(name))

    scanned = source.select("*", *local_cols)
    totals = source.groupBy(*keys, _BLOCK).agg(*total_cols)
    carries = (
        totals.select(*keys, _BLOCK, *carry_cols, F.row_number().over(across).alias("__nth"))
        .filter(F.col("__nth") > 1)
        .drop("__nth")
    )
    merged_df = scanned.join(carries, [*keys, _BLOCK], "left")
    return merged_df.select(*[F.col(c) for c in df.columns], *result_cols)


def position_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], position: Column, outputs: dict[str, Running], hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """``running_scan`` where the order is a stamp: hot keys, if there are any, are cut at quantiles of the position."""
    blocked = with_adaptive_block(df, keys, position, _CUT, hot_rows)
    if _CUT not in blocked.columns:
        return running_scan(df, keys, order, F.lit(0), outputs, whole=True)
    return running_scan(blocked, keys, order, F.col(_CUT), outputs, whole=False).drop(_CUT)


def _plain(out: Running, keys: Sequence[str], order: Sequence[str]) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order)
    inclusive = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if out.kind == "sum":
        return F.coalesce(F.sum(out.value).over(inclusive), F.lit(0))
    if out.kind == "last":
        return F.last(out.value, ignorenulls=True).over(inclusive)
    if out.kind == "prev":
        return F.lag(out.value).over(window)
    if out.kind in ("max", "min"):
        return getattr(F, out.kind)(out.value).over(inclusive)
    raise ValueError(f"unknown scan kind: {out.kind}")


def value_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    block: Column,
) -> DataFrame:
    """Maximal runs of equal ``value``: keys, value, first_pos, last_pos, length.

    Runs are built inside blocks first; only the first and last run of every
    block take part in merging across blocks.
    """
    keys = list(keys)
    source = df.select(*keys, F.col(order).alias("__o"), F.col(value).alias("__v"), block.alias(_BLOCK))
    w = Window.partitionBy(*keys, _BLOCK).orderBy("__o")
    changed = source.withColumn(
        "__new", F.when(F.lag("__v").over(w).eqNullSafe(F.col("__v")) & F.lag("__o").over(w).isNotNull(), 0).otherwise(1)
    )
    numbered = changed.withColumn("__r", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, _BLOCK, "__r", "__v").agg(
        F.min("__o").alias("first_pos"), F.max("__o").alias("last_pos"), F.count(F.lit(1)).alias("length")
    )
    whole = Window.partitionBy(*keys, _BLOCK)
    runs = runs.withColumn("__edge", (F.col("__r") == 1) | (F.col("__r") == F.max("__r").over(whole)))
    inner = runs.filter(~F.col("__edge")).select(*keys, "__v", "first_pos", "last_pos", "length")
    across = Window.partitionBy(*keys).orderBy("first_pos")
    edges = (
        runs.filter(F.col("__edge"))
        .withColumn(
            "__join",
            F.when(
                F.lag("__v").over(across).eqNullSafe(F.col("__v"))
                & (F.lag(_BLOCK).over(across) != F.col(_BLOCK)),
                0,
            ).otherwise(1),
        )
        .withColumn("__g", F.sum("__join").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__g", "__v")
        .agg(
            F.min("first_pos").alias("first_pos"),
            F.max("last_pos").alias("last_pos"),
            F.sum("length").alias("length"),
        )
        .drop("__g")
    )
    return inner.unionByName(edges).withColumnRenamed("__v", value)


def floor_quantile(counts: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Order statistics ``sorted[int(q * (n - 1))]`` from a histogram.

    ``counts`` has keys, ``value`` and ``n`` (rows with that value), so the
    sorted data is never gathered; the running count is a blocked scan over
    the distinct values.
    """
    keys = list(keys)
    named = keys or ["__all"]
    hist = counts if keys else counts.withColumn("__all", F.lit(0))
    total = hist.groupBy(*named).agg(F.sum("n").alias("__total"))
    ranked = running_scan(
        hist, named, [value], F.floor(F.col(value) / F.lit(BLOCK_ROWS)).cast("long"), {"__upto": Running("sum", F.col("n"))}
    )
    picks = [
        F.min(F.when(F.col("__upto") >= F.floor(F.lit(q) * (F.col("__total") - 1)) + 1, F.col(value))).alias(name)
        for name, q in quantiles.items()
    ]
    out = ranked.join(total, named).groupBy(*named).agg(*picks)
    return out if keys else out.drop("__all")
