"""Global row numbers without a window over all rows.

Rows are range-partitioned by the order and sorted inside their partitions.
Each row then has a place in its partition; partition sizes, one row per
partition, are summed up and added.  No task sees more than its own range, also
where one key holds most rows, as long as the order tells its rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import materialize

_PLACE_BITS = 33  #: monotonically_increasing_id() holds the place in the partition in its lower bits


def ranged_blocks(df: DataFrame, order: list[Column], name: str = "range_block") -> DataFrame:
    """Add a block number that rises with ``order``: rows are dealt into ranges of about equal size by sampled bounds.

    With a key first in ``order`` a hot key falls into many blocks, also where most of its rows are close together.
    """
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id().cast("long")))


def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Add a dense 0-based number over ``order``.

    Rows that tie get neighbouring numbers in any order.  The sorted rows are written to the checkpoint
    folder, as range bounds come from a sample and would differ from run to run.
    The one broadcast holds a row per partition.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place)
    split = ranged.withColumn("__part", F.shiftright("__place", _PLACE_BITS)).withColumn(
        "__place", F.col("__place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    )
    kept = materialize(split)
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    numbered = kept.join(F.broadcast(starts), "__part")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + F.col("__place")).alias(name))
