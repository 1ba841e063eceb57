"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.session import ensure_checkpoint_dir

#: Rows of numbers that are sent to every executor (some 60 bytes each there) where else whole documents would be shuffled.
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which every executor and the driver can reach."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, executors may be lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_text(text: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def hash_sample(df: DataFrame, key: str, count: int) -> DataFrame:
    """At most ``count`` rows, those with the lowest hash of ``key``.

    Rows are thinned by their hash to about twice as many first, so tasks send
    the driver a bounded number of rows in all, however many tasks there are.
    """
    share = min(1.0, 2 * count / max(df.count(), 1))
    place = F.xxhash64(key)
    thin = df if share == 1.0 else df.filter(F.pmod(place, F.lit(1 << 40)) < int(share * (1 << 40)))
    return thin.orderBy(F.pmod(place, F.lit(1 << 40)), key).limit(count)


def narrow(keys: DataFrame) -> DataFrame:
    """``keys`` (stored, a few numbers a row) with a broadcast hint up to ``BROADCAST_KEYS`` rows, so that wide rows need no shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keep_rows(docs: DataFrame, keys: dict[str, Column], decisions: DataFrame, kept: str) -> DataFrame:
    """The rows of ``docs`` whose keys have a true ``kept`` in ``decisions`` (the keys, kept), one row for each such keys.

    ``decisions`` has the keys of every row, null included, as often as they occur.  Of several rows with the same kept
    keys the one with the lowest hash of all columns stays (maps are left out of the hash); they are combined before they
    are shuffled.  Columns of ``docs`` may have any names and types; an empty table stays empty.

    Rows go by a 64-bit hash of their keys, which is exact: as ``decisions`` knows all keys, it also knows the hashes that
    rows which stay have in common with others, and those rows are compared by their keys.
    """
    judged = decisions.groupBy(_key_hash([F.col(k) for k in keys]).alias("mark_hash"), *[F.col(k).alias(f"mark_{k}") for k in keys]).agg(
        F.max(kept).alias("mark_stays"), F.count("*").alias("mark_rows"))
    alike = Window.partitionBy("mark_hash")
    marks = judged.withColumn("mark_plain", F.min(F.col("mark_stays") & (F.col("mark_rows") == 1)).over(alike))
    marks = stored(marks.filter(~F.col("mark_plain")), "keep-marks")
    keyed = docs.select(F.struct("*").alias("row"), *[c.alias(f"key_{k}") for k, c in keys.items()])
    keyed = keyed.withColumn("key_hash", _key_hash([F.col(f"key_{k}") for k in keys]))
    hashes = stored(marks.groupBy("mark_hash").agg(F.max("mark_stays").alias("mark_any")), "keep-hashes")
    hashed = F.col("key_hash") == F.col("mark_hash")
    alone = keyed.join(narrow(hashes.select("mark_hash")), hashed, "left_anti").select("row.*")
    unclear = hashes.filter("mark_any").select("mark_hash")
    if unclear.isEmpty():
        return alone
    same = reduce(and_, [F.col(f"key_{k}").eqNullSafe(F.col(f"mark_{k}")) for k in keys])
    seen = keyed.join(narrow(unclear), hashed, "left_semi").join(marks.filter("mark_stays"), hashed & same, "left_semi")
    values = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = seen.groupBy(*[f"key_{k}" for k in keys]).agg(F.min_by("row", F.xxhash64(*values)).alias("row"))
    return alone.unionByName(one.select("row.*"))


def _key_hash(keys: list[Column]) -> Column:
    return F.xxhash64(*keys)
