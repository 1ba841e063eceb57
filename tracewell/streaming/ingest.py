"""Streaming ingestion of archive files.

Each micro-batch appends its sessions, messages and steps under its own batch
folder, so a retried batch overwrites only itself and nothing stored is
rewritten.  The current tables are the latest version of every session.
``compact`` moves finished batches into the bucketed tables: only the buckets of
sessions that got a new version are rewritten, and from then on only
later batches are read beside the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.session import materialize
from tracewell.sources import formats, ingest
from tracewell.sources.buckets import BUCKETS, BucketedTables, newest_rows

TABLES = ("sessions", "messages", "steps")
SCHEMAS = {
    "sessions": "sid string, source string, session_id string, title string, category string, created_at string, updated_at string, "
    "file string, model string",
    "messages": "sid string, seq int, role string, ts string, text string, raw string",
    "steps": "sid string, seq int, ts string, tool string, phase string, status string, error string, detail string",
}


def latest_per_sid(records: DataFrame) -> DataFrame:
    """One record per sid: the latest updated_at, then the largest file name."""
    best = records.groupBy("sid").agg(F.max(F.struct(F.coalesce("updated_at", F.lit("")).alias("at"), "file")).alias("b"))
    winners = best.select("sid", F.col("b.file").alias("file"))
    return records.join(winners, ["sid", "file"], "left_semi")


def write_batch(records: DataFrame, root: str, batch_id: int) -> None:
    """Append a batch; its files are parsed once."""
    tables = dict(zip(TABLES, ingest.build_tables(materialize(latest_per_sid(records)))))
    for name in ("messages", "steps", "sessions"):  # sessions last: they make the batch visible
        tables[name].write.mode("overwrite").parquet(f"{root}/batches/{name}/batch={batch_id}")


def start_ingestion(
    spark: SparkSession, inbox: str, root: str, checkpoint: str, suppressed: DataFrame | None = None, max_files: int = 1000
) -> StreamingQuery:
    """Ingest archive JSON files as they arrive."""
    stream = (
        spark.readStream.schema(formats.ARCHIVE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("maxFilesPerTrigger", max_files)
        .json(inbox)
        .withColumn("file", F.col("_metadata.file_path"))
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        # every file is opened once, before anything is joined
        records = materialize(formats.archive_records(batch, inbox, suppressed))
        write_batch(records, root, batch_id)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, root: str, buckets: int = BUCKETS) -> BucketedTables:
    return BucketedTables(spark, f"{root}/tables", SCHEMAS, buckets)


def _batches(spark: SparkSession, root: str, name: str, after: int) -> DataFrame:
    """Rows of the batches that are not merged yet, with their batch."""
    read = spark.read.schema(f"{SCHEMAS[name]}, batch long").parquet(f"{root}/batches/{name}")
    return read.filter(F.col("batch") > after)  # a filter on folders


def _pending(spark: SparkSession, root: str, held: dict[str, DataFrame], after: int) -> DataFrame:
    """(sid, batch) of sessions whose version of a pending batch counts."""
    at = F.coalesce("updated_at", F.lit("")).alias("at")
    stored = held["sessions"].select("sid", at, F.lit(-1).cast("long").alias("batch"))
    fresh = _batches(spark, root, "sessions", after).select("sid", at, "batch")
    return newest_rows([stored.join(fresh.select("sid").distinct(), "sid", "left_semi"), fresh]).filter("batch >= 0").select("sid", "batch")


def current_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Latest version of every session: larger updated_at wins, then the later batch."""
    store = _stored(spark, root)
    held, after = store.read(), store.merged()
    wins = _pending(spark, root, held, after)
    return {
        name: held[name].join(wins.select("sid"), "sid", "left_anti").unionByName(
            _batches(spark, root, name, after).join(wins, ["sid", "batch"], "left_semi").drop("batch"))
        for name in TABLES
    }


def compact(spark: SparkSession, root: str, buckets: int = BUCKETS) -> int | None:
    """Merge pending batches into the bucketed tables; returns the commit, None if nothing was pending.

    Batches that arrive meanwhile stay pending: the last one seen at the start is recorded.  The
    buckets are made by the first call.
    """
    store = _stored(spark, root, buckets)
    after = store.merged()
    last = _batches(spark, root, "sessions", after).agg(F.max("batch")).first()[0]
    if last is None:
        return None
    wins = materialize(_pending(spark, root, store.read(), after).filter(F.col("batch") <= last))
    changed = {name: _batches(spark, root, name, after).join(wins, ["sid", "batch"], "left_semi").drop("batch") for name in TABLES}
    return store.replace(changed, wins, merged=last)
