"""Exports: partitioned archives, corpus text, analysis rows, keyword runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text


def export_month(created: str = "created_at", updated: str = "updated_at"):
    stamp = F.coalesce(F.nullif(created, F.lit("")), F.nullif(updated, F.lit("")), F.lit(""))
    return F.when(stamp.rlike(r"^\d{4}-\d{2}"), F.substring(stamp, 1, 7)).otherwise("unknown-date")


def export_rows(
    sessions: DataFrame, messages: DataFrame, include_notes: bool = False, suppressed: DataFrame | None = None
) -> DataFrame:
    """Message rows with session facts and their partition (category, month)."""
    kept = sessions if suppressed is None else sessions.join(suppressed.select("sid").distinct(), "sid", "left_anti")
    said = messages if include_notes else messages.filter(F.col("role").isin("user", "assistant"))
    facts = kept.select(
        F.coalesce("category", F.lit("uncategorised")).alias("category"),
        export_month().alias("month"),
        "sid",
        "source",
        "title",
        "created_at",
        "updated_at",
    )
    return said.select("sid", "seq", "role", "ts", "raw").join(facts, "sid")


def write_export(rows: DataFrame, path: str) -> None:
    """JSON lines by category and month; long sessions may span files, ordered by sid and seq."""
    rows.repartitionByRange("category", "month", "sid", "seq").sortWithinPartitions("category", "month", "sid", "seq").write.partitionBy(
        "category", "month"
    ).json(path)


def export_manifest(rows: DataFrame) -> DataFrame:
    per_session = rows.groupBy("category", "month", "sid").agg(F.count(F.lit(1)).alias("messages"))
    return per_session.groupBy("category", "month").agg(F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"))


def corpus_lines(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(sid, seq, line): a header per session, then one block per user or assistant message."""
    header = F.concat(
        F.lit("<!-- SRC: "), "source", F.lit(" | "), "session_id", F.lit(" | "), F.coalesce("title", F.lit("")), F.lit(" | "),
        text.head(F.coalesce("created_at", F.lit("")), 10), F.lit(" -->\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"),
    )
    heads = sessions.select("sid", F.lit(-1).alias("seq"), header.alias("line"))
    stamp = F.when(F.coalesce("ts", F.lit("")) != "", F.concat(F.lit(" · "), "ts")).otherwise("")
    body = F.regexp_replace(text.normalize_newlines("raw"), r"(?U)\s+$", "")
    blocks = messages.filter(F.col("role").isin("user", "assistant")).select(
        "sid", "seq", F.concat(F.lit("## ["), "role", F.lit("]"), stamp, F.lit("\n\n"), body, F.lit("\n\n")).alias("line")
    )
    return heads.unionByName(blocks.join(sessions.select("sid"), "sid", "left_semi"))


def corpus_totals(lines: DataFrame) -> DataFrame:
    """Sections and characters; blocks of a section are joined by a newline."""
    return lines.agg(
        F.count_if(F.col("seq") == -1).alias("files"),
        (F.sum(F.length("line")) + F.count_if(F.col("seq") != -1)).alias("chars"),
    )


def write_corpus(lines: DataFrame, path: str) -> None:
    """Text files in session order, cut by range so no session has to fit one task."""
    ordered = lines.repartitionByRange("sid", "seq").sortWithinPartitions("sid", "seq")
    ordered.select("line").write.text(path)


ANALYSIS_KINDS = ("sessions", "tools", "errors", "skills", "triage")


def analysis_rows(kind: str, data: DataFrame, fingerprint: DataFrame, generated_at: str, hint: str = "") -> DataFrame:
    """JSON rows of an analysis: one header row, then one row per result row.

    Results stay rows, so an export of any size is written in parallel.
    """
    if kind not in ANALYSIS_KINDS:
        raise ValueError(f"kind must be one of {ANALYSIS_KINDS}: {kind!r}")
    head = fingerprint.select(
        F.lit(0).alias("part"),
        F.to_json(
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(generated_at).alias("generated_at"),
                F.struct(*fingerprint.columns).alias("db_fingerprint"),
                F.lit(hint).alias("hint"),
            )
        ).alias("json"),
    )
    rows = data.select(F.lit(1).alias("part"), F.to_json(F.struct(*data.columns)).alias("json"))
    return head.unionByName(rows)


class KeywordRuns:
    """Keyword runs as Parquet partitioned by run and gram length."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def runs(self) -> list[int]:
        """Run numbers, newest first (one folder per run)."""
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted((int(n.split("=", 1)[1]) for n in names if n.startswith("run_id=")), reverse=True)

    def append(self, stats: DataFrame) -> int:
        run = (self.runs() or [0])[0] + 1
        stats.write.partitionBy("n").parquet(f"{self.path}/run_id={run}")
        return run

    def newest(self, n: int, limit: int = 50) -> DataFrame | None:
        found = self.runs()
        if not found:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/run_id={found[0]}")
        return rows.filter(F.col("n") == n).orderBy(F.desc("doc_freq"), F.desc("freq"), "gram").limit(limit)

    def prune(self, keep: int = 1) -> list[int]:
        """Drop all but the newest runs; returns the dropped run numbers."""
        if keep < 1:
            raise ValueError("keep must be at least 1")
        fs, jvm = self._fs()
        dropped = self.runs()[keep:]
        for run in dropped:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/run_id={run}"), True)
        return dropped
