"""Stored tables whose sessions can be replaced without rewriting the rest.

A table lies in hash buckets of the session id.  A commit writes the buckets of
the sessions it touches into a folder of its own and then one small manifest
file, which names for every table and bucket the commit that holds it; other
buckets stay where they are.  The manifest appears by Spark's committed
writer, in one rename, so readers see the tables before or after a commit, and a
failed one leaves nothing that is read.  ``expire`` deletes folders that no kept manifest names.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import materialize

BUCKETS = 64
_MANIFEST = "table string, bucket int, held_by long, merged long, n_buckets int"


class BucketedTables:
    """Tables with a ``sid`` column below ``root``; ``schemas`` gives their columns."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)
        newest = self.manifest()
        self.buckets = newest[0].n_buckets if newest else buckets  # fixed by the first commit

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("sid"), F.lit(self.buckets)).cast("int")

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def commits(self) -> list[int]:
        """Numbers of the commits that have a manifest."""
        files, where = self._folder(f"{self.root}/manifest")
        if not files.exists(where):
            return []
        names = [s.getPath() for s in files.listStatus(where)]
        done = [p for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("commit=")) for p in done)

    def manifest(self, commit: int | None = None) -> list:
        """Rows of a manifest, the newest by default: at most one for every table and bucket, and one for the table ''."""
        known = self.commits()
        if not known:
            return []
        return self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/commit={known[-1] if commit is None else commit}").collect()

    def merged(self) -> int:
        """Last batch that a commit says it contains; -1 without."""
        return max((r.merged for r in self.manifest()), default=-1)

    def _read(self, name: str, rows: list, touched: set[int] | None = None) -> DataFrame:
        parts = [r for r in rows if r.table == name and (touched is None or r.bucket in touched)]
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        paths = [f"{self.root}/{name}/commit={r.held_by}/bucket={r.bucket}" for r in parts]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def read(self, commit: int | None = None) -> dict[str, DataFrame]:
        """All tables as of a commit, the newest by default."""
        rows = self.manifest(commit)
        return {name: self._read(name, rows) for name in self.schemas}

    def replace(self, changed: Mapping[str, DataFrame], sids: DataFrame, merged: int = -1) -> int:
        """Replace the rows of ``sids`` by those of ``changed`` (all of these sessions); returns the commit's number.

        Sessions without rows in ``changed`` are deleted.  Rows of a touched bucket are read and
        written, a bucket that is not touched is neither.  A hot bucket is written by many tasks.
        """
        sids = materialize(sids.select("sid").distinct())
        touched = {r.bucket for r in sids.select(self._bucket().alias("bucket")).distinct().collect()}  # at most the number of buckets
        rows, commit = self.manifest(), max(self.commits(), default=-1) + 1
        kept = [(r.table, r.bucket, r.held_by) for r in rows if r.table and r.bucket not in touched]
        for name, schema in self.schemas.items():
            columns = self.spark.createDataFrame([], schema).columns
            stays = self._read(name, rows, touched).join(sids, "sid", "left_anti")
            whole = stays.select(columns).unionByName(changed[name].select(columns)).withColumn("bucket", self._bucket())
            folder = f"{self.root}/{name}/commit={commit}"
            whole.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            written = self.spark.read.schema(f"{schema}, bucket int").parquet(folder).select("bucket").distinct()
            kept += [(name, r.bucket, commit) for r in written.collect()]
        lines = [(*k, merged, self.buckets) for k in [*kept, ("", -1, commit)]]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/commit={commit}")
        return commit

    def expire(self, keep: int = 1) -> list[str]:
        """Delete manifests but the newest ``keep`` and the folders that only these name; returns what went."""
        if keep < 1:
            raise ValueError("the newest commit has to stay")
        known = self.commits()
        held = {(r.table, r.held_by, r.bucket) for commit in known[-keep:] for r in self.manifest(commit) if r.table}
        gone = []
        for commit in known[:-keep]:
            for name in self.schemas:
                files, where = self._folder(f"{self.root}/{name}/commit={commit}")
                inside = [s.getPath() for s in files.listStatus(where)] if files.exists(where) else []
                for path in inside:
                    number = path.getName().removeprefix("bucket=")
                    if number.isdigit() and (name, commit, int(number)) not in held and files.delete(path, True):
                        gone.append(path.toString())
            files, where = self._folder(f"{self.root}/manifest/commit={commit}")
            files.delete(where, True)
        return gone


def newest_rows(versions: list[DataFrame]) -> DataFrame:
    """(sid, at, batch) of the version of every session that counts: larger ``at``, then the later batch."""
    every = reduce(DataFrame.unionByName, versions)
    return every.groupBy("sid").agg(F.max(F.struct("at", "batch")).alias("v")).select("sid", "v.at", "v.batch")
