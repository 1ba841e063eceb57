"""Derived tables kept in the shared checkpoint folder.

The numbered step table is what most operators read.  It is written once per
application, so later queries scan narrow Parquet columns with pushed filters
instead of numbering the events again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell import schemas
from tracewell.session import ensure_checkpoint_dir

_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
        build(spark, sf_dir).write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "steps", lambda s, d: schemas.steps_from_events(s, d).sortWithinPartitions("sid", "seq")
    )
