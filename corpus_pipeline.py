"""The corpus pipeline: five operators in a row, each over all its predecessor kept.

All stages judge every row by itself, also where rows share an id or have none; a null text counts as empty; texts of
any length are read whole; an empty table gives an empty one.  Columns of other names stay as they are, except that
columns called mix_domain, mix_tokens or mix_epoch give way to those of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, exact_dedup, mixing, quality, simhash
from tracewell.llm.common import stored, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; empty texts are scored like others."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: of the smallest id, without an id only where no row of the text has one."""
    return exact_dedup.drop_exact_rows(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints one row stays, of the smallest id; texts without words link with each other."""
    return simhash.drop_near_copies(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; texts without words are clean."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per document and epoch, with the columns mix_domain, mix_tokens and mix_epoch."""
    own = [F.col(f"document.`{c}`").alias(c) for c in docs.columns if c not in ("mix_domain", "mix_tokens", "mix_epoch")]
    return mixing.mix(docs).select(
        *own, F.col("domain").alias("mix_domain"), F.col("n_tokens").alias("mix_tokens"), F.col("epoch").alias("mix_epoch")
    )


STAGES = [
    ("quality", accept_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]

#: SQL cannot express the trained classifier; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
