"""Table schemas and the projections of the given tables onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import text
from tracewell.plans.scan import Running, position_scan


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SESSIONS = T.StructType(
    _strings("sid", "source", "session_id", "title", "category", "created_at", "updated_at", "file", "model")
)
MESSAGES = T.StructType(
    [T.StructField("sid", T.StringType()), T.StructField("seq", T.IntegerType()), *_strings("role", "ts", "text", "raw")]
)
STEPS = T.StructType(
    [
        T.StructField("sid", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        *_strings("ts", "tool", "phase", "status", "error", "detail"),
    ]
)
TOPICS = T.StructType(
    [*_strings("topic_id", "name"), T.StructField("keywords", T.ArrayType(T.StringType())), *_strings("created")]
)
TOPIC_MEMBERS = T.StructType([*_strings("topic_id", "sid", "evidence"), T.StructField("pos", T.IntegerType())])
NOISE = T.StructType(_strings("sid", "reason", "created"))
SUPPRESSED = T.StructType(_strings("sid", "reason", "created", "created_by"))
LEDGER = T.StructType(_strings("key", "status", "adopted_at", "note", "updated_at"))
VERDICTS = T.StructType(_strings("face", "subject", "key", "verdict", "note", "reviewed_at"))
ARTIFACTS = T.StructType(
    [
        T.StructField("sid", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        *_strings("ts", "tool", "file_path", "old_text", "new_text"),
    ]
)
ANCHOR = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("turn", T.IntegerType())])
CARDS = T.StructType(
    [
        *_strings("id", "title", "type"),
        T.StructField("anchors", T.ArrayType(ANCHOR)),
        *_strings("evidence", "summary"),
        T.StructField("triggers", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        *_strings("created", "topic_id"),
    ]
)
CHAIN_NODES = T.StructType(
    [
        T.StructField("chain_id", T.StringType()),
        T.StructField("stage_no", T.IntegerType()),
        *_strings("stage", "span", "sid"),
        T.StructField("turn", T.IntegerType()),
        T.StructField("note", T.StringType()),
    ]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool steps of one session per user, numbered by time."""
    events = read_table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    position = F.unix_micros(F.col("ts").cast("timestamp"))
    numbered = position_scan(events, ["user_id"], ["ts", "event_id"], position, {"nth": Running("sum", F.lit(1))})
    is_call = F.col("event_type").isin("click", "view", "signup")
    is_skill = F.col("k") % 5 == 0
    code = (
        F.when(F.col("k") % 3 == 0, " timed out").when(F.col("k") % 3 == 1, " does not exist").otherwise(" out of range")
    )
    return numbered.select(
        F.concat(F.lit("u:"), F.col("user_id")).alias("sid"),
        (F.col("nth") - 1).cast("int").alias("seq"),
        F.col("ts").cast("string").alias("ts"),
        F.when(is_skill, F.lit("Skill")).otherwise(F.concat(F.lit("tool_"), F.col("k") % 5)).alias("tool"),
        F.when(is_call, "call").otherwise("result").alias("phase"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "completed")
        .alias("status"),
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit('Error: cannot open "f'), F.col("event_id"), F.lit('" code '), F.col("k"), code),
        ).alias("error"),
        F.when(is_skill & is_call, F.concat(F.lit('{"skill":"sk'), F.col("k") % 4, F.lit('"}'))).alias("detail"),
    )


def sessions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user; source and model follow the user number."""
    bounds = (
        read_table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min("ts").cast("string").alias("created_at"), F.max("ts").cast("string").alias("updated_at"))
    )
    sid = F.concat(F.lit("u:"), F.col("user_id"))
    return bounds.select(
        sid.alias("sid"),
        F.concat(F.lit("src"), F.col("user_id") % 4).alias("source"),
        F.col("user_id").cast("string").alias("session_id"),
        sid.alias("title"),
        F.lit(None).cast("string").alias("category"),
        "created_at",
        "updated_at",
        F.lit(None).cast("string").alias("file"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("m"), F.col("user_id") % 3)).alias("model"),
    )


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv:"), F.col("conv_id")).alias("sid"),
        F.col("turn").cast("int").alias("seq"),
        "role",
        F.lit(None).cast("string").alias("ts"),
        F.col("text").alias("text"),
        F.col("text").alias("raw"),
    )


def sessions_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per conversation, titled by its first user text."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return (
        read_table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(first.alias("first_user"))
        .select(
            F.concat(F.lit("conv:"), F.col("conv_id")).alias("sid"),
            F.lit("conv").alias("source"),
            F.col("conv_id").cast("string").alias("session_id"),
            text.head(text.fold("first_user"), 80).alias("title"),
            *[F.lit(None).cast("string").alias(n) for n in ("category", "created_at", "updated_at", "file", "model")],
        )
    )
