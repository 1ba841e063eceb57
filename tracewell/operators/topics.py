"""Topic registry operations: merge, insert, plans, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import reports as RP

ACTIONS = ("assign", "noise", "skip", "unhandled")


def merge_members(members: DataFrame, merges: DataFrame) -> DataFrame:
    """Members after merging topics: ``merges`` has target, source, ord.

    The target's own entry wins, then the first source in order; rows taken
    over say where they came from.
    """
    into = merges.select(F.col("source").alias("topic_id"), "target", "ord")
    joined = members.join(into, "topic_id", "left")
    evidence = F.trim(F.coalesce("evidence", F.lit("")))
    mark = F.concat(F.lit("merged from "), "topic_id")
    noted = F.when(F.col("target").isNull(), F.col("evidence")).when(evidence == "", mark).otherwise(
        F.concat(evidence, F.lit(" ("), mark, F.lit(")"))
    )
    placed = joined.select(
        F.coalesce("target", "topic_id").alias("topic_id"),
        "sid",
        F.struct(F.coalesce("ord", F.lit(-1)).alias("ord"), F.col("pos")).alias("place"),
        noted.alias("evidence"),
    )
    return placed.groupBy("topic_id", "sid").agg(F.min_by("evidence", "place").alias("evidence"))


def merge_keywords(topics: DataFrame, merges: DataFrame) -> DataFrame:
    """Keywords per topic after merging, each once."""
    into = merges.select(F.col("source").alias("topic_id"), "target")
    words = topics.select("topic_id", F.explode("keywords").alias("keyword")).join(into, "topic_id", "left")
    return words.select(F.coalesce("target", "topic_id").alias("topic_id"), "keyword").distinct()


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not present yet, one per key: what an idempotent insert adds."""
    fresh = rows.join(existing.select(*keys).distinct(), keys, "left_anti")
    return fresh.dropDuplicates(keys)


def plan_rows(triage: DataFrame, overrides: DataFrame, noise: DataFrame, skip: DataFrame, topics: DataFrame, craft_topic: str | None = None) -> DataFrame:
    """Action per triage row: override > noise > skip > topic hint > craft topic, else unhandled.

    ``triage`` has sid, verdict, topic (hint name); ``overrides`` sid, target.
    """
    flags = (
        triage.select("sid", "verdict", "topic")
        .join(overrides.select("sid", "target"), "sid", "left")
        .join(noise.select("sid", F.lit(True).alias("as_noise")).distinct(), "sid", "left")
        .join(skip.select("sid", F.lit(True).alias("as_skip")).distinct(), "sid", "left")
        .join(topics.select(F.col("name").alias("topic"), F.col("topic_id").alias("hinted")), "topic", "left")
    )
    craft = F.lit(craft_topic).cast("string")
    target = (
        F.when(F.col("target").isNotNull(), F.col("target"))
        .when(F.col("as_noise") | F.col("as_skip"), F.lit(None).cast("string"))
        .when(F.col("verdict").isin("topic_hint", "deep_topic_hint"), F.col("hinted"))
        .when(F.col("verdict") == "craft_material", craft)
    )
    action = (
        F.when(F.col("target").isNotNull(), "assign")
        .when(F.col("as_noise"), "noise")
        .when(F.col("as_skip"), "skip")
        .when(target.isNotNull(), "assign")
        .otherwise("unhandled")
    )
    return flags.select("sid", "verdict", action.alias("action"), target.alias("target"))


def plan_stats(rows: DataFrame) -> DataFrame:
    """Counts of every action per verdict."""
    return rows.groupBy("verdict").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])


def judgment_conflicts(triage: DataFrame, overrides: DataFrame, noise: DataFrame, skip: DataFrame, topics: DataFrame) -> DataFrame:
    """(sid, problem): sids not in the triage, in two lists, or sent to unknown topics."""
    named = (
        overrides.select("sid", F.lit("overrides").alias("list"))
        .unionByName(noise.select("sid", F.lit("noise").alias("list")))
        .unionByName(skip.select("sid", F.lit("skip").alias("list")))
        .distinct()
    )
    ghosts = named.join(triage.select("sid"), "sid", "left_anti").select("sid", F.lit("not in triage").alias("problem"))
    twice = named.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        "sid", F.lit("in two lists").alias("problem")
    )
    unknown = (
        overrides.filter(~F.col("target").startswith("new:"))
        .join(topics.select(F.col("topic_id").alias("target")), "target", "left_anti")
        .select("sid", F.lit("unknown topic").alias("problem"))
    )
    return ghosts.unionByName(twice).unionByName(unknown).distinct()


def plan_problems(
    topics: DataFrame, placements: DataFrame, assigns: DataFrame, members: DataFrame, noise: DataFrame, new_keys: DataFrame
) -> DataFrame:
    """(subject, problem) rows of a consolidation plan; no row means it may be applied.

    ``placements`` has topic_id and place (target, from, discard, keep, rename,
    assign); ``assigns`` has target, sid, where ``new:<key>`` names a new topic.
    """
    known = topics.select("topic_id")
    counts = placements.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        placements.join(known, "topic_id", "left_anti").select(F.col("topic_id").alias("subject"), F.lit("unknown topic").alias("problem")),
        counts.filter(F.col("n") > 1).join(known, "topic_id", "left_semi").select(F.col("topic_id").alias("subject"), F.lit("placed more than once").alias("problem")),
        known.join(counts, "topic_id", "left_anti").select(F.col("topic_id").alias("subject"), F.lit("not placed").alias("problem")),
    ]
    is_new = F.col("target").startswith("new:")
    existing = assigns.filter(~is_new)
    parts.append(
        existing.join(known.select(F.col("topic_id").alias("target")), "target", "left_anti").select(
            F.col("sid").alias("subject"), F.lit("assigned to unknown topic").alias("problem")
        )
    )
    parts.append(
        assigns.filter(is_new)
        .withColumn("key", F.substring("target", 5, 1000))
        .join(new_keys.select("key"), "key", "left_anti")
        .select(F.col("sid").alias("subject"), F.lit("assigned to undefined new topic").alias("problem"))
    )
    parts.append(
        assigns.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
            F.col("sid").alias("subject"), F.lit("assigned twice").alias("problem")
        )
    )
    owner = members.groupBy("sid").agg(F.min("topic_id").alias("owner"))
    parts.append(
        assigns.join(owner, "sid").filter(F.col("owner") != F.col("target")).select(
            F.col("sid").alias("subject"), F.lit("owned by another topic").alias("problem")
        )
    )
    parts.append(
        assigns.join(noise.select("sid").distinct(), "sid", "left_semi").select(
            F.col("sid").alias("subject"), F.lit("both noise and assigned").alias("problem")
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def apply_plan(members: DataFrame, merges: DataFrame, assigns: DataFrame, discards: DataFrame) -> DataFrame:
    """Member table after a valid plan: merge, add assigned sids, drop discarded topics."""
    merged = merge_members(members, merges)
    added = insert_new(
        merged, assigns.select(F.col("target").alias("topic_id"), "sid", F.lit("plan").alias("evidence")), ["topic_id", "sid"]
    )
    return merged.unionByName(added).join(discards.select("topic_id"), "topic_id", "left_anti")


def write_swap(df: DataFrame, path: str) -> str:
    """Write a whole new version of a table beside the old ones and return its path.

    A plan takes effect when readers are pointed to the finished folder, so a
    failed write leaves the old version untouched.
    """
    import uuid

    target = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    return target


def bundle_members(members: DataFrame, sessions: DataFrame) -> DataFrame:
    """Members of every topic with session facts and in_index."""
    resolved = RP.resolve_ids(members.select(F.col("sid").alias("key")), sessions)
    facts = sessions.select("sid", "source", "title", "created_at", "updated_at")
    joined = members.select("topic_id", F.col("sid").alias("key"), "evidence").join(resolved, "key").join(facts, "sid", "left")
    return joined.select(
        "topic_id",
        F.coalesce("sid", "key").alias("sid"),
        "source",
        "title",
        "created_at",
        "updated_at",
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.col("sid").isNotNull().alias("in_index"),
    )


def bundle_summary(bundle: DataFrame, noise: DataFrame) -> DataFrame:
    """members_count, activity bounds, missing and noise members per topic."""
    flagged = bundle.join(noise.select("sid", F.lit(1).alias("noisy")).distinct(), "sid", "left")
    dated = F.nullif("created_at", F.lit(""))
    return flagged.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("members_count"),
        F.min(dated).alias("first_activity"),
        F.max(dated).alias("last_activity"),
        F.count_if(~F.col("in_index")).alias("missing"),
        F.count("noisy").alias("noise_members"),
    )


def bundle_histogram(bundle: DataFrame) -> DataFrame:
    """Members per source and per month: (topic_id, kind, value, n)."""
    present = bundle.filter("in_index")
    by_source = present.select("topic_id", F.lit("source").alias("kind"), F.col("source").alias("value"))
    by_month = present.filter(F.coalesce("created_at", F.lit("")) != "").select(
        "topic_id", F.lit("month").alias("kind"), F.substring("created_at", 1, 7).alias("value")
    )
    return by_source.unionByName(by_month).groupBy("topic_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
