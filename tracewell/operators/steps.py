"""Statistics over tool steps: calls, errors, retries, patterns, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.functions import text
from tracewell.plans.scan import Running, running_scan, seq_block

#: Statuses that count as success, and as failure for the health profile.
OK_STATUS = ("success", "completed", "ok")
FAIL_STATUS = ("error", "failed", "fail", "failure", "exception")
#: Tools whose call starts a skill.
SKILL_TOOLS = ("Skill", "skill", "skill_read_active", "skill_run_asset")
RANK_MIN_CALLS = 20
UNKNOWN_MODEL = "(unknown)"
NO_SKILL = "(no skill)"


def recent(df: DataFrame, cutoff: str | None, column: str = "ts") -> DataFrame:
    """Rows at or after a stamp; the caller passes the stamp so runs are repeatable."""
    return df if cutoff is None else df.filter(F.col(column) >= F.lit(cutoff))


def cutoff_stamp(now: str, days: float) -> str:
    from datetime import datetime, timedelta

    return (datetime.strptime(now, "%Y-%m-%d %H:%M:%S") - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")


def is_call() -> Column:
    return F.coalesce(F.col("phase") == "call", F.lit(False))


def is_error_result() -> Column:
    """A result whose status is not one of the success words."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    return ~is_call() & ~status.isin(*OK_STATUS)


def with_source(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach source (missing becomes ``?``) and model by sid."""
    side = sessions.select("sid", "source", "model")
    joined = df.join(side, "sid", "left")
    return joined.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("?")))


def tool_counts(steps: DataFrame, keys: Sequence[str] = ("tool",)) -> DataFrame:
    return steps.groupBy(*keys).agg(
        F.count_if(is_call()).alias("calls"),
        F.count_if(~is_call() & ~is_error_result()).alias("success"),
        F.count_if(is_error_result()).alias("error"),
    )


def error_details(steps: DataFrame, keys: Sequence[str] = ("tool",)) -> DataFrame:
    """Histogram of error details per tool (error text, else the status)."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    detail = text.strip(F.coalesce(F.nullif(F.col("error"), F.lit("")), status))
    return (
        steps.filter(is_error_result())
        .select(*keys, detail.alias("detail"))
        .filter(F.col("detail") != "")
        .groupBy(*keys, "detail")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def retry_rows(steps: DataFrame) -> DataFrame:
    """Calls flagged ``is_retry``: the row before, among calls and error results
    of the same session and tool, is an error result."""
    marked = steps.filter(is_call() | is_error_result()).select("sid", "tool", "seq", is_error_result().alias("is_err"))
    scanned = running_scan(
        marked, ["sid", "tool"], ["seq"], seq_block(), {"before": Running("prev", F.struct(F.col("is_err").alias("err")))}
    )
    return scanned.withColumn("is_retry", ~F.col("is_err") & F.coalesce(F.col("before.err"), F.lit(False)))


def retry_flow(steps: DataFrame) -> DataFrame:
    """errors, retried and given_up per tool."""
    return (
        retry_rows(steps)
        .groupBy("tool")
        .agg(F.count_if("is_err").alias("errors"), F.count_if("is_retry").alias("retried"))
        .withColumn("given_up", F.col("errors") - F.col("retried"))
    )


def tool_stats(steps: DataFrame) -> DataFrame:
    """Counts with retry flow per raw tool name."""
    counts = tool_counts(steps)
    flow = retry_flow(steps).select("tool", "retried")
    return counts.join(flow, "tool", "left").withColumn("retried", F.coalesce("retried", F.lit(0)))


def merge_aliases(stats: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Merge spellings of one tool; the most called spelling (then smallest) names it.

    Works on per-name totals, so groups hold only spellings.
    """
    key = F.regexp_replace(F.lower("tool"), "_", "")
    numeric = [c for c in ("calls", "success", "error", "retried") if c in stats.columns]
    keyed = stats.withColumn("__key", key)
    merged = keyed.groupBy(*partition, "__key").agg(
        F.min_by("tool", F.struct(-F.col("calls"), F.col("tool"))).alias("tool"),
        *[F.sum(c).alias(c) for c in numeric],
        F.array_sort(F.collect_set("tool")).alias("raw_tools"),
    )
    out = merged.drop("__key")
    if "retried" in numeric:
        out = out.withColumn("given_up", F.col("error") - F.col("retried"))
    return out


def tool_rows(stats: DataFrame, min_calls: int = 0, rank_min: int = RANK_MIN_CALLS) -> DataFrame:
    """Ranked report rows: enough calls first by errors, then the small samples by calls."""
    rate = F.when(F.col("calls") > 0, F.round(F.col("error") / F.col("calls"), 4)).otherwise(F.lit(0.0))
    exact = F.when(F.col("calls") > 0, F.col("error") / F.col("calls")).otherwise(F.lit(0.0))
    ranked = F.col("calls") >= rank_min
    low = (F.col("calls") < min_calls) if min_calls > 0 else F.lit(False)
    out = stats.select("*", rate.alias("fail_rate"), exact.alias("__rate"), ranked.alias("ranked"), low.alias("low_sample"))
    return out.orderBy(
        F.desc("ranked"),
        F.when(F.col("ranked"), F.col("error")).otherwise(F.col("calls")).desc(),
        F.when(F.col("ranked"), F.round("__rate", 12)).otherwise(F.lit(0.0)).desc(),
        "tool",
    ).drop("__rate")


def error_roots(details: DataFrame) -> DataFrame:
    """Error details merged by normalised pattern inside a tool."""
    pattern = text.normalize_error("detail")
    fallback = F.when(F.col("detail") == "", "(empty)").otherwise(text.head("detail", 60))
    return (
        details.withColumn("pattern", F.when(pattern != "", pattern).otherwise(fallback))
        .groupBy("tool", "pattern")
        .agg(
            F.sum("n").alias("count"),
            F.min("detail").alias("sample"),
        )
        .withColumn("class", R.error_class(F.col("sample")))
    )


def source_tool_stats(steps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tool counts per source, spellings merged inside each source.

    Steps are pre-aggregated per session before sources are attached.
    """
    per_session = tool_counts(steps, ["sid", "tool"])
    attached = with_source(per_session, sessions)
    sums = attached.groupBy("source", "tool").agg(*[F.sum(c).alias(c) for c in ("calls", "success", "error")])
    return merge_aliases(sums, ["source"])


def model_tool_stats(steps: DataFrame, sessions: DataFrame) -> DataFrame:
    per_session = tool_counts(steps, ["sid"])
    attached = per_session.join(sessions.select("sid", "model"), "sid").filter(F.coalesce("model", F.lit("")) != "")
    return attached.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("calls", "success", "error")])


def note_tool_stats(messages: DataFrame) -> DataFrame:
    """Tool counts from marker lines in note messages."""
    # The marker shapes.
    call_shape = r"(?U)^\[tool_call\]\s+([^\s:]+):"
    result_shape = r"(?U)^\[tool_result\]\s+([^\s:]+):\s+(\S+)\s*(.*)$"
    line = F.regexp_replace(F.coalesce("raw", F.lit("")), r"(?U)^[\s\x1c-\x1f]+", "")
    called = F.regexp_extract(line, call_shape, 1)
    parsed = messages.filter(F.col("role") == "note").select(
        F.when(called != "", called).otherwise(F.regexp_extract(line, result_shape, 1)).alias("tool"),
        F.when(called != "", "call").otherwise("result").alias("phase"),
        F.regexp_extract(line, result_shape, 2).alias("status"),
    )
    return tool_counts(parsed.filter(F.col("tool") != ""))


# --- skills -----------------------------------------------------------------


def skill_name(tool: Column, detail: Column) -> Column:
    """Skill named by a call's JSON detail; empty when it cannot be read."""
    path = F.coalesce(F.get_json_object(detail, "$.path"), F.lit(""))
    parts = F.split(path, r"[\\/]+")
    from_path = F.when((F.size(parts) >= 2) & (F.get(parts, F.lit(0)) != ""), F.get(parts, F.lit(0))).otherwise("")
    named = F.coalesce(
        *[F.nullif(F.get_json_object(detail, f"$.{k}"), F.lit("")) for k in ("skill", "command", "name")], F.lit("")
    )
    return F.when(tool == "skill_read_active", from_path).otherwise(named)


def skill_args(tool: Column, detail: Column) -> Column:
    path = F.coalesce(F.get_json_object(detail, "$.path"), F.lit(""))
    args = F.coalesce(F.get_json_object(detail, "$.args"), F.lit(""))
    return F.when(
        tool == "skill_read_active", F.when(skill_name(tool, detail) != "", path).otherwise("")
    ).otherwise(args)


def is_skill_call() -> Column:
    return is_call() & F.col("tool").isin(*SKILL_TOOLS)


# --- errors -----------------------------------------------------------------


def max_call_seq(steps: DataFrame) -> DataFrame:
    return steps.filter(is_call()).groupBy("sid", "tool").agg(F.max("seq").alias("last_call"))


def active_skill(steps: DataFrame, errors_filter: Column) -> DataFrame:
    """For each selected row the latest skill call at or before it in its session."""
    name = F.nullif(skill_name(F.col("tool"), F.col("detail")), F.lit(""))
    calls = F.when(is_skill_call(), name)
    rows = steps.select("sid", "seq", calls.alias("skill_called"), errors_filter.alias("wanted")).filter(
        F.col("wanted") | F.col("skill_called").isNotNull()
    )
    scanned = running_scan(rows, ["sid"], ["seq"], seq_block(), {"skill": Running("last", F.col("skill_called"))})
    return scanned.filter("wanted").select("sid", "seq", "skill")


def collect_errors(
    steps: DataFrame,
    sessions: DataFrame,
    cutoff: str | None = None,
    rules: Sequence[R.Rule] = R.DEFAULT_RULES,
    families: Sequence[tuple[str, Sequence[str]]] = (),
) -> DataFrame:
    """One row per step with status ``error``: class, pattern, place, outcome, skill, source, model."""
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    window = recent(steps, cutoff)
    errors = window.filter(failed).select("sid", "seq", "ts", "tool", F.coalesce("error", F.lit("")).alias("error"))
    ends = steps.groupBy("sid").agg(F.max("seq").alias("max_seq"))
    skills = active_skill(window, failed)
    joined = (
        with_source(errors, sessions)
        .join(ends, "sid", "left")
        .join(max_call_seq(window), ["sid", "tool"], "left")
        .join(skills, ["sid", "seq"], "left")
    )
    ratio = F.col("seq") / F.when(F.coalesce("max_seq", F.lit(0)) == 0, 1).otherwise(F.col("max_seq"))
    return joined.select(
        "sid",
        "seq",
        "ts",
        "tool",
        "error",
        "source",
        F.coalesce(F.nullif("model", F.lit("")), F.lit(UNKNOWN_MODEL)).alias("model"),
        R.error_class(F.col("error"), rules, families).alias("class"),
        text.normalize_error("error").alias("pattern"),
        F.when(ratio <= 1 / 3, "opening").when(ratio <= 2 / 3, "middle").otherwise("closing").alias("bucket"),
        F.coalesce(F.col("last_call") > F.col("seq"), F.lit(False)).alias("resolved"),
        "skill",
    )


def error_meta(steps: DataFrame, errors: DataFrame) -> DataFrame:
    """total_steps, error_count, sessions in one row."""
    total = steps.agg(F.count(F.lit(1)).alias("total_steps"))
    seen = errors.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("error_count"), F.count(F.lit(1)).alias("sessions")
    )
    return total.join(seen)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group; the rank filter is applied before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def pattern_stats(errors: DataFrame) -> DataFrame:
    """Per pattern: class, count, tools, given_up, first_seen (missing stamps skipped)."""
    return errors.groupBy("pattern").agg(
        F.min_by("class", F.struct("sid", "seq")).alias("class"),
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.count_if(~F.col("resolved")).alias("given_up"),
        F.coalesce(F.min(F.nullif("ts", F.lit(""))), F.lit("")).alias("first_seen"),
    )


def pattern_samples(errors: DataFrame, k: int = 3) -> DataFrame:
    return top_per_group(errors, ["pattern"], [F.col("sid"), F.col("seq")], k).select(
        "pattern", "rank", "sid", "seq", "error"
    )


def _class_columns(aliased: dict[str, str]) -> list[Column]:
    return [F.count_if(F.col("class") == c).alias(a) for c, a in aliased.items()]


def cross_source_model(errors: DataFrame) -> DataFrame:
    """source x model x class counts with a total."""
    return (
        errors.groupBy("source", "model")
        .agg(*_class_columns({c: c for c in R.CLASSES}), F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "source", "model")
    )


def cross_skill_source(errors: DataFrame) -> DataFrame:
    skill = F.coalesce(F.nullif("skill", F.lit("")), F.lit(NO_SKILL)).alias("skill")
    return (
        errors.groupBy(skill, "source")
        .agg(*_class_columns({c: c for c in R.CLASSES}), F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "skill", "source")
    )


def pattern_occurrences(errors: DataFrame, sessions: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Occurrences of every pattern in the chosen sessions, one row each, with the pattern's count."""
    chosen = recent(sessions, cutoff, "updated_at").select("sid")
    key = F.when(F.col("pattern") != "", F.col("pattern")).otherwise(
        F.when(F.col("error") == "", "(empty)").otherwise(text.head("error", 80))
    )
    rows = errors.join(chosen, "sid", "left_semi").withColumn("pattern", key)
    counts = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"))
    return rows.join(counts, "pattern").select("pattern", "count", "sid", "seq", "ts", "tool")
