"""Cross-table reports: health, growth, keywords, spans, facets, session lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import sequence as SQ
from tracewell.operators import steps as ST
from tracewell.plans.scan import floor_quantile

THIN_SESSIONS = 5


# --- agent health ---------------------------------------------------------------


def health_profile(sessions: DataFrame, messages: DataFrame, steps: DataFrame, cutoff: str | None = None) -> DataFrame:
    """One row per source; a rate without results stays null."""
    chosen = ST.recent(sessions, cutoff, "updated_at")
    per_message = messages.groupBy("sid").agg(F.count(F.lit(1)).alias("messages"))
    failed = F.lower(text.strip(F.coalesce("status", F.lit("")))).isin(*ST.FAIL_STATUS)
    per_step = steps.groupBy("sid").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("phase") == "result").alias("results"),
        F.count_if((F.col("phase") == "result") & failed).alias("errors"),
    )
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("?")).alias("source")
    by_session = (
        chosen.select("sid", source, "created_at", "updated_at")
        .join(per_message, "sid", "left")
        .select("sid", "source", "created_at", "updated_at", "messages")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
            F.min(F.nullif("created_at", F.lit(""))).alias("first_active"),
            F.max(F.nullif("updated_at", F.lit(""))).alias("last_active"),
        )
    )
    how = "left" if cutoff is None else "inner"
    by_step = (
        ST.with_source(per_step, chosen) if cutoff is None else per_step.join(chosen.select("sid", source), "sid", how)
    ).groupBy("source").agg(
        F.sum("steps").alias("steps"),
        F.sum("results").alias("results"),
        F.sum("errors").alias("errors"),
        F.count(F.lit(1)).alias("stepped"),
    )
    joined = by_session.join(by_step, "source", "full_outer")
    zero = F.lit(0).cast("long")
    filled = joined.select(
        "source",
        *[F.coalesce(c, zero).alias(c) for c in ("sessions", "messages", "steps", "results", "errors", "stepped")],
        "first_active",
        "last_active",
    )
    return filled.select(
        "source",
        "sessions",
        "messages",
        "steps",
        "results",
        "errors",
        F.when(F.col("results") > 0, F.round(F.col("errors") / F.col("results"), 4)).alias("fail_rate"),
        (F.col("steps") > 0).alias("telemetry"),
        (F.col("results") > 0).alias("paired"),
        F.when(F.col("stepped") > 0, F.round(F.col("steps") / F.col("stepped"), 1)).otherwise(F.lit(0.0)).alias("avg_steps"),
        "first_active",
        "last_active",
    )


def health_totals(profile: DataFrame) -> DataFrame:
    sums = profile.agg(
        F.count(F.lit(1)).alias("sources"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "messages", "steps", "results", "errors")],
    )
    return sums.withColumn(
        "fail_rate", F.when(F.col("results") > 0, F.round(F.col("errors") / F.col("results"), 4))
    )


def health_top(sessions: DataFrame, steps: DataFrame, invocations: DataFrame, k: int = 5, models_k: int = 3) -> DataFrame:
    """Top tools, skills and models per source as ranked rows."""
    per_session = steps.groupBy("sid", "tool").agg(F.count(F.lit(1)).alias("n"))
    tools = (
        ST.with_source(per_session, sessions)
        .groupBy("source", F.col("tool").alias("name"))
        .agg(F.sum("n").alias("n"))
        .withColumn("kind", F.lit("tool"))
    )
    skills = (
        invocations.groupBy("source", F.col("skill").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("kind", F.lit("skill"))
    )
    models = (
        sessions.filter(F.coalesce("model", F.lit("")) != "")
        .groupBy(F.coalesce("source", F.lit("?")).alias("source"), F.col("model").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("kind", F.lit("model"))
    )
    ranked = ST.top_per_group(
        tools.unionByName(skills).unionByName(models), ["source", "kind"], [F.desc("n"), F.col("name")], k
    )
    return ranked.filter((F.col("kind") != "model") | (F.col("rank") <= models_k))


# --- spans -----------------------------------------------------------------------


def span_tool_stats(spans: DataFrame) -> DataFrame:
    """Function spans per tool: counts, rates, floor-indexed p50/p95 of durations."""
    calls = spans.filter((F.col("type") == "function") & (F.coalesce("toolName", F.lit("")) != ""))
    counts = calls.groupBy(F.col("toolName").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(F.col("status") == "running").alias("running"),
    )
    timed = calls.filter(F.col("duration") >= 0).select(
        F.col("toolName").alias("tool"), F.floor("duration").cast("long").alias("ms")
    )
    hist = timed.groupBy("tool", "ms").agg(F.count(F.lit(1)).alias("n"))
    marks = floor_quantile(hist, ["tool"], "ms", {"p50": 0.50, "p95": 0.95})
    zero = F.lit(0).cast("long")
    return counts.join(marks, "tool", "left").select(
        "tool",
        "calls",
        "errors",
        "cancelled",
        "running",
        F.round(F.col("errors") / F.col("calls"), 4).alias("fail_rate"),
        F.round(F.col("cancelled") / F.col("calls"), 4).alias("cancel_rate"),
        F.coalesce("p50", zero).alias("p50"),
        F.coalesce("p95", zero).alias("p95"),
    )


def generation_stats(spans: DataFrame) -> DataFrame:
    gens = spans.filter(F.col("type") == "generation")
    ms = F.when(F.col("duration") >= 0, F.floor("duration").cast("long"))
    totals = gens.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum(ms), F.lit(0)).alias("total_ms"),
    )
    hist = gens.select(ms.alias("ms")).filter(F.col("ms").isNotNull()).groupBy("ms").agg(F.count(F.lit(1)).alias("n"))
    marks = floor_quantile(hist, [], "ms", {"p50": 0.50, "p95": 0.95})
    return totals.join(marks, how="left")


def agent_histogram(spans: DataFrame) -> DataFrame:
    named = spans.filter(F.coalesce("agentName", F.lit("")) != "")
    return named.groupBy(F.col("agentName").alias("agent")).agg(F.count(F.lit(1)).alias("spans"))


# --- facets and lists -----------------------------------------------------------------


def facets(sessions: DataFrame, invocations: DataFrame) -> DataFrame:
    """Counts per source, model and skill as (facet, value, n)."""
    by_source = sessions.groupBy(F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("value")
    by_model = sessions.groupBy(model).agg(F.count(F.lit(1)).alias("n"))
    by_skill = (
        invocations.filter(F.col("skill") != "").groupBy(F.col("skill").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    parts = [("source", by_source), ("model", by_model), ("skill", by_skill)]
    out = None
    for name, part in parts:
        rows = part.select(F.lit(name).alias("facet"), "value", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def facet_bounds(sessions: DataFrame) -> DataFrame:
    stamp = F.nullif("updated_at", F.lit(""))
    return sessions.agg(F.min(stamp).alias("first_updated"), F.max(stamp).alias("last_updated"))


def filter_sessions(
    sessions: DataFrame,
    steps: DataFrame,
    *,
    source: str | None = None,
    model: str | None = None,
    since: str | None = None,
    until: str | None = None,
    hits: DataFrame | None = None,
    skill_sids: DataFrame | None = None,
    errors_only: bool = False,
) -> DataFrame:
    """Sessions passing the filters, with their error count; model ``unknown`` means none recorded."""
    out = sessions
    if source:
        out = out.filter(F.col("source") == source)
    if model == "unknown":
        out = out.filter(F.coalesce("model", F.lit("")) == "")
    elif model:
        out = out.filter(F.col("model") == model)
    if since:
        out = out.filter(F.col("updated_at") >= since)
    if until:
        out = out.filter(F.col("updated_at") <= until)
    for side in (hits, skill_sids):
        if side is not None:
            out = out.join(side.select("sid").distinct(), "sid", "left_semi")
    errors = steps.filter(F.col("status") == "error").groupBy("sid").agg(F.count(F.lit(1)).alias("error_count"))
    out = out.join(errors, "sid", "inner" if errors_only else "left")
    return out.withColumn("error_count", F.coalesce("error_count", F.lit(0)))


def page(df: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """One page in order, each row carrying the total number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def hot_sessions(sessions: DataFrame, messages: DataFrame, steps: DataFrame, n: int = 10, cutoff: str | None = None) -> DataFrame:
    """Top sessions by messages + 3 * steps, ties by sid."""
    msg = messages.groupBy("sid").agg(F.count(F.lit(1)).alias("msgs"), F.count_if(F.col("role") == "note").alias("notes"))
    stp = steps.groupBy("sid").agg(F.count(F.lit(1)).alias("steps"))
    joined = ST.recent(sessions, cutoff, "updated_at").join(msg, "sid", "left").join(stp, "sid", "left")
    zero = F.lit(0).cast("long")
    counted = joined.select(
        "sid", "source", "title", *[F.coalesce(c, zero).alias(c) for c in ("msgs", "notes", "steps")]
    )
    return counted.withColumn("score", F.col("msgs") + 3 * F.col("steps")).orderBy(F.desc("score"), "sid").limit(n)


def resolve_ids(keys: DataFrame, sessions: DataFrame, key: str = "key") -> DataFrame:
    """Match keys to sid, else to the bare session id (smallest sid); unmatched keys give a null sid."""
    exact = sessions.select(F.col("sid").alias(key), F.col("sid").alias("by_sid"))
    bare = sessions.groupBy(F.col("session_id").alias(key)).agg(F.min("sid").alias("by_id"))
    joined = keys.select(key).distinct().join(exact, key, "left").join(bare, key, "left")
    return joined.select(key, F.coalesce("by_sid", "by_id").alias("sid"))


def topic_turns(members: DataFrame, sessions: DataFrame, messages: DataFrame, cap: int = 200, full: bool = False) -> DataFrame:
    """User turns of topic members with a flattened preview (or whole text); missing members kept."""
    resolved = resolve_ids(members.select(F.col("sid").alias("key")), sessions)
    wanted = members.select("topic_id", F.col("sid").alias("key")).join(resolved, "key")
    turns = SQ.numbered_user_turns(messages.select("sid", "seq", "role", "raw"))
    body = F.regexp_replace(F.coalesce("raw", F.lit("")), "\r", "")
    shown = body if full else text.head(text.fold(body), cap)
    return wanted.join(turns.select("sid", "turn", shown.alias("text")), "sid", "left").select(
        "topic_id", F.coalesce("sid", "key").alias("sid"), F.col("sid").isNull().alias("missing"), "turn", "text"
    )


# --- growth ---------------------------------------------------------------------------


def growth(
    sessions: DataFrame,
    steps: DataFrame,
    topic_members: DataFrame,
    cards: DataFrame,
    ledger: DataFrame,
    months: int = 12,
) -> DataFrame:
    """Monthly series; every measure is grouped by month first and the parts are added up."""
    months = months if months > 0 else 12
    dated = sessions.select("sid", text.month_key("created_at").alias("month")).filter(F.col("month").isNotNull())
    failed = text.strip(F.coalesce("error", F.lit(""))) != ""
    per_session = steps.groupBy("sid").agg(F.count(F.lit(1)).alias("steps"), F.count_if(failed).alias("errors"))
    worked = dated.join(per_session, "sid").groupBy("month").agg(F.sum("steps").alias("steps"), F.sum("errors").alias("errors"))
    topics = (
        topic_members.select("topic_id", "sid").join(dated, "sid").select("topic_id", "month").distinct()
        .groupBy("month").agg(F.count(F.lit(1)).alias("active_topics"))
    )
    opened = dated.groupBy("month").agg(F.count(F.lit(1)).alias("sessions"))
    made = cards.select(text.month_key("created").alias("month")).filter(F.col("month").isNotNull())
    adopted = ledger.select(text.month_key("adopted_at").alias("month")).filter(F.col("month").isNotNull())
    parts = [
        opened,
        worked,
        topics,
        made.groupBy("month").agg(F.count(F.lit(1)).alias("new_cards")),
        adopted.groupBy("month").agg(F.count(F.lit(1)).alias("rules_adopted")),
    ]
    measures = ("sessions", "steps", "errors", "active_topics", "new_cards", "rules_adopted")
    rows = None
    for part in parts:
        wide = part.select("month", *[(F.col(m) if m in part.columns else F.lit(0)).cast("long").alias(m) for m in measures])
        rows = wide if rows is None else rows.unionByName(wide)
    summed = rows.groupBy("month").agg(*[F.sum(m).alias(m) for m in measures])
    latest = summed.orderBy(F.desc("month")).limit(months)
    ratio = F.when(F.col("sessions") > 0, F.round(F.col("errors") / F.col("sessions"), 3))
    return latest.select("month", *measures, ratio.alias("err_per_session"), (F.col("sessions") < THIN_SESSIONS).alias("thin"))


# --- keywords -----------------------------------------------------------------------------


def text_scope(
    messages: DataFrame,
    role: str = "user",
    scope: DataFrame | None = None,
    noise: DataFrame | None = None,
) -> DataFrame:
    """Messages for text statistics: one role or all, inside a scope, without noise sessions."""
    out = messages.filter(F.col("raw").isNotNull())
    if role != "all":
        out = out.filter(F.col("role") == role)
    if scope is not None:
        out = out.join(scope.select("sid").distinct(), "sid", "left_semi")
    if noise is not None:
        out = out.join(noise.select("sid").distinct(), "sid", "left_anti")
    return out


def keyword_stats(messages: DataFrame, ns: Sequence[int] = (2, 3), stopwords: Iterable[str] = ()) -> DataFrame:
    """freq and doc_freq (messages holding the gram) per n.

    A message's grams are sorted, so that the first of equal ones counts for
    doc_freq: one row per gram, and one pre-aggregated shuffle for both.
    """
    stop = sorted(set(stopwords))
    sizes = sorted({int(x) for x in ns})
    grams = messages.select(*[F.sort_array(text.extract_grams("raw", n)).alias(f"__g{n}") for n in sizes])

    def tagged(n: int) -> Column:
        held = F.col(f"__g{n}")
        first = lambda g, i: F.when((i == 0) | (F.get(held, i - 1) != g), 1).otherwise(0)
        return F.transform(held, lambda g, i: F.struct(F.lit(n).alias("n"), g.alias("gram"), first(g, i).alias("d")))

    rows = grams.select(F.explode(F.concat(*map(tagged, sizes))).alias("r")).select("r.*")
    if stop:
        rows = rows.filter(~F.col("gram").isin(stop))
    return rows.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("freq"), F.sum("d").alias("doc_freq"))


def keyword_order() -> list:
    return [F.desc("doc_freq"), F.desc("freq"), F.col("gram")]


def excluded_messages(messages: DataFrame, noise: DataFrame, role: str = "user") -> DataFrame:
    rows = text_scope(messages, role).join(noise.select("sid").distinct(), "sid", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("excluded"))


# --- topics overview ------------------------------------------------------------------------


def topic_overview(topics: DataFrame, members: DataFrame, sessions: DataFrame, chains: DataFrame) -> DataFrame:
    """members_count, first and last activity and chain count per topic."""
    activity = (
        members.join(sessions.select("sid", "created_at", "updated_at"), "sid", "left")
        .groupBy("topic_id")
        .agg(
            F.count(F.lit(1)).alias("members_count"),
            F.min(F.nullif("created_at", F.lit(""))).alias("first_activity"),
            F.max(F.nullif("updated_at", F.lit(""))).alias("last_activity"),
        )
    )
    chained = chains.select("topic_id", "chain_id").distinct().groupBy("topic_id").agg(F.count(F.lit(1)).alias("chain_count"))
    zero = F.lit(0).cast("long")
    return (
        topics.select("topic_id", "name")
        .join(activity, "topic_id", "left")
        .join(chained, "topic_id", "left")
        .withColumn("members_count", F.coalesce("members_count", zero))
        .withColumn("chain_count", F.coalesce("chain_count", zero))
    )


def title_chain(members: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each title of a topic once, with the member that used it first."""
    joined = members.select("topic_id", "sid").join(sessions.select("sid", "title", "created_at"), "sid")
    titled = joined.filter(F.coalesce("title", F.lit("")) != "")
    first = F.min(F.struct(F.coalesce("created_at", F.lit("")).alias("created_at"), F.col("sid").alias("sid")))
    return titled.groupBy("topic_id", "title").agg(first.alias("f")).select(
        "topic_id", "title", F.col("f.created_at").alias("first_seen"), F.col("f.sid").alias("sid")
    )


def topic_months(members: DataFrame, sessions: DataFrame) -> DataFrame:
    joined = members.select("topic_id", "sid").join(sessions.select("sid", "created_at"), "sid")
    month = text.head("created_at", 7)
    dated = joined.filter(F.coalesce("created_at", F.lit("")) != "")
    return dated.groupBy("topic_id", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


def missing_members(members: DataFrame, sessions: DataFrame) -> DataFrame:
    return members.select("topic_id", "sid").join(sessions.select("sid"), "sid", "left_anti").select("topic_id", "sid")


def daily_counters(ledger: DataFrame, errors: DataFrame, evaluations: DataFrame, cutoff: str) -> DataFrame:
    """pending entries, unresolved patterns, new patterns and undecided evaluations in one row."""
    pending = ledger.agg(F.count_if(F.col("status") == "pending").alias("pending"))
    per_pattern = errors.groupBy("pattern").agg(
        F.count_if(~F.col("resolved")).alias("given_up"), F.min(F.coalesce("ts", F.lit(""))).alias("first_seen")
    )
    patterns = per_pattern.agg(
        F.count_if(F.col("given_up") > 0).alias("unresolved"),
        F.count_if(F.col("first_seen") >= cutoff).alias("new_patterns"),
    )
    undecided = evaluations.agg(F.count_if(F.col("verdict") == "inconclusive").alias("inconclusive"))
    return pending.join(patterns).join(undecided)
