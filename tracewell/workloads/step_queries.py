"""Queries over tool steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas, store
from tracewell.operators import steps as O
from tracewell.functions import text
from tracewell.workloads.base import ERRORS, MONTH_CUTOFF, SESSIONS, STEPS, TOOLS, query


def _errors(spark, d, cutoff=None):
    return O.collect_errors(store.steps(spark, d), schemas.sessions_from_events(spark, d), cutoff)


@query(
    "E10_pattern_stats",
    f"""WITH {ERRORS}
SELECT pattern, min(class) AS class, count(*) AS n_errors, count(DISTINCT sid) AS n_sessions,
  string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(*) FILTER (WHERE NOT resolved) AS given_up, min(ts) AS first_seen
FROM errs GROUP BY pattern""",
)
def pattern_stats(spark, d):
    errors = _errors(spark, d)
    seen = errors.groupBy("pattern", "sid").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_sessions")
    )
    return (
        O.pattern_stats(errors)
        .join(seen, "pattern")
        .select(
            "pattern",
            "class",
            F.col("count").alias("n_errors"),
            "n_sessions",
            F.array_join("tools", ",").alias("tools"),
            "given_up",
            "first_seen",
        )
    )


@query(
    "E9_collect_errors",
    f"""WITH {ERRORS} SELECT sid, seq, ts, tool, error, source, model, class, pattern, bucket, resolved, skill FROM errs""",
)
def collect_errors(spark, d):
    return _errors(spark, d)


@query(
    "E9_error_meta",
    f"""WITH {ERRORS} SELECT (SELECT count(*) FROM steps) AS total_steps, count(*) AS error_count,
count(DISTINCT sid) AS sessions FROM errs""",
)
def error_meta(spark, d):
    return O.error_meta(store.steps(spark, d), _errors(spark, d))


@query(
    "E10_pattern_samples",
    f"""WITH {ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY sid, seq) AS rn FROM errs)
SELECT pattern, CAST(rn AS INTEGER) AS rank, sid, seq, error FROM r WHERE rn<=3""",
)
def pattern_samples(spark, d):
    return O.pattern_samples(_errors(spark, d))


@query(
    "C1_recent_errors",
    f"""WITH {ERRORS} SELECT sid, seq, ts, tool, error FROM errs WHERE ts >= '{MONTH_CUTOFF}'""",
)
def recent_errors(spark, d):
    steps = O.recent(store.steps(spark, d), MONTH_CUTOFF)
    return steps.filter(F.col("status") == "error").select("sid", "seq", "ts", "tool", "error")


@query(
    "E1_tool_counts",
    f"""WITH {STEPS}, {TOOLS} SELECT * FROM tools""",
)
def tool_counts(spark, d):
    return O.tool_counts(store.steps(spark, d))


@query(
    "E1_error_details",
    f"""WITH {STEPS} SELECT tool, trim(coalesce(error, status, 'unknown')) AS detail, count(*) AS n FROM steps
WHERE phase<>'call' AND coalesce(status,'unknown') NOT IN ('success','completed','ok') GROUP BY ALL""",
)
def error_details(spark, d):
    return O.error_details(store.steps(spark, d))


@query(
    "E2_retry_flow",
    f"""WITH {STEPS}, {TOOLS} SELECT tool, count(*) FILTER (WHERE is_err) AS errors, count(*) FILTER (WHERE is_retry) AS retried,
count(*) FILTER (WHERE is_err) - count(*) FILTER (WHERE is_retry) AS given_up FROM flow GROUP BY tool""",
)
def retry_flow(spark, d):
    return O.retry_flow(store.steps(spark, d))


_ALIAS_SQL = """keyed AS (SELECT t.tool, calls, success, error, coalesce(retried,0) AS retried,
  replace(lower(t.tool),'_','') AS key FROM {tools} t LEFT JOIN retried USING (tool)),
merged AS (SELECT first(tool ORDER BY calls DESC, tool) AS tool, CAST(sum(calls) AS BIGINT) AS calls,
  CAST(sum(success) AS BIGINT) AS success, CAST(sum(error) AS BIGINT) AS error, CAST(sum(retried) AS BIGINT) AS retried,
  string_agg(tool, ',' ORDER BY tool) AS raw_tools FROM keyed GROUP BY key)"""


@query(
    "E3_alias_merge",
    f"""WITH {STEPS.replace("ELSE concat('tool_', k % 5) END AS tool", "WHEN k % 7 = 0 THEN concat('Tool', k % 5) ELSE concat('tool_', k % 5) END AS tool")}, {TOOLS}, {_ALIAS_SQL.format(tools="tools")}
SELECT tool, calls, success, error, retried, error - retried AS given_up, raw_tools FROM merged""",
)
def alias_merge(spark, d):
    spelled = store.stored(spark, d, "spelled_steps", _spelled_steps)
    return O.merge_aliases(O.tool_stats(spelled)).withColumn("raw_tools", F.array_join("raw_tools", ","))


def _spelled_steps(spark, d):
    """Steps where part of the calls use another spelling of the tool name."""
    from tracewell.plans.scan import Running, position_scan

    events = schemas.read_table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = events.select("event_id", "user_id", "ts", "event_type", "k")
    position = F.unix_micros(F.col("ts").cast("timestamp"))
    numbered = position_scan(rows, ["user_id"], ["ts", "event_id"], position, {"nth": Running("sum", F.lit(1))})
    tool = (
        F.when(F.col("k") % 5 == 0, F.lit("Skill"))
        .when(F.col("k") % 7 == 0, F.concat(F.lit("Tool"), F.col("k") % 5))
        .otherwise(F.concat(F.lit("tool_"), F.col("k") % 5))
    )
    return numbered.select(
        F.concat(F.lit("u:"), F.col("user_id")).alias("sid"),
        (F.col("nth") - 1).cast("int").alias("seq"),
        tool.alias("tool"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "call").otherwise("result").alias("phase"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "completed").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


@query(
    "E4_tool_rows",
    f"""WITH {STEPS}, {TOOLS}, {_ALIAS_SQL.format(tools="tools")}
SELECT tool, calls, success, error, retried, error - retried AS given_up, raw_tools,
  CASE WHEN calls>0 THEN round(error/calls, 4) ELSE 0.0 END AS fail_rate, calls>=1200 AS ranked, calls<1210 AS low_sample
FROM merged""",
)
def tool_rows(spark, d):
    merged = O.merge_aliases(O.tool_stats(store.steps(spark, d)))
    return O.tool_rows(merged, min_calls=1210, rank_min=1200).withColumn("raw_tools", F.array_join("raw_tools", ","))


@query(
    "G3_ranked_then_small",
    f"""WITH {STEPS}, {TOOLS}, r AS (SELECT *, calls>=1220 AS ranked, error/calls AS rate FROM tools)
SELECT tool, ranked, CAST(row_number() OVER (ORDER BY ranked DESC, CASE WHEN ranked THEN error ELSE calls END DESC,
  CASE WHEN ranked THEN rate ELSE 0 END DESC, tool) AS INTEGER) AS place FROM r""",
)
def ranked_then_small(spark, d):
    rows = O.tool_rows(O.tool_counts(store.steps(spark, d)), rank_min=1220)
    # one row per tool name: a small table
    from pyspark.sql import Window

    order = Window.orderBy(
        F.desc("ranked"),
        F.when(F.col("ranked"), F.col("error")).otherwise(F.col("calls")).desc(),
        F.when(F.col("ranked"), F.col("error") / F.col("calls")).otherwise(F.lit(0.0)).desc(),
        "tool",
    )
    return rows.select("tool", "ranked", F.row_number().over(order).alias("place"))


@query(
    "E5_error_roots",
    f"""WITH {ERRORS} SELECT tool, pattern, count(*) AS n_errors, min(trim(error)) AS sample, min(class) AS class
FROM (SELECT tool, error, class, pattern FROM errs UNION ALL
  SELECT tool, 'unknown', 'unclassified', 'unknown' FROM steps WHERE phase='result' AND status IS NULL) GROUP BY tool, pattern""",
)
def error_roots(spark, d):
    return O.error_roots(O.error_details(store.steps(spark, d))).withColumnRenamed("count", "n_errors")


@query(
    "E6_source_tool_stats",
    f"""WITH {STEPS}, {SESSIONS}, {TOOLS} SELECT source, m.tool, count(*) FILTER (WHERE is_call) AS calls,
count(*) FILTER (WHERE NOT is_call AND NOT is_err) AS success, count(*) FILTER (WHERE is_err) AS error, m.tool AS raw_tools
FROM marked m JOIN sessions USING (sid) GROUP BY source, m.tool""",
)
def source_tool_stats(spark, d):
    out = O.source_tool_stats(store.steps(spark, d), schemas.sessions_from_events(spark, d))
    return out.withColumn("raw_tools", F.array_join("raw_tools", ","))


@query(
    "E7_model_tool_stats",
    f"""WITH {STEPS}, {SESSIONS}, {TOOLS} SELECT model, count(*) FILTER (WHERE is_call) AS calls,
count(*) FILTER (WHERE NOT is_call AND NOT is_err) AS success, count(*) FILTER (WHERE is_err) AS error
FROM marked m JOIN sessions USING (sid) WHERE model IS NOT NULL GROUP BY model""",
)
def model_tool_stats(spark, d):
    return O.model_tool_stats(store.steps(spark, d), schemas.sessions_from_events(spark, d))


@query(
    "E8_note_tool_stats",
    f"""WITH {STEPS}, {TOOLS} SELECT tool, count(*) FILTER (WHERE phase='call') AS calls,
count(*) FILTER (WHERE phase='result' AND status='completed') AS success,
count(*) FILTER (WHERE phase='result' AND coalesce(status,'unknown')<>'completed') AS error FROM steps GROUP BY tool""",
)
def note_tool_stats(spark, d):
    steps = store.steps(spark, d)
    line = F.when(F.col("phase") == "call", F.concat(F.lit("[tool_call] "), F.col("tool"), F.lit(": {}"))).otherwise(
        F.concat(
            F.lit("[tool_result] "), F.col("tool"), F.lit(": "), F.coalesce("status", F.lit("unknown")),
            F.lit(" "), F.coalesce("error", F.lit("")),
        )
    )
    return O.note_tool_stats(steps.select("sid", "seq", F.lit("note").alias("role"), line.alias("raw")))


_CROSS = ", ".join(
    f"count(*) FILTER (WHERE class='{c}') AS {c}" for c in ("env", "tool_interface", "context", "unclassified")
)


@query("E11_cross_source_model", f"WITH {ERRORS} SELECT source, model, {_CROSS}, count(*) AS total FROM errs GROUP BY ALL")
def cross_source_model(spark, d):
    return O.cross_source_model(_errors(spark, d))


@query(
    "E12_cross_skill_source",
    f"WITH {ERRORS} SELECT coalesce(skill,'(no skill)') AS skill, source, {_CROSS}, count(*) AS total FROM errs GROUP BY 1, 2",
)
def cross_skill_source(spark, d):
    return O.cross_skill_source(_errors(spark, d))


@query(
    "E20_pattern_occurrences",
    f"""WITH {ERRORS} SELECT pattern, count(*) OVER (PARTITION BY pattern) AS n_errors, e.sid, seq, ts, tool
FROM errs e JOIN sessions s ON s.sid=e.sid WHERE s.updated_at >= '{MONTH_CUTOFF}'""",
)
def pattern_occurrences(spark, d):
    sessions = schemas.sessions_from_events(spark, d)
    return O.pattern_occurrences(_errors(spark, d), sessions, MONTH_CUTOFF).withColumnRenamed("count", "n_errors")


@query(
    "D1_steps_with_source",
    f"""WITH {STEPS}, {SESSIONS} SELECT s.sid, s.seq, s.tool, coalesce(e.source,'?') AS source, e.model
FROM steps s LEFT JOIN sessions e ON e.sid=s.sid""",
)
def steps_with_source(spark, d):
    rows = store.steps(spark, d).select("sid", "seq", "tool")
    return O.with_source(rows, schemas.sessions_from_events(spark, d))


@query(
    "D4_active_skill",
    f"""WITH {ERRORS} SELECT sid, seq, skill FROM errs""",
)
def active_skill(spark, d):
    return O.active_skill(store.steps(spark, d), F.coalesce(F.col("status") == "error", F.lit(False)))


@query(
    "D7_resolved",
    f"""WITH {ERRORS} SELECT tool, resolved, count(*) AS n_errors FROM errs GROUP BY ALL""",
)
def resolved(spark, d):
    steps = store.steps(spark, d)
    errors = steps.filter(F.col("status") == "error").select("sid", "seq", "tool")
    joined = errors.join(O.max_call_seq(steps), ["sid", "tool"], "left")
    return joined.groupBy("tool", F.coalesce(F.col("last_call") > F.col("seq"), F.lit(False)).alias("resolved")).agg(
        F.count(F.lit(1)).alias("n_errors")
    )


@query(
    "G2_top_tools_per_source",
    f"""WITH {STEPS}, {SESSIONS}, c AS (SELECT source, tool, count(*) AS n FROM steps JOIN sessions USING (sid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, tool) AS rn FROM c)
SELECT source, tool, n, CAST(rn AS INTEGER) AS rank FROM r WHERE rn<=3""",
)
def top_tools(spark, d):
    per_session = store.steps(spark, d).groupBy("sid", "tool").agg(F.count(F.lit(1)).alias("n"))
    counts = (
        per_session.join(schemas.sessions_from_events(spark, d).select("sid", "source"), "sid")
        .groupBy("source", "tool")
        .agg(F.sum("n").alias("n"))
    )
    return O.top_per_group(counts, ["source"], [F.desc("n"), F.col("tool")], 3)


@query(
    "I1_normalize_error",
    f"""WITH {ERRORS} SELECT sid, seq, pattern FROM errs""",
)
def normalize_error(spark, d):
    rows = store.steps(spark, d).filter(F.col("error").isNotNull())
    return rows.select("sid", "seq", text.normalize_error("error").alias("pattern"))


@query(
    "I2_clean_sample",
    f"""WITH {ERRORS} SELECT sid, seq, left(trim(regexp_replace(split_part(concat(error, ' Input: ', tool), 'Input:', 1), '\\s+', ' ', 'g')), 30) AS sample FROM errs""",
)
def clean_sample(spark, d):
    rows = store.steps(spark, d).filter(F.col("error").isNotNull())
    echoed = F.concat(F.col("error"), F.lit(" Input: "), F.col("tool"))
    return rows.select("sid", "seq", text.clean_error_sample(echoed, 30).alias("sample"))
