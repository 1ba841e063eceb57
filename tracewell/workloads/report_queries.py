"""Queries over whole-store reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas, store
from tracewell.operators import reports as R
from tracewell.operators import sequence as Q
from tracewell.operators import steps as O
from tracewell.workloads import derived as D
from tracewell.workloads.base import CONV_SESSIONS, ERRORS, MESSAGES, MONTH_CUTOFF, SESSIONS, STEPS, query
from tracewell.workloads.sequence_queries import INVOCATIONS

_ALL = f"{STEPS}, {SESSIONS}, {MESSAGES}, {CONV_SESSIONS}, {D.ALL_SESSIONS}"

_HEALTH = f"""{_ALL},
ss AS (SELECT sid, count(*) AS steps, count(*) FILTER (WHERE phase='result') AS results,
  count(*) FILTER (WHERE phase='result' AND lower(trim(coalesce(status,''))) IN ('error','failed','fail','failure','exception')) AS errors
  FROM steps GROUP BY sid),
mm AS (SELECT sid, count(*) AS messages FROM messages GROUP BY sid),
h AS (SELECT source, count(*) AS sessions, CAST(coalesce(sum(messages),0) AS BIGINT) AS messages, CAST(coalesce(sum(steps),0) AS BIGINT) AS steps,
  CAST(coalesce(sum(results),0) AS BIGINT) AS results, CAST(coalesce(sum(errors),0) AS BIGINT) AS errors, count(steps) AS stepped,
  min(created_at) AS first_active, max(updated_at) AS last_active
  FROM allsess LEFT JOIN ss USING (sid) LEFT JOIN mm USING (sid) GROUP BY source)"""


def _messages(spark, d):
    return schemas.messages_from_conversations(spark, d)


def _health(spark, d):
    return R.health_profile(D.all_sessions(spark, d), _messages(spark, d), store.steps(spark, d))


@query(
    "E13_health_profile",
    f"""WITH {_HEALTH} SELECT source, sessions, messages, steps, results, errors,
CASE WHEN results>0 THEN round(errors/results, 4) END AS fail_rate, steps>0 AS telemetry, results>0 AS paired,
CASE WHEN stepped>0 THEN round(steps/stepped, 1) ELSE 0.0::DOUBLE END AS avg_steps, first_active, last_active FROM h""",
)
def health_profile(spark, d):
    return _health(spark, d)


@query(
    "E13_health_totals",
    f"""WITH {_HEALTH} SELECT count(*) AS sources, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(messages) AS BIGINT) AS messages,
CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(results) AS BIGINT) AS results, CAST(sum(errors) AS BIGINT) AS errors,
round(sum(errors)/sum(results), 4) AS fail_rate FROM h""",
)
def health_totals(spark, d):
    return R.health_totals(_health(spark, d))


@query(
    "E13_health_top",
    f"""WITH {INVOCATIONS},
c AS (SELECT source, 'tool' AS kind, tool AS name, count(*) AS n FROM steps JOIN sessions USING (sid) GROUP BY ALL
  UNION ALL SELECT source, 'skill', skill, count(*) FROM invs GROUP BY ALL
  UNION ALL SELECT source, 'model', model, count(*) FROM sessions WHERE model IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY n DESC, name) AS rn FROM c)
SELECT source, kind, name, n, CAST(rn AS INTEGER) AS rank FROM r WHERE rn<=CASE kind WHEN 'model' THEN 3 ELSE 5 END""",
)
def health_top(spark, d):
    sessions, steps = schemas.sessions_from_events(spark, d), store.steps(spark, d)
    return R.health_top(sessions, steps, Q.skill_invocations(steps, sessions))


_SPANS = """spans AS (SELECT CASE WHEN event_type='purchase' THEN 'generation' ELSE 'function' END AS type,
  CASE WHEN event_type='error' THEN 'error' WHEN event_type='signup' THEN 'cancelled' WHEN event_type='view' AND value>15 THEN 'running' ELSE 'ok' END AS status,
  CASE WHEN value<1 THEN NULL ELSE CAST(floor(value*10) AS BIGINT) END AS duration, concat('tool_', CAST(json_extract_string(props,'$.k') AS INTEGER) % 5) AS tool,
  CASE WHEN user_id % 2 = 0 THEN concat('agent', user_id % 8) END AS agent FROM events)"""


def spans(spark, d):
    """Trace spans told by the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return schemas.read_table(spark, d, "events").select(
        F.when(kind == "purchase", "generation").otherwise("function").alias("type"),
        F.when(kind == "error", "error")
        .when(kind == "signup", "cancelled")
        .when((kind == "view") & (F.col("value") > 15), "running")
        .otherwise("ok")
        .alias("status"),
        F.when(F.col("value") >= 1, F.floor(F.col("value") * 10).cast("long")).alias("duration"),
        F.concat(F.lit("tool_"), k % 5).alias("toolName"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("agent"), F.col("user_id") % 8)).alias("agentName"),
    )


_FLOOR = "a[CAST(floor({q}*(len(a)-1)) AS INTEGER)+1]"


@query(
    "E15_span_tool_stats",
    f"""WITH {_SPANS}, f AS (SELECT *, list(duration ORDER BY duration) FILTER (WHERE duration IS NOT NULL) OVER () AS x FROM spans LIMIT 0),
g AS (SELECT tool, count(*) AS calls, count(*) FILTER (WHERE status='error') AS errors, count(*) FILTER (WHERE status='cancelled') AS cancelled,
 count(*) FILTER (WHERE status='running') AS running, list(duration ORDER BY duration) FILTER (WHERE duration IS NOT NULL) AS a
 FROM spans WHERE type='function' GROUP BY tool)
SELECT tool, calls, errors, cancelled, running, round(errors/calls,4) AS fail_rate, round(cancelled/calls,4) AS cancel_rate,
{_FLOOR.format(q=0.5)} AS p50, {_FLOOR.format(q=0.95)} AS p95 FROM g""".replace(
        "f AS (SELECT *, list(duration ORDER BY duration) FILTER (WHERE duration IS NOT NULL) OVER () AS x FROM spans LIMIT 0),\n", ""
    ),
)
def span_tool_stats(spark, d):
    return R.span_tool_stats(spans(spark, d))


@query(
    "E16_generation_stats",
    f"""WITH {_SPANS}, g AS (SELECT count(*) AS calls, count(*) FILTER (WHERE status='error') AS errors, CAST(sum(duration) AS BIGINT) AS total_ms,
 list(duration ORDER BY duration) FILTER (WHERE duration IS NOT NULL) AS a FROM spans WHERE type='generation')
SELECT calls, errors, total_ms, {_FLOOR.format(q=0.5)} AS p50, {_FLOOR.format(q=0.95)} AS p95 FROM g""",
)
def generation_stats(spark, d):
    return R.generation_stats(spans(spark, d))


@query("E16_agent_histogram", f"WITH {_SPANS} SELECT agent, count(*) AS spans FROM spans WHERE agent IS NOT NULL GROUP BY agent")
def agent_histogram(spark, d):
    return R.agent_histogram(spans(spark, d))


@query(
    "E17_facets",
    f"""WITH {INVOCATIONS} SELECT 'source' AS facet, source AS value, count(*) AS n FROM sessions GROUP BY ALL
UNION ALL SELECT 'model', coalesce(model,'unknown'), count(*) FROM sessions GROUP BY ALL
UNION ALL SELECT 'skill', skill, count(*) FROM invs GROUP BY ALL""",
)
def facets(spark, d):
    sessions = schemas.sessions_from_events(spark, d)
    return R.facets(sessions, Q.skill_invocations(store.steps(spark, d), sessions))


@query("E17_facet_bounds", f"WITH {SESSIONS} SELECT min(updated_at) AS first_updated, max(updated_at) AS last_updated FROM sessions")
def facet_bounds(spark, d):
    return R.facet_bounds(schemas.sessions_from_events(spark, d))


@query(
    "C2_filter_sessions",
    f"""WITH {STEPS}, {SESSIONS}, e AS (SELECT sid, count(*) AS error_count FROM steps WHERE status='error' GROUP BY sid)
SELECT s.sid, s.source, s.updated_at, e.error_count FROM sessions s JOIN e USING (sid)
WHERE model IS NULL AND updated_at>='{MONTH_CUTOFF}' AND s.sid IN (SELECT sid FROM steps WHERE tool='Skill' AND phase='call' AND detail LIKE '%sk1%')""",
)
def filter_sessions(spark, d):
    steps = store.steps(spark, d)
    skilled = steps.filter(O.is_skill_call() & (O.skill_name(F.col("tool"), F.col("detail")) == "sk1"))
    out = R.filter_sessions(
        schemas.sessions_from_events(spark, d), steps, model="unknown", since=MONTH_CUTOFF, skill_sids=skilled, errors_only=True
    )
    return out.select("sid", "source", "updated_at", "error_count")


@query(
    "G4_session_page",
    f"""WITH {SESSIONS}, n AS (SELECT count(*) AS total FROM sessions WHERE source='src1')
SELECT sid, updated_at, total FROM sessions, n WHERE source='src1' ORDER BY updated_at DESC, sid LIMIT 20 OFFSET 10""",
)
def session_page(spark, d):
    rows = schemas.sessions_from_events(spark, d).filter(F.col("source") == "src1").select("sid", "updated_at")
    return R.page(rows, [F.desc("updated_at"), F.col("sid")], 10, 20)


_HOT = f"""WITH {_ALL},
m AS (SELECT sid, count(*) AS msgs, count(*) FILTER (WHERE role='note') AS notes FROM messages GROUP BY sid),
s AS (SELECT sid, count(*) AS steps FROM steps GROUP BY sid),
c AS (SELECT sid, source, title, coalesce(msgs,0) AS msgs, coalesce(notes,0) AS notes, coalesce(steps,0) AS steps
  FROM allsess LEFT JOIN m USING (sid) LEFT JOIN s USING (sid))
SELECT *, msgs+3*steps AS score FROM c ORDER BY score DESC, sid"""


@query("G1_hot_sessions", _HOT + " LIMIT 10")
def hot_sessions(spark, d):
    return R.hot_sessions(D.all_sessions(spark, d), _messages(spark, d), store.steps(spark, d))


@query(
    "D3_counts_per_session",
    _HOT.replace("ORDER BY score DESC, sid", "WHERE msgs+steps>0"),
)
def counts_per_session(spark, d):
    sessions = D.all_sessions(spark, d)
    messages = _messages(spark, d).groupBy("sid").agg(
        F.count(F.lit(1)).alias("msgs"), F.count_if(F.col("role") == "note").alias("notes")
    )
    steps = store.steps(spark, d).groupBy("sid").agg(F.count(F.lit(1)).alias("steps"))
    zero = F.lit(0).cast("long")
    joined = sessions.join(messages, "sid", "left").join(steps, "sid", "left")
    out = joined.select("sid", "source", "title", *[F.coalesce(c, zero).alias(c) for c in ("msgs", "notes", "steps")])
    return out.filter(F.col("msgs") + F.col("steps") > 0).withColumn("score", F.col("msgs") + 3 * F.col("steps"))


@query(
    "C6_resolve_ids",
    f"""WITH {MESSAGES}, {CONV_SESSIONS}, k AS (SELECT DISTINCT CASE WHEN lang='en' THEN concat('conv:', doc_id) WHEN lang='fr'
  THEN CAST(doc_id AS VARCHAR) ELSE concat('x:', doc_id) END AS key FROM documents)
SELECT key, coalesce((SELECT sid FROM csessions c WHERE c.sid=k.key), (SELECT min(sid) FROM csessions c WHERE c.session_id=k.key)) AS sid FROM k""",
)
def resolve_ids(spark, d):
    keys = schemas.read_table(spark, d, "documents").select(
        F.when(F.col("lang") == "en", F.concat(F.lit("conv:"), "doc_id"))
        .when(F.col("lang") == "fr", F.col("doc_id").cast("string"))
        .otherwise(F.concat(F.lit("x:"), "doc_id"))
        .alias("key")
    )
    return R.resolve_ids(keys, schemas.sessions_from_conversations(spark, d))


@query(
    "C7_topic_turns",
    f"""WITH {D.INTRO}, u AS (SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY seq) AS INTEGER) AS turn, raw FROM messages WHERE role='user')
SELECT m.topic_id, m.sid, false AS missing, turn, left(trim(regexp_replace(replace(raw, chr(13), ''), '\\s+', ' ', 'g')), 200) AS text
FROM tmembers m JOIN u USING (sid)""",
)
def topic_turns(spark, d):
    return R.topic_turns(D.topic_members(spark, d), schemas.sessions_from_conversations(spark, d), _messages(spark, d))


@query(
    "E18_growth",
    f"""WITH {STEPS}, {SESSIONS}, {MESSAGES}, {CONV_SESSIONS}, {D.ALL_SESSIONS}, {D.CARDS}, {D.LEDGER_LOG},
sm AS (SELECT sid, substr(created_at,1,7) AS month FROM sessions),
parts AS (
 SELECT month, count(*) AS sessions, 0 AS steps, 0 AS errors, 0 AS active_topics, 0 AS new_cards, 0 AS rules_adopted FROM sm GROUP BY month
 UNION ALL SELECT month, 0, count(*), count(*) FILTER (WHERE trim(coalesce(error,''))<>''), 0, 0, 0 FROM steps JOIN sm USING (sid) GROUP BY month
 UNION ALL SELECT month, 0, 0, 0, count(DISTINCT topic_id), 0, 0 FROM emembers JOIN sm USING (sid) GROUP BY month
 UNION ALL SELECT substr(created,1,7), 0, 0, 0, 0, count(*), 0 FROM cards GROUP BY 1
 UNION ALL SELECT substr(adopted_at,1,7), 0, 0, 0, 0, 0, count(*) FROM llog WHERE adopted_at IS NOT NULL GROUP BY 1),
g AS (SELECT month, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(errors) AS BIGINT) AS errors,
 CAST(sum(active_topics) AS BIGINT) AS active_topics, CAST(sum(new_cards) AS BIGINT) AS new_cards, CAST(sum(rules_adopted) AS BIGINT) AS rules_adopted
 FROM parts GROUP BY month)
SELECT *, CASE WHEN sessions>0 THEN round(errors/sessions, 3) END AS err_per_session, sessions<5 AS thin FROM g ORDER BY month DESC LIMIT 12""",
)
def growth(spark, d):
    return R.growth(
        schemas.sessions_from_events(spark, d),
        store.steps(spark, d),
        D.dated_members(spark, d),
        D.cards(spark, d),
        D.ledger_log(spark, d),
    )


_GRAMS = """g AS (SELECT sid, seq, n, gram FROM (SELECT m.sid, m.seq, n.n, unnest(regexp_extract_all(raw, '[A-Za-z0-9]+')) AS gram
  FROM messages m, (VALUES (2),(3)) n(n) WHERE {where}) WHERE length(gram)>=n AND gram NOT IN ('the','und'))"""


@query(
    "E19_keyword_stats",
    f"""WITH {D.INTRO}, {_GRAMS.format(where="role='user' AND m.sid NOT IN (SELECT sid FROM noise)")}
SELECT n, gram, count(*) AS freq, count(DISTINCT (sid, seq)) AS doc_freq FROM g GROUP BY n, gram""",
)
def keyword_stats(spark, d):
    scoped = R.text_scope(_messages(spark, d), "user", noise=D.noise(spark, d))
    return R.keyword_stats(scoped, (2, 3), ("the", "und"))


@query(
    "E19_document_keywords",
    """WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS gram FROM documents)
SELECT 2 AS n, gram, count(*) AS freq, count(DISTINCT doc_id) AS doc_freq FROM g WHERE length(gram)>=2 GROUP BY gram
ORDER BY doc_freq DESC, freq DESC, gram LIMIT 100""",
)
def document_keywords(spark, d):
    docs = schemas.read_table(spark, d, "documents").select(F.col("text").alias("raw"))
    return R.keyword_stats(docs, (2,)).orderBy(*R.keyword_order()).limit(100)


@query(
    "E19_excluded_messages",
    f"""WITH {D.INTRO} SELECT count(*) AS excluded FROM messages WHERE role='user' AND sid IN (SELECT sid FROM noise)""",
)
def excluded_messages(spark, d):
    return R.excluded_messages(_messages(spark, d), D.noise(spark, d))


@query(
    "C3_text_scope",
    f"""WITH {D.INTRO} SELECT sid, seq, role FROM messages WHERE role='user' AND sid IN (SELECT sid FROM tmembers) AND sid NOT IN (SELECT sid FROM noise)""",
)
def text_scope(spark, d):
    rows = R.text_scope(_messages(spark, d), "user", D.topic_members(spark, d), D.noise(spark, d))
    return rows.select("sid", "seq", "role")


@query(
    "E22_topic_overview",
    f"""WITH {STEPS}, {SESSIONS}, {MESSAGES}, {CONV_SESSIONS}, {D.ALL_SESSIONS}
SELECT topic_id, concat('topic ', topic_id) AS name, count(*) AS members_count, min(created_at) AS first_activity, max(updated_at) AS last_activity,
count(DISTINCT source) AS chain_count FROM emembers JOIN sessions USING (sid) GROUP BY topic_id""",
)
def topic_overview(spark, d):
    members = D.dated_members(spark, d)
    sessions = schemas.sessions_from_events(spark, d)
    topics = members.select("topic_id").distinct().withColumn("name", F.concat(F.lit("topic "), "topic_id"))
    chains = members.join(sessions.select("sid", "source"), "sid").select("topic_id", F.col("source").alias("chain_id"))
    return R.topic_overview(topics, members, sessions, chains)


@query(
    "E23_title_chain",
    f"""WITH {D.INTRO}, x AS (SELECT concat('w-', length(title)) AS topic_id, title, sid, '' AS created FROM titled)
SELECT topic_id, title, min(created) AS first_seen, min(sid) AS sid FROM x GROUP BY topic_id, title""",
)
def title_chain(spark, d):
    titled = D.titled(spark, d)
    members = titled.select(F.concat(F.lit("w-"), F.length("title")).alias("topic_id"), "sid")
    return R.title_chain(members, titled)


@query(
    "E23_topic_months",
    f"""WITH {STEPS}, {SESSIONS}, {MESSAGES}, {CONV_SESSIONS}, {D.ALL_SESSIONS}
SELECT topic_id, substr(created_at,1,7) AS month, count(*) AS n FROM emembers JOIN sessions USING (sid) GROUP BY ALL""",
)
def topic_months(spark, d):
    return R.topic_months(D.dated_members(spark, d), schemas.sessions_from_events(spark, d))


_CARD_MEMBERS = f"{MESSAGES}, {CONV_SESSIONS}, {D.CARDS}"


@query(
    "E23_missing_members",
    f"""WITH {_CARD_MEMBERS} SELECT type AS topic_id, session_id AS sid FROM cards WHERE session_id NOT IN (SELECT sid FROM csessions)""",
)
def missing_members(spark, d):
    members = D.cards(spark, d).select(F.col("type").alias("topic_id"), F.col("anchors")[0]["session_id"].alias("sid"))
    return R.missing_members(members, schemas.sessions_from_conversations(spark, d))


@query(
    "D10_unregistered_sessions",
    f"""WITH {D.INTRO} SELECT sid FROM csessions WHERE sid NOT IN (SELECT sid FROM tmembers)""",
)
def unregistered_sessions(spark, d):
    return schemas.sessions_from_conversations(spark, d).join(D.topic_members(spark, d), "sid", "left_anti").select("sid")


@query(
    "G7_members_in_noise",
    f"""WITH {D.INTRO} SELECT sid FROM tmembers INTERSECT SELECT sid FROM noise""",
)
def members_in_noise(spark, d):
    return D.topic_members(spark, d).select("sid").intersect(D.noise(spark, d).select("sid"))


@query(
    "E21_daily_counters",
    f"""WITH {ERRORS}, {D.LEDGER_LOG}, p AS (SELECT pattern, count(*) FILTER (WHERE NOT resolved) AS given_up, min(ts) AS first_seen FROM errs GROUP BY pattern)
SELECT (SELECT count(*) FROM llog WHERE status='pending') AS pending, count(*) FILTER (WHERE given_up>0) AS unresolved,
count(*) FILTER (WHERE first_seen>='2024-01-01 00:20:00') AS new_patterns,
(SELECT count(*) FROM llog WHERE status='rejected') AS inconclusive FROM p""",
)
def daily_counters(spark, d):
    log = D.ledger_log(spark, d)
    errors = O.collect_errors(store.steps(spark, d), schemas.sessions_from_events(spark, d))
    verdicts = log.select(F.when(F.col("status") == "rejected", "inconclusive").otherwise("unchanged").alias("verdict"))
    return R.daily_counters(log, errors, verdicts, "2024-01-01 00:20:00")
