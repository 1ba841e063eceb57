"""Queries over ordered steps and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas, store
from tracewell.functions import text
from tracewell.operators import sequence as Q
from tracewell.operators import steps as O
from tracewell.plans.scan import seq_block
from tracewell.workloads.base import CONV_SESSIONS, ERRORS, MESSAGES, MONTH_CUTOFF, SESSIONS, STEPS, query

TURNS = (
    MESSAGES
    + """,
turns AS (SELECT *, CAST(greatest(1, sum(CASE WHEN role='user' THEN 1 ELSE 0 END)
  OVER (PARTITION BY sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS INTEGER) AS turn_no FROM messages)"""
)


def _messages(spark, d):
    return schemas.messages_from_conversations(spark, d)


@query("C4_split_turns", f"WITH {TURNS} SELECT sid, seq, role, turn_no FROM turns")
def split_turns(spark, d):
    return Q.split_turns(_messages(spark, d).select("sid", "seq", "role"))


@query(
    "C5_turn_overview",
    f"""WITH {TURNS} SELECT sid, turn_no, count(*) AS messages, min(seq) AS first_seq,
string_agg(DISTINCT role, ',' ORDER BY role) AS roles,
left(trim(regexp_replace(arg_min(raw, seq), '\\s+', ' ', 'g')), 120) AS preview FROM turns GROUP BY sid, turn_no""",
)
def turn_overview(spark, d):
    return Q.turn_overview(_messages(spark, d))


@query(
    "C5_read_last_turn",
    f"""WITH {TURNS}, m AS (SELECT sid, max(turn_no) AS last_turn FROM turns GROUP BY sid)
SELECT sid, seq, role, turn_no FROM turns JOIN m USING (sid) WHERE turn_no=last_turn""",
)
def read_last_turn(spark, d):
    return Q.read_turn(_messages(spark, d), "last").select("sid", "seq", "role", "turn_no")


@query(
    "C5_read_turn_2",
    f"""WITH {TURNS} SELECT sid, seq, role, raw FROM turns WHERE turn_no=2""",
)
def read_turn_2(spark, d):
    return Q.read_turn(_messages(spark, d), 2).select("sid", "seq", "role", "raw")


@query(
    "C5_turn_bounds",
    f"""WITH {TURNS} SELECT sid, CAST(max(turn_no) AS INTEGER) AS turns, max(turn_no)>=3 AS in_range FROM turns GROUP BY sid""",
)
def turn_bounds(spark, d):
    return Q.turn_bounds(_messages(spark, d), 3)


@query(
    "D5_turn_asof",
    f"""WITH {STEPS}, t AS (SELECT sid, ts, row_number() OVER (PARTITION BY sid ORDER BY seq) AS turn FROM steps WHERE phase='result' AND status='completed'),
e AS (SELECT sid, seq, ts FROM steps WHERE status='error')
SELECT e.sid, e.seq, e.ts, CAST(max(t.turn) AS INTEGER) AS turn FROM e LEFT JOIN t ON t.sid=e.sid AND t.ts<=e.ts GROUP BY ALL""",
)
def turn_asof(spark, d):
    steps = store.steps(spark, d)
    # finished results stand in for user turns: the given messages carry no stamps
    turns = steps.filter((F.col("phase") == "result") & (F.col("status") == "completed")).select(
        "sid", "seq", F.lit("user").alias("role"), "ts", F.col("tool").alias("raw")
    )
    return Q.turn_asof(steps.filter(F.col("status") == "error").select("sid", "seq", "ts"), turns)


_LONG = """n AS (SELECT sid, count(*) AS n_steps FROM steps GROUP BY sid),
s AS (SELECT list(n_steps ORDER BY n_steps) AS a FROM n),
p AS (SELECT a[CAST(floor(0.95*(len(a)-1)) AS INTEGER)+1] AS p95 FROM s)"""


@query("F1_long_sessions", f"WITH {STEPS}, {_LONG} SELECT sid, n_steps, p95 FROM n, p WHERE n_steps>p95")
def long_sessions(spark, d):
    return Q.long_sessions(store.steps(spark, d))


_RUNS = """c AS (SELECT sid, seq, tool, row_number() OVER (PARTITION BY sid ORDER BY seq)
  - row_number() OVER (PARTITION BY sid, tool ORDER BY seq) AS g FROM steps WHERE phase='call')"""


@query(
    "F2_same_tool_streaks",
    f"""WITH {STEPS}, {_RUNS} SELECT sid, tool, min(seq) AS first_seq, count(*) AS length FROM c GROUP BY sid, tool, g HAVING count(*)>=3""",
)
def same_tool_streaks(spark, d):
    return Q.same_tool_streaks(store.steps(spark, d), minimum=3)


@query(
    "F3_tool_loops",
    f"""WITH RECURSIVE {STEPS},
c AS (SELECT sid, seq, tool, lag(tool) OVER (PARTITION BY sid ORDER BY seq) AS p FROM steps WHERE phase='call'),
dd AS (SELECT sid, list(tool ORDER BY seq) AS t, list(seq ORDER BY seq) AS q FROM c WHERE p IS NULL OR p<>tool GROUP BY sid),
nxt AS (
  SELECT sid, t, q, 1 AS i, 0 AS k FROM dd
  UNION ALL
  SELECT sid, t, q, i + 2*kk AS i, kk AS k FROM (
    SELECT sid, t, q, i, (
      SELECT coalesce(min(j), 1000000) FROM range(1, 200) r(j)
      WHERE NOT (i+2*j+1 <= len(t) AND t[i+2*j]=t[i] AND t[i+2*j+1]=t[i+1])) AS kk
    FROM nxt WHERE i+1 <= len(t))),
hits AS (SELECT sid, t, q, k, i-2*k AS s FROM nxt WHERE k>=2)
SELECT sid, concat(t[s], '↔', t[s+1]) AS loop, CAST(k AS BIGINT) AS cycles, q[s] AS first_seq FROM hits""",
)
def tool_loops(spark, d):
    return Q.tool_loops(store.steps(spark, d), minimum=2)


@query(
    "F4_tool_spins",
    f"""WITH {STEPS}, r AS (SELECT sid, tool, seq, coalesce(status='error', false) AS f,
  row_number() OVER (PARTITION BY sid, tool ORDER BY seq)
  - row_number() OVER (PARTITION BY sid, tool, coalesce(status='error', false) ORDER BY seq) AS g FROM steps WHERE phase='result')
SELECT sid, tool, min(seq) AS first_seq, count(*) AS length FROM r WHERE f GROUP BY sid, tool, f, g HAVING count(*)>=3""",
)
def tool_spins(spark, d):
    return Q.tool_spins(store.steps(spark, d), minimum=3)


@query(
    "F5_top_sessions",
    f"""WITH {STEPS} SELECT sid, count(*) AS n_steps FROM steps GROUP BY sid ORDER BY n_steps DESC, sid LIMIT 10""",
)
def top_sessions(spark, d):
    return Q.top_sessions(store.steps(spark, d))


INVOCATIONS = (
    STEPS
    + ",\n"
    + SESSIONS
    + """,
opened AS (SELECT *, last_value(CASE WHEN phase='call' AND tool='Skill' THEN seq END IGNORE NULLS)
  OVER (PARTITION BY sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_seq FROM steps),
closed AS (SELECT sid, open_seq, min(seq) AS close_seq FROM opened WHERE phase='result' AND tool='Skill' AND open_seq IS NOT NULL
  GROUP BY sid, open_seq),
later AS (SELECT o.sid, o.open_seq, o.seq, o.tool, row_number() OVER (PARTITION BY o.sid, o.open_seq ORDER BY o.seq) AS nth
  FROM opened o JOIN closed c ON c.sid=o.sid AND c.open_seq=o.open_seq WHERE o.phase='call' AND o.seq>c.close_seq),
kept AS (SELECT *, lag(tool) OVER (PARTITION BY sid, open_seq ORDER BY nth) AS p FROM later WHERE nth<=12),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sid, open_seq ORDER BY nth) AS m FROM kept WHERE p IS NULL OR p<>tool),
chains AS (SELECT sid, open_seq, string_agg(tool, '→' ORDER BY m) AS chain FROM numbered WHERE m<=8 GROUP BY sid, open_seq),
invs AS (SELECT s.sid, s.seq, s.ts, coalesce(se.source,'?') AS source, json_extract_string(s.detail,'$.skill') AS skill,
  CASE WHEN c.close_seq IS NULL THEN 'no_result' ELSE coalesce(r.status,'unknown') END AS status,
  coalesce(r.error,'') AS error, coalesce(h.chain,'') AS chain
  FROM steps s LEFT JOIN sessions se ON se.sid=s.sid LEFT JOIN closed c ON c.sid=s.sid AND c.open_seq=s.seq
  LEFT JOIN steps r ON r.sid=c.sid AND r.seq=c.close_seq LEFT JOIN chains h ON h.sid=s.sid AND h.open_seq=s.seq
  WHERE s.phase='call' AND s.tool='Skill')"""
)


def _invocations(spark, d):
    return Q.skill_invocations(store.steps(spark, d), schemas.sessions_from_events(spark, d))


@query("F6_skill_invocations", f"WITH {INVOCATIONS} SELECT sid, seq, ts, source, skill, status, error, chain FROM invs")
def skill_invocations(spark, d):
    return _invocations(spark, d).select(
        "sid", "seq", "ts", "source", "skill", "status", "error", F.array_join("after_tools", "→").alias("chain")
    )


@query(
    "F7_skill_name",
    f"""WITH {STEPS} SELECT sid, seq, json_extract_string(detail,'$.skill') AS skill FROM steps WHERE phase='call' AND tool='Skill'""",
)
def skill_name(spark, d):
    rows = store.steps(spark, d).filter(O.is_skill_call())
    return rows.select("sid", "seq", O.skill_name(F.col("tool"), F.col("detail")).alias("skill"))


@query(
    "E14_skill_summary",
    f"""WITH {INVOCATIONS} SELECT skill, count(*) AS calls, count(DISTINCT sid) AS sessions,
string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (WHERE status='completed') AS ok,
count(*) FILTER (WHERE status NOT IN ('completed','no_result')) AS err, count(*) FILTER (WHERE status='no_result') AS no_result
FROM invs GROUP BY skill""",
)
def skill_summary(spark, d):
    return Q.skill_summary(_invocations(spark, d)).withColumn("sources", F.array_join("sources", ","))


@query(
    "E14_skill_chains",
    f"""WITH {INVOCATIONS}, c AS (SELECT skill, chain, count(*) AS n FROM invs WHERE chain<>'' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY n DESC, chain) AS rn FROM c)
SELECT skill, chain, n, CAST(rn AS INTEGER) AS rank FROM r WHERE rn<=5""",
)
def skill_chains(spark, d):
    return Q.skill_top_chains(_invocations(spark, d))


@query(
    "E14_skill_anchors",
    f"""WITH {INVOCATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY sid, seq) AS rn FROM invs)
SELECT skill, 'anchor' AS kind, CAST(rn AS INTEGER) AS rank, concat(sid, '#', seq) AS value FROM r WHERE rn<=10""",
)
def skill_anchors(spark, d):
    return Q.skill_samples(_invocations(spark, d))


@query(
    "F8_coherence",
    f"""WITH {MESSAGES}, u AS (SELECT sid, seq, regexp_replace(raw, '\\s+', '', 'g') AS t FROM messages WHERE role='user' AND trim(raw)<>''),
g AS (SELECT sid, seq, list_distinct([t[i:i+1] FOR i IN range(1, length(t))]) AS grams FROM u),
p AS (SELECT *, lag(grams) OVER (PARTITION BY sid ORDER BY seq) AS q FROM g),
s AS (SELECT sid, CASE WHEN q IS NULL THEN NULL WHEN len(q)=0 OR len(grams)=0 THEN 0.0
  ELSE len(list_intersect(q, grams)) / (len(q)+len(grams)-len(list_intersect(q, grams))) END AS j FROM p)
SELECT sid, count(*) AS turns, round(coalesce(avg(j), 1.0), 6) AS coherence FROM s GROUP BY sid""",
)
def coherence(spark, d):
    return Q.coherence(_messages(spark, d)).withColumn("coherence", F.round("coherence", 6))


@query(
    "F9_even_pick",
    f"""WITH {STEPS}, r AS (SELECT sid, seq, tool, row_number() OVER (PARTITION BY sid ORDER BY seq)-1 AS i,
  count(*) OVER (PARTITION BY sid) AS n FROM steps),
j AS (SELECT DISTINCT sid, CAST(round_even(j.j*(n-1)/5.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT sid, n FROM r) x, range(0,6) j(j))
SELECT sid, seq, tool FROM r SEMI JOIN j USING (sid, i) UNION SELECT sid, seq, tool FROM r WHERE n<=6""",
)
def even_pick(spark, d):
    rows = store.steps(spark, d).select("sid", "seq", "tool")
    return Q.even_pick(rows, ["sid"], ["seq"], seq_block(), 6)


@query(
    "F11_budgeted_blocks",
    f"""WITH {MESSAGES}, r AS (SELECT sid, seq, raw, length(raw)+1 AS cost,
  sum(length(raw)+1) OVER (PARTITION BY sid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto FROM messages)
SELECT sid, seq, CASE WHEN upto<=1500 THEN 'whole' ELSE 'cut' END AS fit,
 CASE WHEN upto<=1500 THEN raw ELSE left(raw, CAST(1500-(upto-cost) AS INTEGER)) END AS block
FROM r WHERE upto<=1500 OR (upto-cost<=1500 AND 1500-(upto-cost)>=100)""",
)
def budgeted_blocks(spark, d):
    return Q.budgeted_text(_messages(spark, d), 1500)


@query(
    "F13_coarse_timeline",
    f"""WITH {MESSAGES} SELECT sid, left(arg_min(raw, seq) FILTER (WHERE role='user'), 400) AS first_user,
left(arg_max(raw, seq) FILTER (WHERE role='assistant'), 400) AS last_assistant FROM messages GROUP BY sid""",
)
def coarse_timeline(spark, d):
    return Q.coarse_timeline(_messages(spark, d))


@query("F13_mid_timeline", f"WITH {MESSAGES} SELECT sid, seq, left(raw, 800) AS raw FROM messages WHERE role='user'")
def mid_timeline(spark, d):
    return Q.mid_timeline(_messages(spark, d))


@query(
    "F15_session_intro",
    f"""WITH {MESSAGES} SELECT sid, arg_min(raw, seq) FILTER (WHERE role='user') AS first_user,
count(*) FILTER (WHERE role='user') AS user_turns, count(*) FILTER (WHERE role='assistant') AS assistant_turns
FROM messages GROUP BY sid""",
)
def session_intro(spark, d):
    return Q.session_intro(_messages(spark, d))


@query(
    "F16_session_pack_turns",
    f"""WITH {TURNS}, {CONV_SESSIONS} SELECT t.sid, title, 'turn' AS part, turn_no AS part_no, seq, role AS label, raw AS body FROM turns t JOIN csessions USING (sid)""",
)
def session_pack_turns(spark, d):
    empty_steps = store.steps(spark, d)
    return Q.session_pack(schemas.sessions_from_conversations(spark, d), _messages(spark, d), empty_steps)


@query(
    "F16_session_pack_errors",
    f"""WITH {ERRORS} SELECT e.sid, s.title, 'error' AS part, 0 AS part_no, seq, tool AS label, error AS body
FROM errs e JOIN sessions s ON s.sid=e.sid""",
)
def session_pack_errors(spark, d):
    sessions = schemas.sessions_from_events(spark, d)
    return Q.session_pack(sessions, _messages(spark, d), store.steps(spark, d))


@query(
    "I5_est_tokens",
    f"""WITH {MESSAGES} SELECT sid, seq, CAST(length(raw)//4 + 1 AS BIGINT) AS tokens FROM messages""",
)
def est_tokens(spark, d):
    return _messages(spark, d).select("sid", "seq", text.est_tokens("raw").alias("tokens"))


_PACK = f"""WITH {TURNS}, {CONV_SESSIONS},
h AS (SELECT c.sid, c.session_id, c.title, max(turn_no) AS n_turns FROM csessions c JOIN turns USING (sid) GROUP BY ALL),
hd AS (SELECT sid, length(concat('## ', title, chr(10), chr(10), '- source: conv | date: ', chr(10), '- session_id: ', session_id,
  ' | turns: ', n_turns, chr(10), chr(10)))//4+1 AS head_cost FROM h),
seg AS (SELECT sid, turn_no, string_agg(concat('[', role, '] ', trim(raw, ' ' || chr(10))), chr(10) ORDER BY seq) AS seg FROM turns GROUP BY sid, turn_no),
bud AS (SELECT greatest(200, 20000 // count(*)) AS per FROM csessions),
r AS (SELECT s.sid, turn_no, seg, length(seg)//4+5 AS cost, head_cost,
  head_cost + sum(length(seg)//4+5) OVER (PARTITION BY s.sid ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS upto, per
  FROM seg s JOIN hd USING (sid), bud)
SELECT sid, turn_no, CASE WHEN upto<=per THEN 'whole' ELSE 'cut' END AS fit,
  CASE WHEN upto<=per THEN seg ELSE left(seg, CAST(4*(per-(upto-cost)) AS INTEGER)) END AS block
FROM r WHERE upto<=per OR (upto-cost<=per AND per-(upto-cost)>40)"""


@query("F12_context_pack", _PACK)
def context_pack(spark, d):
    return Q.context_pack(_messages(spark, d), schemas.sessions_from_conversations(spark, d), 20000)


@query(
    "F14_transcript_pack",
    f"""WITH {STEPS}, {MESSAGES}, s AS (SELECT replace(sid, 'u:', 'conv:') AS sid, seq, tool, phase, status, error FROM steps),
r AS (SELECT sid, 0 AS p, 'message' AS part, seq, concat('[', sid, '#m', seq, '] ', role, ': ', coalesce(raw,'')) AS line FROM messages
  UNION ALL SELECT sid, 1, 'step', seq, concat('[', sid, '#', seq, '] ', tool, ' ', phase, ' ', coalesce(status,''), ' ', coalesce(error,'')) FROM s),
c AS (SELECT *, sum(length(line)+1) OVER (PARTITION BY sid ORDER BY p, seq ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT sid, part, seq, line FROM c WHERE upto<=6000""",
)
def transcript_pack(spark, d):
    steps = store.steps(spark, d).withColumn("sid", F.regexp_replace("sid", "^u:", "conv:"))
    return Q.transcript_pack(_messages(spark, d), steps, 6000)


@query(
    "F10_monthly_anchor_packs",
    f"""WITH {STEPS}, r AS (SELECT sid, seq, substr(ts,1,7) AS month, error, row_number() OVER (PARTITION BY substr(ts,1,7) ORDER BY ts, sid, seq)-1 AS i,
  count(*) OVER (PARTITION BY substr(ts,1,7)) AS n, ts FROM steps WHERE status='error'),
j AS (SELECT DISTINCT month, CAST(round_even(j.j*(n-1)/5.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT month, n FROM r) x, range(0,6) j(j)),
p AS (SELECT sid, seq, ts, month, length(error) AS cost FROM r SEMI JOIN j USING (month, i)),
c AS (SELECT *, sum(cost) OVER (ORDER BY month, ts, sid, seq ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT month, sid, seq, CAST(cost AS INTEGER) AS cost, upto<=200 AS kept FROM c""",
)
def monthly_anchor_packs(spark, d):
    errors = store.steps(spark, d).filter(F.col("status") == "error")
    rows = errors.select("sid", "seq", "ts", F.length("error").alias("cost"))
    return Q.monthly_anchor_packs(rows, 6, 200).select("month", "sid", "seq", "cost", "kept")
