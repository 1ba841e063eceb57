"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


STEPS = """ev AS (
  SELECT event_id, user_id, ts, event_type, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events),
steps AS (
  SELECT concat('u:', user_id) AS sid,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq,
    CAST(ts AS VARCHAR) AS ts,
    CASE WHEN k % 5 = 0 THEN 'Skill' ELSE concat('tool_', k % 5) END AS tool,
    CASE WHEN event_type IN ('click','view','signup') THEN 'call' ELSE 'result' END AS phase,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' END AS status,
    CASE WHEN event_type = 'error' THEN concat('Error: cannot open "f', event_id, '" code ', k,
      CASE k % 3 WHEN 0 THEN ' timed out' WHEN 1 THEN ' does not exist' ELSE ' out of range' END) END AS error,
    CASE WHEN k % 5 = 0 AND event_type IN ('click','view','signup') THEN concat('{"skill":"sk', k % 4, '"}') END AS detail
  FROM ev)"""

SESSIONS = """sessions AS (
  SELECT concat('u:', user_id) AS sid, concat('src', user_id % 4) AS source, CAST(user_id AS VARCHAR) AS session_id,
    concat('u:', user_id) AS title, CAST(min(ts) AS VARCHAR) AS created_at, CAST(max(ts) AS VARCHAR) AS updated_at,
    CASE WHEN user_id % 3 <> 0 THEN concat('m', user_id % 3) END AS model
  FROM events GROUP BY user_id)"""

MESSAGES = """messages AS (
  SELECT concat('conv:', conv_id) AS sid, CAST(turn AS INTEGER) AS seq, role, text AS raw FROM conversations)"""

CONV_SESSIONS = r"""csessions AS (
  SELECT concat('conv:', conv_id) AS sid, 'conv' AS source, CAST(conv_id AS VARCHAR) AS session_id,
    left(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role='user'), '\s+', ' ', 'g')), 80) AS title
  FROM conversations GROUP BY conv_id)"""

ERRORS = STEPS + ",\n" + SESSIONS + r""",
ends AS (SELECT sid, max(seq) AS max_seq FROM steps GROUP BY sid),
lastcall AS (SELECT sid, tool, max(seq) AS last_call FROM steps WHERE phase='call' GROUP BY sid, tool),
skilled AS (
  SELECT sid, seq, last_value(CASE WHEN tool='Skill' AND phase='call' THEN json_extract_string(detail,'$.skill') END
    IGNORE NULLS) OVER (PARTITION BY sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS skill
  FROM steps),
errs AS (
  SELECT s.sid, s.seq, s.ts, s.tool, s.error, coalesce(se.source,'?') AS source, coalesce(se.model,'(unknown)') AS model,
    CASE WHEN s.error LIKE '%timed out%' THEN 'env' WHEN s.error LIKE '%out of range%' THEN 'tool_interface'
         WHEN s.error LIKE '%does not exist%' THEN 'context' ELSE 'unclassified' END AS class,
    left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s.error, '^Error:\s*', ''), '"[^"]*"', '<q>', 'g'),
      '\d+', 'N', 'g'), '\s+', ' ', 'g')), 100) AS pattern,
    CASE WHEN s.seq / (CASE WHEN e.max_seq=0 THEN 1 ELSE e.max_seq END) <= 1.0/3 THEN 'opening'
         WHEN s.seq / (CASE WHEN e.max_seq=0 THEN 1 ELSE e.max_seq END) <= 2.0/3 THEN 'middle' ELSE 'closing' END AS bucket,
    coalesce(l.last_call > s.seq, false) AS resolved, k.skill
  FROM steps s LEFT JOIN sessions se ON se.sid=s.sid LEFT JOIN ends e ON e.sid=s.sid
    LEFT JOIN lastcall l ON l.sid=s.sid AND l.tool=s.tool LEFT JOIN skilled k ON k.sid=s.sid AND k.seq=s.seq
  WHERE s.status='error')"""

TOOLS = """marked AS (
  SELECT sid, tool, seq, phase='call' AS is_call,
    phase<>'call' AND coalesce(status,'unknown') NOT IN ('success','completed','ok') AS is_err FROM steps),
flow AS (
  SELECT *, NOT is_err AND coalesce(lag(is_err) OVER (PARTITION BY sid, tool ORDER BY seq), false) AS is_retry
  FROM marked WHERE is_call OR is_err),
retried AS (SELECT tool, CAST(count(*) FILTER (WHERE is_retry) AS BIGINT) AS retried FROM flow GROUP BY tool),
tools AS (
  SELECT m.tool, count(*) FILTER (WHERE is_call) AS calls, count(*) FILTER (WHERE NOT is_call AND NOT is_err) AS success,
    count(*) FILTER (WHERE is_err) AS error FROM marked m GROUP BY m.tool)"""

MONTH_CUTOFF = "2024-01-20 00:00:00"
