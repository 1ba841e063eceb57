"""Queries over ingestion and exports, fed with JSON built from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell import schemas, store
from tracewell.functions import text
from tracewell.operators import reports as R
from tracewell.operators import steps as O
from tracewell.session import ensure_checkpoint_dir
from tracewell.sources import formats as FM
from tracewell.sources import ingest as I
from tracewell.sources import sinks as B
from tracewell.sources.buckets import BucketedTables
from tracewell.workloads import derived as D
from tracewell.workloads.base import CONV_SESSIONS, MESSAGES, SESSIONS, STEPS, query

_KEY = "concat('d', conv_id, '-', turn)"


def _conv(spark, d):
    return schemas.read_table(spark, d, "conversations").withColumn("key", F.concat(F.lit("d"), "conv_id", F.lit("-"), "turn"))


def _trim(col):
    return text.strip(col)


# One exported document per message, with the layout's own noise around it.


@query(
    "A2_tree_chat",
    f"""SELECT {_KEY} AS session_id, CAST(0 AS INTEGER) AS seq, 'user' AS role, '2023-11-14 22:13:20' AS ts, text FROM conversations
UNION ALL SELECT {_KEY}, 1, 'note', NULL, concat('[tool]', chr(10), 'looked up ', role) FROM conversations""",
)
def tree_chat(spark, d):
    def node(parent, role, body, stamp, hidden=False):
        meta = F.struct(F.lit(hidden).alias("is_visually_hidden_from_conversation"))
        content = F.struct(F.lit("text").alias("content_type"), F.array(body).alias("parts"))
        message = F.struct(
            F.struct(F.lit(role).alias("role")).alias("author"), content.alias("content"), stamp.alias("create_time"), meta.alias("metadata")
        )
        return F.struct(F.lit(parent).cast("string").alias("parent"), F.array().cast("array<string>").alias("children"), message.alias("message"))

    none = F.lit(None).cast("double")
    mapping = F.create_map(
        F.lit("n2"), node("n1", "tool", F.concat(F.lit("looked up "), "role"), none),
        F.lit("root"), node(None, "system", F.lit("rules"), none),
        F.lit("side"), node("root", "user", F.lit("abandoned branch"), none),
        F.lit("h"), node("root", "user", F.lit("hidden text"), none, True),
        F.lit("n1"), node("h", "user", F.col("text"), F.lit(1700000000.5)),
    )
    docs = _conv(spark, d).select(
        F.to_json(F.struct(F.col("key").alias("id"), F.lit("n2").alias("current_node"), mapping.alias("mapping"))).alias("doc")
    )
    # the stamp is an instant; show it in UTC whatever the session zone
    out = FM.parse_tree_chat(docs)
    shifted = F.date_format(F.to_utc_timestamp(F.to_timestamp("ts"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return out.select("session_id", "seq", "role", shifted.alias("ts"), "text")


@query(
    "A3_linear_chat",
    f"""SELECT {_KEY} AS session_id, CAST(0 AS INTEGER) AS seq, 'user' AS role, text FROM conversations
UNION ALL SELECT {_KEY}, 1, 'assistant', concat(role, chr(10), 'done') FROM conversations""",
)
def linear_chat(spark, d):
    block = F.array(
        F.struct(F.lit("text").alias("type"), F.col("role").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")),
        F.struct(F.lit("text").alias("type"), F.lit("done").alias("text")),
    )
    none = F.lit(None).cast(block_type())
    chat = F.array(
        F.struct(F.lit("human").alias("sender"), F.col("text").alias("text"), none.alias("content"), F.lit("2024-01-02T03:04:05").alias("created_at")),
        F.struct(F.lit("robot").alias("sender"), F.lit("dropped").alias("text"), none.alias("content"), F.lit("").alias("created_at")),
        F.struct(F.lit("assistant").alias("sender"), F.lit(" ").alias("text"), block.alias("content"), F.lit("").alias("created_at")),
    )
    docs = _conv(spark, d).select(F.to_json(F.struct(F.col("key").alias("uuid"), chat.alias("chat_messages"))).alias("doc"))
    return FM.parse_linear_chat(docs).select("session_id", "seq", "role", "text")


def block_type():
    return "array<struct<type:string,text:string>>"


@query(
    "A4_fragment_tree",
    f"""SELECT {_KEY} AS session_id, CAST(0 AS INTEGER) AS seq, 'user' AS role, text, 1 AS branch_points FROM conversations
UNION ALL SELECT {_KEY}, 1, 'note', concat('[think]', chr(10), role), 1 FROM conversations
UNION ALL SELECT {_KEY}, 2, 'assistant', CASE WHEN role='user' THEN 'late' ELSE 'early' END, 1 FROM conversations""",
)
def fragment_tree(spark, d):
    frag = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("content"))

    def node(children, stamp, *frags):
        message = F.struct(F.lit("m").alias("model"), stamp.alias("inserted_at"), F.array(*frags).alias("fragments"))
        return F.struct(F.array(*[F.lit(c) for c in children]).cast("array<string>").alias("children"), message.alias("message"))

    late = F.when(F.col("role") == "user", "2024-01-03T00:00:00").otherwise("2024-01-01T12:00:00")
    mapping = F.create_map(
        F.lit("root"), node(["1"], F.lit(""), frag("OTHER", F.lit(""))),
        F.lit("1"), node(["2", "3"], F.lit("2024-01-01T00:00:00"), frag("REQUEST", F.col("text")), frag("THINK", F.col("role"))),
        F.lit("2"), node([], F.lit("2024-01-02T00:00:00"), frag("RESPONSE", F.lit("early"))),
        F.lit("3"), node([], late, frag("RESPONSE", F.lit("late"))),
    )
    docs = _conv(spark, d).select(F.to_json(F.struct(F.col("key").alias("id"), mapping.alias("mapping"))).alias("doc"))
    branches = FM.tree_threads(docs).select("session_id", "branch_points")
    return FM.parse_fragment_tree(docs).select("session_id", "seq", "role", "text").join(branches, "session_id")


@query(
    "A4_flat_chat",
    f"""SELECT {_KEY} AS session_id, CAST(0 AS INTEGER) AS seq, CASE WHEN role='user' THEN 'user' WHEN role='assistant' THEN 'assistant' ELSE 'system' END AS role, text FROM conversations
UNION ALL SELECT {_KEY}, 1, 'note', concat('[reasoning_content]', chr(10), 'why ', turn) FROM conversations WHERE role='assistant'""",
)
def flat_chat(spark, d):
    role = F.when(F.col("role") == "assistant", "Bot").otherwise(F.col("role"))
    thought = F.when(F.col("role") == "assistant", F.concat(F.lit("why "), "turn"))
    message = F.struct(role.alias("role"), F.col("text").alias("content"), thought.alias("reasoning_content"))
    docs = _conv(spark, d).select(F.to_json(F.struct(F.col("key").alias("id"), F.array(message).alias("messages"))).alias("doc"))
    return FM.parse_flat_chat(docs).select("session_id", "seq", "role", "text")


@query(
    "A5_patch_log",
    f"""SELECT {_KEY} AS session_id, CAST(0 AS INTEGER) AS seq, 'user' AS role, text FROM conversations
UNION ALL SELECT {_KEY}, 1, 'note', concat('[tool_call] grep: find ', role) FROM conversations
UNION ALL SELECT {_KEY}, 2, 'assistant', concat('first', chr(10), 'second ', role) FROM conversations""",
)
def patch_log(spark, d):
    first = F.to_json(F.struct(F.lit(0).alias("kind"), F.from_json(F.lit('{"requests":[]}'), "struct<requests:array<string>>").alias("v")))
    ask = F.struct(F.lit(2).alias("kind"), F.array(F.lit("requests")).alias("k"), F.array(F.struct(F.struct(F.lit("draft").alias("text")).alias("message"))).alias("v"))
    fix = F.concat(F.lit('{"kind":1,"k":["requests",0,"message","text"],"v":'), F.to_json(F.struct(F.col("text").alias("t"))), F.lit("}"))
    fix = F.regexp_replace(fix, r'"v":\{"t":(.*)\}\}$', '"v":$1}')
    reply = F.concat(
        F.lit('{"kind":2,"k":["requests",0,"response"],"v":[{"value":"first"},{"kind":"toolInvocationSerialized","toolId":"grep","invocationMessage":{"value":"find '),
        "role", F.lit('"}},{"value":"second '), "role", F.lit('"}]}'),
    )
    log = F.concat_ws("\n", first, F.to_json(ask), fix, F.lit("not json"), reply)
    states = FM.replay_logs(FM.log_lines(_conv(spark, d).select(F.col("key").alias("session_id"), log.alias("log"))))
    return FM.parse_patch_state(states).select("session_id", "seq", "role", "text")


def _log_lines(spark, d, *entries):
    """Several JSON lines per message, numbered inside one session per conversation."""
    rows = _conv(spark, d).select(
        F.concat(F.lit("d"), "conv_id").alias("session_id"), "turn", F.posexplode(F.array(*entries)).alias("part", "value")
    )
    return rows.select("session_id", (F.col("turn") * len(entries) + F.col("part")).alias("line_no"), "value")


@query(
    "A6_transcript",
    r"""WITH x AS (SELECT concat('d', conv_id) AS session_id, turn, role, text FROM conversations),
m AS (SELECT session_id, turn, 0 AS p, 'note' AS role, '[context] files open' AS text, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS VARCHAR) AS status FROM x WHERE role='user'
 UNION ALL SELECT session_id, turn, 1, CASE WHEN role='user' THEN 'user' ELSE 'assistant' END, trim(text), NULL, NULL FROM x WHERE role IN ('user','assistant')
 UNION ALL SELECT session_id, turn, 2, 'note', '[tool_call] read_file: {"path":"a"}', 'read_file', NULL FROM x
 UNION ALL SELECT session_id, turn, 3, 'note', CASE WHEN role='user' THEN '[tool_result] read_file: error; Error: gone' ELSE '[tool_result] read_file: completed' END, 'read_file',
   CASE WHEN role='user' THEN 'error' ELSE 'completed' END FROM x)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, p)-1 AS INTEGER) AS seq, role, text, tool, status FROM m""",
)
def transcript(spark, d):
    call_id = F.concat(F.lit("c"), "turn")
    body = F.when(F.col("role") == "user", F.concat(F.lit("files open <user_query>"), "text", F.lit("</user_query>"))).otherwise(F.col("text"))
    message = F.to_json(
        F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), F.array(F.struct(body.alias("text"))).alias("content"))
    )
    call = F.to_json(
        F.struct(F.lit("function_call").alias("type"), F.lit("read_file").alias("name"), call_id.alias("callId"), F.lit('{"path":"a"}').alias("arguments"))
    )
    output = F.when(F.col("role") == "user", "Error: gone").otherwise("fine")
    result = F.to_json(F.struct(F.lit("function_call_result").alias("type"), call_id.alias("callId"), output.alias("output")))
    rows = FM.parse_transcript(_log_lines(spark, d, message, call, result))
    return rows.select(
        "session_id", "seq", "role", "text", F.get_json_object("raw", "$.tool").alias("tool"), F.get_json_object("raw", "$.status").alias("status")
    )


def _event_lines(spark, d):
    call_id = F.concat(F.lit("c"), "turn")
    user = F.to_json(
        F.struct(
            F.lit("user/message").alias("type"),
            (F.lit(1700000000000) + F.col("turn")).alias("time"),
            F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("data"),
        )
    )
    args = F.concat(F.lit('{"file_path":"f'), "turn", F.lit('","old_string":"a","new_string":"b"}'))
    call = F.to_json(
        F.struct(
            F.lit("tool/call").alias("type"),
            F.lit(1700000000000).alias("time"),
            F.struct(F.lit("edit").alias("name"), F.lit("edit").alias("tool"), call_id.alias("callId"), args.alias("arguments")).alias("data"),
        )
    )
    failed = F.col("role") == "user"
    message = F.struct(call_id.alias("toolCallId"), failed.alias("isError"), F.array(F.struct(F.lit("text").alias("type"), F.lit("out").alias("text"))).alias("content"))
    error = F.when(failed, F.struct(F.lit("E1").alias("code"), F.lit("stale").alias("message")))
    result = F.to_json(F.struct(F.lit("tool/result").alias("type"), F.struct(message.alias("message"), error.alias("error")).alias("data")))
    return _log_lines(spark, d, user, call, result)


@query(
    "A7_event_log_steps",
    """WITH x AS (SELECT concat('d', conv_id) AS session_id, turn, role FROM conversations),
s AS (SELECT session_id, turn, 0 AS p, 'edit' AS tool, 'call' AS phase, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS error FROM x
 UNION ALL SELECT session_id, turn, 1, 'edit', 'result', CASE WHEN role='user' THEN 'error' ELSE 'completed' END, CASE WHEN role='user' THEN 'E1 / stale' END FROM x)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, p)-1 AS INTEGER) AS seq, tool, phase, status, error FROM s""",
)
def event_log_steps(spark, d):
    return I.flat_steps(FM.parse_event_log(_event_lines(spark, d))).select("session_id", "seq", "tool", "phase", "status", "error")


@query(
    "A24_artifact_edits",
    """SELECT concat('d', conv_id) AS sid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS INTEGER) AS seq, 'edit' AS tool,
concat('f', turn) AS file_path, 'a' AS old_text, 'b' AS new_text FROM conversations""",
)
def artifact_edits(spark, d):
    return I.artifact_edits(_event_lines(spark, d)).drop("ts")


@query(
    "A25_artifact_coverage",
    """WITH s AS (SELECT DISTINCT concat('d', conv_id) AS sid, true AS edits FROM conversations UNION ALL SELECT concat('page', page_id), false FROM pages)
SELECT count(*) AS sessions, count(*) FILTER (WHERE edits) AS with_artifacts, round(count(*) FILTER (WHERE edits)*100.0/count(*), 1) AS pct FROM s""",
)
def artifact_coverage(spark, d):
    """Conversations have edits, visits of pages have none."""
    pages = schemas.read_table(spark, d, "pages").select(F.concat(F.lit("page"), "page_id").alias("sid"))
    sessions = _conv(spark, d).select(F.concat(F.lit("d"), "conv_id").alias("sid")).distinct().unionByName(pages)
    return I.artifact_coverage(sessions, I.artifact_edits(_event_lines(spark, d)))


@query(
    "A18_shape_problems",
    """SELECT DISTINCT concat('d', conv_id) AS session_id, 'user/message lacks $.data.content' AS problem FROM conversations WHERE role='system'""",
)
def shape_problems(spark, d):
    broken = F.when(F.col("role") == "system", '{"type":"user/message","data":{}}').otherwise('{"type":"user/message","data":{"content":[]}}')
    return I.shape_problems(_log_lines(spark, d, broken))


@query(
    "A18_schema_fingerprint",
    """WITH k AS (SELECT conv_id, bool_or(role='system') AS s, bool_or(role='assistant') AS a FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, concat('{"note":["type"', CASE WHEN s THEN ',"x"' ELSE '' END, ']', CASE WHEN a THEN ',"reply":["a","type"]' ELSE '' END, '}') AS canon FROM k)
SELECT concat('d', conv_id) AS session_id, left(sha256(canon), 12) AS fingerprint FROM c""",
)
def schema_fingerprint(spark, d):
    kind = F.when(F.col("role") == "system", '{"type":"note","x":1}').when(F.col("role") == "assistant", '{"type":"reply","a":1}').otherwise('{"type":"note"}')
    return I.schema_fingerprint(_log_lines(spark, d, F.lit('{"type":"note"}'), kind))


@query(
    "A8_run_entries",
    """WITH x AS (SELECT concat('d', conv_id) AS session_id, turn, role, trim(text) AS text FROM conversations),
e AS (SELECT session_id, turn, 0 AS p, 'user' AS role, text FROM x UNION ALL SELECT session_id, turn, 2, 'note', concat('[reasoning]', chr(10), 'plan ', turn) FROM x
 UNION ALL SELECT session_id, turn, 4, 'assistant', concat('reply ', turn) FROM x)
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, p)-1 AS INTEGER) AS seq, role, text FROM e""",
)
def run_entries(spark, d):
    def entry(kind, body):
        return F.struct(F.lit(kind).alias("entry_type"), F.to_json(F.struct(F.struct(body.alias("text")).alias("data"))).alias("payload"))

    reply = F.concat(F.lit("reply "), "turn")
    entries = F.array(
        entry("request", F.col("text")),
        entry("request", F.concat(F.lit(" "), "text")),
        entry("reasoning", F.concat(F.lit("plan "), "turn")),
        entry("assistant", reply),
        entry("answer", reply),
    )
    rows = _conv(spark, d).select(
        F.concat(F.lit("d"), "conv_id").alias("session_id"), "turn", F.posexplode(entries).alias("part", "e")
    )
    log = rows.select(
        "session_id",
        (F.col("turn") * 5 + F.col("part")).alias("entry_seq"),
        F.concat(F.lit("r"), "turn").alias("run_id"),
        "e.entry_type",
        "e.payload",
        F.lit("2024-01-01 00:00:00").alias("committed_at"),
    )
    return FM.parse_run_entries(log).select("session_id", "seq", "role", "text")


_BLOCKS = f"""SELECT {_KEY} AS session_id, CAST(0 AS INTEGER) AS seq, 'user' AS role, concat('a', chr(10), {{body}}) AS text FROM conversations
UNION ALL SELECT {_KEY}, 1, 'note', {{note}} FROM conversations UNION ALL SELECT {_KEY}, 2, {{last}} FROM conversations"""


@query("A9_speech_blocks", _BLOCKS.format(body="trim(text)", note="concat('[search] ', role)", last="'user', 'after'"))
def speech_blocks(spark, d):
    blk = lambda kind, **f: F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in f.items()]))
    parts = F.concat_ws(
        ",", blk("text", msg=F.lit("a")), blk("text", msg=_trim(F.col("text"))), blk("searchGuid", title=F.col("role")), blk("weird", q=F.lit("1")), blk("text", msg=F.lit("after"))
    )
    doc = F.concat(F.lit('{"id":"'), "key", F.lit('","convs":[{"speaker":"human","createTime":"2024-01-01 00:00:00","speechesV2":[{"content":['), parts, F.lit("]}]}]}"))
    return FM.parse_speech_blocks(_conv(spark, d).select(doc.alias("doc"))).select("session_id", "seq", "role", "text")


@query(
    "A9_unknown_blocks",
    """SELECT role AS type, count(*) AS n FROM conversations GROUP BY role""",
)
def unknown_blocks(spark, d):
    doc = F.concat(F.lit('{"id":"'), "key", F.lit('","convs":[{"speaker":"human","speechesV2":[{"content":[{"type":"text","msg":"a"},{"type":"'), "role", F.lit('"}]}]}]}'))
    return FM.unknown_blocks(_conv(spark, d).select(doc.alias("doc")))


@query("A9_round_blocks", _BLOCKS.format(body="text", note="concat('[think] ', role)", last="'assistant', 'answer'"))
def round_blocks(spark, d):
    blk = lambda mime, body: F.struct(F.lit(mime).alias("mime_type"), body.alias("content"))
    rounds = F.struct(
        F.lit("2024-01-01 00:00:00").alias("created_at"),
        F.array(blk("text/plain", F.lit("a")), blk("text/plain", F.col("text"))).alias("request_messages"),
        F.array(blk("plan_cot/post", F.col("role")), blk("multi_load/iframe", F.lit("answer"))).alias("response_messages"),
    )
    docs = _conv(spark, d).select(F.to_json(F.struct(F.col("key").alias("id"), F.array(rounds).alias("rounds"))).alias("doc"))
    return FM.parse_round_blocks(docs).select("session_id", "seq", "role", "text")


@query("A9_numbered_blocks", _BLOCKS.format(body="trim(text)", note="concat('[think] ', role)", last="'user', 'after'"))
def numbered_blocks(spark, d):
    words = lambda body: F.struct(F.lit(10000).alias("block_type"), F.struct(F.struct(body.alias("text")).alias("text_block")).alias("content"))
    think = F.struct(F.lit(10040).alias("block_type"), F.struct(F.struct(F.col("role").alias("finish_title")).alias("thinking_block")).alias("content"))
    blocks = F.concat_ws(",", *[F.to_json(b) for b in (words(F.lit("a")), words(F.col("text")), think, words(F.lit("after")))])
    doc = F.concat(F.lit('{"id":"'), "key", F.lit('","messages":[{"user_type":1,"create_time":"2024-01-01 00:00:00","content_block":['), blocks, F.lit("]}]}"))
    return FM.parse_numbered_blocks(_conv(spark, d).select(doc.alias("doc"))).select("session_id", "seq", "role", "text")


@query(
    "A10_daily_logs",
    """SELECT concat(role, '::2024-01-0', turn+1) AS session_id, 0 AS seq, 'assistant' AS role, concat('2024-01-0', turn+1) AS ts, text FROM conversations""",
)
def daily_logs(spark, d):
    file = F.concat(F.lit("/logs/"), "role", F.lit("/memory/2024-01-0"), F.col("turn") + 1, F.lit(".md"))
    return FM.daily_log_messages(_conv(spark, d).select(file.alias("file"), F.col("text").alias("value")), "/logs").drop("raw")


@query(
    "A11_unpivoted_turns",
    """WITH m AS (SELECT concat('d', conv_id) AS session_id, turn, 0 AS p, 'user' AS role, text FROM conversations WHERE role<>'assistant'
UNION ALL SELECT concat('d', conv_id), turn, 1, 'assistant', text FROM conversations WHERE role<>'user')
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, p)-1 AS INTEGER) AS seq, role, text FROM m""",
)
def unpivoted_turns(spark, d):
    turns = _conv(spark, d).select(
        F.concat(F.lit("d"), "conv_id").alias("session_id"),
        F.col("turn").alias("turn_no"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("user_message"),
        F.when(F.col("role") != "user", F.col("text")).alias("assistant_response"),
        F.lit(None).cast("string").alias("ts"),
    )
    return FM.unpivot_turns(turns).select("session_id", "seq", "role", "text")


def _traces(spark, d):
    span = F.struct(F.col("event_type").alias("type"), F.lit("ok").alias("status"), F.col("value").alias("duration"), F.concat(F.lit("t"), "user_id").alias("toolName"))
    doc = F.when(F.col("event_type") == "signup", "{broken").otherwise(F.to_json(F.struct(F.array(span, span).alias("spans"))))
    return schemas.read_table(spark, d, "events").select(F.col("event_id").cast("string").alias("file"), doc.alias("doc"))


@query("A12_trace_spans", "SELECT event_type AS type, value AS duration, concat('t', user_id) AS tool, count(*)*2 AS n FROM events WHERE event_type<>'signup' GROUP BY ALL")
def trace_spans(spark, d):
    spans = FM.trace_spans(_traces(spark, d))
    return spans.groupBy("type", "duration", F.col("toolName").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "A12_trace_status",
    "SELECT count(*) AS files, count(*) FILTER (WHERE event_type='signup') AS bad_files, count(*) FILTER (WHERE event_type<>'signup')*2 AS spans FROM events",
)
def trace_status(spark, d):
    return FM.trace_status(_traces(spark, d))


# --- records and tables ------------------------------------------------------------------


def _archive(spark, d):
    """Archive records: one per message, with a tool call and its result."""
    message = lambda role, body, raw: F.struct(F.lit(role).alias("role"), body.alias("text"), F.lit("2024-01-01 00:00:00").alias("timestamp"), raw.alias("raw"))
    none = F.lit(None).cast("string")
    call = F.to_json(F.struct(F.lit("tool_call").alias("kind"), F.struct(F.lit("grep").alias("toolName"), F.col("role").alias("input")).alias("data")))
    error = F.struct(F.lit("").alias("code"), F.concat(F.lit("lost "), "turn").alias("message"))
    result = F.to_json(F.struct(F.lit("tool_result").alias("entry_type"), F.struct(F.lit("grep").alias("tool"), F.lit("failed").alias("status"), error.alias("error")).alias("data")))
    messages = F.array(
        message("user", F.concat(F.lit(" "), "text"), none),
        message("note", F.lit("calling"), call),
        message("note", F.lit("  "), result),
        message("system", F.lit("end"), none),
    )
    return _conv(spark, d).select(
        F.lit(None).cast("string").alias("_bad"),
        F.when(F.col("role") == "assistant", "arc").alias("source"),
        F.when(F.col("role") != "system", F.col("key")).alias("session_id"),
        F.col("role").alias("title"),
        F.lit("2024-01-01 00:00:00").alias("created_at"),
        F.concat(F.lit("2024-01-0"), F.col("turn") + 1, F.lit(" 00:00:00")).alias("updated_at"),
        F.lit('{"model":"m1"}').alias("extra"),
        F.when(F.length("text") > 60, messages).alias("messages"),
        F.concat(F.lit("/arc/"), F.when(F.col("role") == "user", "chat/").otherwise(""), F.lit("2024-01/"), "key", F.lit(".json")).alias("file"),
    )


_ARC_SID = f"concat(CASE WHEN role='assistant' THEN 'arc' ELSE '?' END, ':', {_KEY})"


@query("A1_archive_status", "SELECT count(*) AS files, CAST(0 AS BIGINT) AS unreadable, count(*) FILTER (WHERE length(text)<=60) AS not_sessions FROM conversations")
def archive_status(spark, d):
    return FM.archive_status(_archive(spark, d))


@query(
    "A1_archive_records",
    f"""SELECT {_ARC_SID} AS sid, CASE WHEN role='assistant' THEN 'arc' ELSE '?' END AS source, CASE WHEN role='system' THEN '' ELSE {_KEY} END AS session_id,
role AS title, CASE WHEN role='user' THEN 'chat' END AS category, 'm1' AS model FROM conversations WHERE length(text)>60""",
)
def archive_records(spark, d):
    return FM.archive_records(_archive(spark, d), "/arc").select("sid", "source", "session_id", "title", "category", "model")


@query(
    "A15_messages",
    f"""WITH x AS (SELECT {_ARC_SID} AS sid, text FROM conversations WHERE length(text)>60)
SELECT sid, CAST(0 AS INTEGER) AS seq, 'user' AS role, concat(' ', text) AS raw FROM x UNION ALL SELECT sid, 1, 'note', 'calling' FROM x UNION ALL SELECT sid, 2, 'system', 'end' FROM x""",
)
def built_messages(spark, d):
    return I.build_tables(FM.archive_records(_archive(spark, d), "/arc"))[1].select("sid", "seq", "role", "raw")


@query(
    "A15_live_messages",
    f"""WITH x AS (SELECT {_ARC_SID} AS sid, text FROM conversations WHERE length(text)>60)
SELECT sid, CAST(0 AS INTEGER) AS seq, 'user' AS role, trim(text, ' ' || chr(10)) AS raw FROM x UNION ALL SELECT sid, 1, 'note', 'calling' FROM x""",
)
def live_messages(spark, d):
    records = FM.archive_records(_archive(spark, d), "/arc")
    return I.build_tables(records, ("user", "assistant", "note"), strip_raw=True)[1].select("sid", "seq", "role", "raw")


@query(
    "A14_steps",
    f"""WITH x AS (SELECT {_ARC_SID} AS sid, role, turn FROM conversations WHERE length(text)>60)
SELECT sid, CAST(0 AS INTEGER) AS seq, 'grep' AS tool, 'call' AS phase, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS error, role AS detail FROM x
UNION ALL SELECT sid, 1, 'grep', 'result', 'failed', concat('lost ', turn), NULL FROM x""",
)
def built_steps(spark, d):
    return I.build_tables(FM.archive_records(_archive(spark, d), "/arc"))[2].drop("ts")


@query(
    "A16_dominant_model",
    f"""WITH {STEPS}, c AS (SELECT sid, tool AS model, count(*) AS n, min(seq) AS f FROM steps GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, f) AS rn FROM c) SELECT sid, model FROM r WHERE rn=1""",
)
def dominant_model(spark, d):
    return I.dominant_model(store.steps(spark, d).select("sid", "seq", F.col("tool").alias("model")))


@query(
    "A17_outline",
    f"""WITH {SESSIONS} SELECT row_number() OVER (ORDER BY source, updated_at[1:10] DESC, updated_at DESC, sid) AS no, source, sid, title, created_at, updated_at,
CAST(0 AS BIGINT) AS message_count, title AS preview FROM sessions""",
)
def outline(spark, d):
    return I.outline(schemas.sessions_from_events(spark, d), schemas.messages_from_conversations(spark, d))


@query(
    "A17_previews",
    f"""WITH {MESSAGES}, {CONV_SESSIONS} SELECT c.sid, count(*) FILTER (WHERE role IN ('user','assistant')) AS message_count, title AS preview FROM csessions c JOIN messages USING (sid) GROUP BY ALL""",
)
def previews(spark, d):
    out = I.outline(schemas.sessions_from_conversations(spark, d), schemas.messages_from_conversations(spark, d))
    return out.select("sid", "message_count", "preview")


_LISTED = """l AS (SELECT concat('k', c_custkey) AS sid, c_mktsegment AS source, '1997-01-01' AS stamp FROM customer WHERE c_mktsegment<>'FURNITURE' AND c_acctbal>0),
st AS (SELECT concat('k', c_custkey) AS sid, c_mktsegment AS source, CASE WHEN c_nationkey<12 THEN '1997-01-01' ELSE '1996-01-01' END AS stamp FROM customer WHERE c_acctbal<5000)"""


@query(
    "A19_listing_states",
    f"""WITH {_LISTED} SELECT coalesce(l.sid, st.sid) AS sid, coalesce(l.source, st.source) AS source, CASE WHEN st.sid IS NULL THEN 'new' WHEN l.sid IS NOT NULL AND l.stamp<>st.stamp THEN 'updated'
 WHEN l.sid IS NOT NULL THEN 'unchanged' WHEN st.source='MACHINERY' THEN 'unscanned' WHEN st.source='FURNITURE' THEN 'protected' ELSE 'gone' END AS state FROM l FULL JOIN st ON l.sid=st.sid""",
)
def listing_states(spark, d):
    customers = schemas.read_table(spark, d, "customer").withColumn("sid", F.concat(F.lit("k"), "c_custkey"))
    source = F.col("c_mktsegment").alias("source")
    listed = customers.filter((F.col("c_mktsegment") != "FURNITURE") & (F.col("c_acctbal") > 0)).select(
        "sid", source, F.lit("1997-01-01").alias("updated_at")
    )
    stored = customers.filter(F.col("c_acctbal") < 5000).select(
        "sid", source, F.when(F.col("c_nationkey") < 12, "1997-01-01").otherwise("1996-01-01").alias("updated_at")
    )
    ok = customers.filter(F.col("c_mktsegment") != "MACHINERY").select(source).distinct()
    return I.classify_listing(listed, stored, ok)


@query(
    "A20_upserted_steps",
    f"""WITH {STEPS}, {SESSIONS}, src AS (SELECT s.*, source FROM steps s JOIN sessions USING (sid))
SELECT sid, seq, tool, CASE WHEN source='src1' THEN 'fresh' ELSE status END AS status FROM src WHERE source<>'src2'""",
)
def upserted_steps(spark, d):
    steps = store.steps(spark, d).select("sid", "seq", "tool", "status")
    sessions = schemas.sessions_from_events(spark, d)
    parsed = sessions.filter(F.col("source") == "src1").select("sid")
    changed = steps.join(parsed, "sid", "left_semi").withColumn("status", F.lit("fresh"))
    return I.upsert(steps, changed, parsed, sessions.filter(F.col("source") == "src2").select("sid"))


@query(
    "A20_bucketed_upsert",
    f"""WITH {STEPS}, {SESSIONS}, src AS (SELECT s.*, source FROM steps s JOIN sessions USING (sid))
SELECT sid, seq, tool, CASE WHEN source='src1' THEN 'fresh' ELSE status END AS status FROM src WHERE source<>'src2'""",
)
def bucketed_upsert(spark, d):
    """All sessions are stored in buckets, then those of one source replaced and those of another deleted."""
    steps = store.steps(spark, d).select("sid", "seq", "tool", "status")
    sessions = schemas.sessions_from_events(spark, d)
    tables = BucketedTables(spark, _scratch(spark, "bucketed"), {"steps": "sid string, seq int, tool string, status string"})
    tables.replace({"steps": steps}, sessions)
    parsed = sessions.filter(F.col("source") == "src1")
    changed = steps.join(parsed.select("sid"), "sid", "left_semi").withColumn("status", F.lit("fresh"))
    tables.replace({"steps": changed}, parsed.select("sid").unionByName(sessions.filter(F.col("source") == "src2").select("sid")))
    return tables.read()["steps"]


@query(
    "A21_suppression_counts",
    f"""WITH {STEPS}, {SESSIONS} SELECT sid, CAST(1 AS BIGINT) AS sessions, (SELECT count(*) FROM steps WHERE steps.sid=s.sid) AS steps FROM sessions s WHERE model IS NULL""",
)
def suppression_counts(spark, d):
    sessions = schemas.sessions_from_events(spark, d)
    return I.suppression_counts(sessions.filter(F.col("model").isNull()), sessions=sessions, steps=store.steps(spark, d))


@query(
    "A21_without_suppressed",
    f"""WITH {STEPS}, {SESSIONS} SELECT sid, seq FROM steps WHERE sid IN (SELECT sid FROM sessions WHERE model IS NOT NULL)""",
)
def without_suppressed(spark, d):
    hidden = schemas.sessions_from_events(spark, d).filter(F.col("model").isNull())
    return I.without_suppressed(store.steps(spark, d).select("sid", "seq"), hidden)


@query(
    "A22_staleness",
    f"""WITH {SESSIONS}, w AS (SELECT source, max(updated_at) AS mtime, count(*) AS files FROM sessions GROUP BY source),
r AS (SELECT source, max(updated_at) AS recorded FROM sessions WHERE updated_at<'2024-01-30 12:00' AND source<>'src3' OR source='src0' GROUP BY source)
SELECT w.source, mtime, recorded, mtime>recorded AS stale FROM w LEFT JOIN r USING (source)""",
)
def staleness(spark, d):
    sessions = schemas.sessions_from_events(spark, d).select("source", F.col("updated_at").alias("mtime"))
    older = sessions.filter(((F.col("mtime") < "2024-01-30 12:00") & (F.col("source") != "src3")) | (F.col("source") == "src0"))
    return I.staleness(I.corpus_watermark(sessions), I.corpus_watermark(older))


@query(
    "A23_snapshot_fingerprint",
    f"""WITH {STEPS}, {SESSIONS} SELECT (SELECT count(*) FROM sessions) AS sessions, count(*) AS steps, count(*) FILTER (WHERE status='error') AS errors, false AS stale FROM steps""",
)
def snapshot_fingerprint(spark, d):
    return I.snapshot_fingerprint(schemas.sessions_from_events(spark, d), store.steps(spark, d), False)


def _scratch(spark, name):
    """A new folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- exports -------------------------------------------------------------------------------


def _dated_sessions(spark, d):
    """Conversation sessions with a date told by their length."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.length("title")).cast("string")
    return schemas.sessions_from_conversations(spark, d).withColumn("created_at", F.when(F.length("title") > 40, day))


_DATED = f"""{MESSAGES}, {CONV_SESSIONS}, ds AS (SELECT *, CASE WHEN length(title)>40 THEN CAST(DATE '2024-01-01' + CAST(length(title) AS INTEGER) AS VARCHAR) END AS created_at FROM csessions),
er AS (SELECT sid, seq, role, 'uncategorised' AS category, coalesce(substr(created_at,1,7), 'unknown-date') AS month FROM messages JOIN ds USING (sid)
 WHERE role IN ('user','assistant') AND sid NOT IN (SELECT sid FROM ds WHERE length(title)<30))"""


@query("B1_export_rows", f"WITH {_DATED} SELECT sid, seq, role, category, month FROM er")
def export_rows(spark, d):
    sessions = _dated_sessions(spark, d)
    hidden = sessions.filter(F.length("title") < 30)
    rows = B.export_rows(sessions, schemas.messages_from_conversations(spark, d), suppressed=hidden)
    return rows.select("sid", "seq", "role", "category", "month")


@query("B1_export_manifest", f"WITH {_DATED} SELECT category, month, count(DISTINCT sid) AS sessions, count(*) AS messages FROM er GROUP BY ALL")
def export_manifest(spark, d):
    sessions = _dated_sessions(spark, d)
    hidden = sessions.filter(F.length("title") < 30)
    return B.export_manifest(B.export_rows(sessions, schemas.messages_from_conversations(spark, d), suppressed=hidden))


_CORPUS = f"""{_DATED}, cl AS (SELECT sid, -1 AS seq, concat('<!-- SRC: conv | ', session_id, ' | ', title, ' | ', coalesce(created_at,''), ' -->', chr(10), chr(10), '# ', title, chr(10), chr(10)) AS line FROM ds
 UNION ALL SELECT sid, seq, concat('## [', role, ']', chr(10), chr(10), rtrim(raw, ' ' || chr(10)), chr(10), chr(10)) FROM messages WHERE role IN ('user','assistant'))"""


@query("B2_corpus_lines", f"WITH {_CORPUS} SELECT sid, CAST(seq AS INTEGER) AS seq, line FROM cl")
def corpus_lines(spark, d):
    return B.corpus_lines(_dated_sessions(spark, d), schemas.messages_from_conversations(spark, d))


@query(
    "B2_corpus_totals",
    f"WITH {_CORPUS} SELECT count(*) FILTER (WHERE seq=-1) AS files, CAST(sum(length(line)) + count(*) FILTER (WHERE seq<>-1) AS BIGINT) AS chars FROM cl",
)
def corpus_totals(spark, d):
    return B.corpus_totals(B.corpus_lines(_dated_sessions(spark, d), schemas.messages_from_conversations(spark, d)))


@query("B3_analysis_rows")
def analysis_rows(spark, d):
    steps, sessions = store.steps(spark, d), schemas.sessions_from_events(spark, d)
    tools = O.tool_rows(O.merge_aliases(O.tool_stats(steps)))
    return B.analysis_rows("tools", tools, I.snapshot_fingerprint(sessions, steps), "2024-02-01 00:00:00")


@query(
    "B4_newest_keywords",
    """WITH g AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS gram FROM conversations WHERE role='user')
SELECT gram, count(*) AS freq, count(DISTINCT (conv_id, turn)) AS doc_freq FROM g WHERE length(gram)>=2 GROUP BY gram ORDER BY doc_freq DESC, freq DESC, gram LIMIT 50""",
)
def newest_keywords(spark, d):
    runs = B.KeywordRuns(spark, _scratch(spark, "keywords"))
    messages = schemas.messages_from_conversations(spark, d)
    runs.append(R.keyword_stats(R.text_scope(messages, "assistant"), (2,)))
    runs.append(R.keyword_stats(R.text_scope(messages, "user"), (2, 3)))
    return runs.newest(2).select("gram", "freq", "doc_freq")


@query(
    "S1_latest_records",
    f"""WITH x AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT concat('arc:', conv_id) AS sid, concat('2024-01-0', turn+1) AS updated_at, text FROM x WHERE rn=1""",
)
def latest_records(spark, d):
    from tracewell.streaming.ingest import latest_per_sid

    records = _conv(spark, d).select(
        F.concat(F.lit("arc:"), "conv_id").alias("sid"),
        F.concat(F.lit("2024-01-0"), F.col("turn") + 1).alias("updated_at"),
        F.concat(F.lit("f"), "turn").alias("file"),
        "text",
    )
    return latest_per_sid(records).select("sid", "updated_at", "text")


@query(
    "S1_stream_messages",
    """WITH c AS (SELECT conv_id, turn, role, text, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS again FROM conversations)
SELECT concat('live:', conv_id) AS sid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, role,
  CASE WHEN again THEN concat('again ', text) ELSE text END AS raw FROM c""",
)
def stream_messages(spark, d):
    """Conversations arrive as archive files; those with a system turn are exported anew after the first have been merged."""
    from tracewell.streaming import ingest as live

    place = _scratch(spark, "stream")
    turns = _conv(spark, d).select("conv_id", "turn", "role", "text")

    def arrive(rows, wave, stamp, body):
        said = F.struct("turn", "role", body.alias("text"))
        records = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("messages"))
        files = records.select(F.lit("live").alias("source"), F.col("conv_id").cast("string").alias("session_id"), F.lit(stamp).alias("updated_at"), "messages")
        files.write.option("maxRecordsPerFile", 1).json(f"{place}/inbox/{wave}")  # an archive holds a file a session
        live.start_ingestion(spark, f"{place}/inbox", f"{place}/store", f"{place}/progress", max_files=100_000).awaitTermination()

    arrive(turns, "first", "2024-01-01", F.col("text"))
    live.compact(spark, f"{place}/store")
    again = turns.join(turns.filter("role = 'system'").select("conv_id").distinct(), "conv_id", "left_semi")
    arrive(again, "second", "2024-01-02", F.concat(F.lit("again "), "text"))
    live.compact(spark, f"{place}/store")
    return live.current_tables(spark, f"{place}/store")["messages"].select("sid", "seq", "role", "raw")
