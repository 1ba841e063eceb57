"""Readers for exported session histories.

Every parser takes a DataFrame of raw JSON text and gives message rows
(session_id, seq, role, ts, text, raw).  Trees and patch logs are the only
places where a small vectorised Python helper walks one document; everything
else is Spark expressions.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import text
from tracewell.plans.scan import Running, in_one_block, running_scan, seq_block
from tracewell.session import materialize

MESSAGE_COLS = ("session_id", "seq", "role", "ts", "text", "raw")


def _js(col: str | Column, path: str) -> Column:
    return F.get_json_object(F.col(col) if isinstance(col, str) else col, path)


def _clean(col: Column) -> Column:
    return text.normalize_newlines(col)


def number_messages(rows: DataFrame, *order: str, whole: bool | None = None) -> DataFrame:
    """Keep non-blank texts and number them per session by the order columns."""
    kept = rows.filter(text.strip(F.coalesce("text", F.lit(""))) != "")
    dense = running_scan(kept, ["session_id"], list(order), seq_block(order[0]), {"nth": Running("sum", F.lit(1))}, whole)
    return dense.withColumn("seq", (F.col("nth") - 1).cast("int")).select(*MESSAGE_COLS)


# --- lines of large files ------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line; files are split, so line order is rebuilt from block offsets."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )
    numbered = running_scan(rows, ["file"], ["block", "row_id"], F.col("block"), {"nth": Running("sum", F.lit(1))})
    return numbered.select("file", (F.col("nth") - 1).alias("line_no"), "value")


def json_lines(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Parse JSON lines; unparseable ones keep a null ``o``."""
    return lines.select("file", "line_no", "value", F.from_json("value", schema).alias("o"))


# --- archive ----------------------------------------------------------------------------

ARCHIVE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("source", "session_id", "title", "created_at", "updated_at", "extra")],
        T.StructField(
            "messages",
            T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("role", "text", "timestamp", "raw")])),
        ),
        T.StructField("_bad", T.StringType()),
    ]
)


def read_archive(spark: SparkSession, path: str, manifest: str = "export_manifest.json") -> DataFrame:
    """Archive JSON files with their path; unreadable ones keep their text in ``_bad``."""
    rows = (
        spark.read.schema(ARCHIVE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    return rows.filter(~F.col("file").endswith("/" + manifest))


def archive_status(archive: DataFrame) -> DataFrame:
    """Files read, unreadable, and not a session."""
    bad = F.col("_bad").isNotNull()
    return archive.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(bad).alias("unreadable"),
        F.count_if(~bad & F.col("messages").isNull()).alias("not_sessions"),
    )


def archive_records(archive: DataFrame, root: str | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Session records: sid, session fields, category (first folder of three or more parts), messages."""
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    good = archive.filter(F.col("_bad").isNull() & F.col("messages").isNotNull())
    source = F.coalesce("source", F.lit("?"))
    category = F.lit(None).cast("string")
    if root is not None:
        inside = F.split(F.substring_index("file", root.rstrip("/") + "/", -1), "/")
        category = F.when(F.size(inside) >= 3, F.get(inside, F.lit(0)))
    out = good.select(
        F.concat(source, F.lit(":"), F.coalesce("session_id", stem)).alias("sid"),
        source.alias("source"),
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        category.alias("category"),
        "created_at",
        "updated_at",
        "file",
        _js("extra", "$.model").alias("model"),
        "messages",
    )
    return out if skip is None else out.join(skip.select("sid").distinct(), "sid", "left_anti")


# --- chat exports -----------------------------------------------------------------------

_NODE = "struct<parent:string,children:array<string>,message:string>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _root_path(current: pd.Series, ids: pd.Series, parents: pd.Series) -> pd.Series:
    """Node ids from the root to the current node; stops at a repeated node."""

    def walk(node, keys, ups):
        up = dict(zip(keys, ups)) if keys is not None else {}
        path, seen = [], set()
        while node is not None and node in up and node not in seen:
            seen.add(node)
            path.append(node)
            node = up[node]
        return path[::-1]

    return pd.Series([walk(c, i, p) for c, i, p in zip(current, ids, parents)])


def parse_tree_chat(docs: DataFrame) -> DataFrame:
    """Exports with ``mapping`` and ``current_node``: the path to the current node.

    Hidden and system nodes are dropped, tool output becomes a note.
    """
    schema = f"struct<id:string,conversation_id:string,current_node:string,mapping:map<string,{_NODE}>>"
    parsed = docs.select(F.from_json("doc", schema).alias("c")).filter(F.col("c.mapping").isNotNull())
    keys = F.map_keys("c.mapping")
    parents = F.transform(F.map_values("c.mapping"), lambda n: n["parent"])
    paths = parsed.select(
        F.coalesce("c.id", "c.conversation_id").alias("session_id"),
        F.col("c.mapping").alias("mapping"),
        F.posexplode(_root_path(F.col("c.current_node"), keys, parents)).alias("pos", "node"),
    )
    nodes = paths.select("session_id", "pos", F.element_at("mapping", F.col("node"))["message"].alias("raw"))
    role = _js("raw", "$.author.role")
    kind = _js("raw", "$.content.content_type")
    parts = F.from_json(_js("raw", "$.content.parts"), "array<string>")
    said = F.array_join(F.filter(parts, lambda p: p.isNotNull() & ~p.startswith("{")), "\n")
    body = F.when(kind == "code", _js("raw", "$.content.text")).when(kind.isin("text", "multimodal_text"), said)
    hidden = F.coalesce(_js("raw", "$.metadata.is_visually_hidden_from_conversation") == "true", F.lit(False))
    stamp = _js("raw", "$.create_time")
    rows = nodes.filter(F.col("raw").isNotNull() & ~hidden & role.isin("user", "assistant", "tool")).select(
        "session_id",
        "pos",
        F.when(role == "tool", "note").otherwise(role).alias("role"),
        F.when(stamp.rlike(r"^[0-9.eE+]+$"), text.numeric_to_local_ts(stamp)).otherwise(text.to_local_ts(stamp)).alias("ts"),
        F.when((role == "tool") & (body != ""), F.concat(F.lit("[tool]\n"), body)).otherwise(body).alias("text"),
        "raw",
    )
    return number_messages(rows.withColumn("text", _clean(F.col("text"))), "pos")


def parse_linear_chat(docs: DataFrame) -> DataFrame:
    """Exports with a ``chat_messages`` array; unknown senders are dropped."""
    item = "array<string>"
    rows = docs.select(
        _js("doc", "$.uuid").alias("session_id"), F.posexplode(F.from_json(_js("doc", "$.chat_messages"), item)).alias("pos", "raw")
    )
    sender = _js("raw", "$.sender")
    blocks = F.from_json(_js("raw", "$.content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    own = _js("raw", "$.text")
    body = F.when(text.strip(F.coalesce(own, F.lit(""))) != "", own).otherwise(joined)
    return number_messages(
        rows.filter(sender.isin("human", "assistant")).select(
            "session_id",
            "pos",
            F.when(sender == "human", "user").otherwise("assistant").alias("role"),
            text.to_local_ts(_js("raw", "$.created_at")).alias("ts"),
            _clean(body).alias("text"),
            "raw",
        ),
        "pos",
    )


#: Documents that a helper holds as Python objects at a time, whatever the size of a batch.
SLICE_DOCS = 256
_THREAD = T.StructType([T.StructField("thread", T.ArrayType(T.StringType())), T.StructField("branch_points", T.IntegerType())])


@F.arrow_udf(_THREAD)
def _latest_thread(ids: pa.Array, children: pa.Array, stamps: pa.Array, places: pa.Array) -> pa.Array:
    """Root-to-leaf walk; at a branch the child with the latest stamp in its subtree, then the higher place, then the last."""

    def walk(keys, kids, times, order):
        known = set(keys)
        links = {k: [c for c in (ch if ch is not None else []) if c in known] for k, ch in zip(keys, kids)}
        place = dict(zip(keys, order))
        latest = {k: t or "" for k, t in zip(keys, times)}
        visited = dict.fromkeys(["root"])
        frontier = ["root"]
        while frontier:
            frontier = [c for k in frontier for c in links.get(k, []) if c not in visited and visited.setdefault(c) is None]
        for key in reversed(visited):  # children come after parents, level by level
            latest[key] = max([latest.get(key, ""), *(latest[c] for c in links.get(key, []))])

        thread, branches, node = [], 0, "root"
        while options := links.get(node):
            branches += len(options) > 1
            node = max(enumerate(options), key=lambda o: (latest[o[1]], place[o[1]], o[0]))[1]
            if node == "root" or node in thread:
                break
            thread.append(node)
        return thread, branches

    kind = pa.struct([("thread", pa.list_(pa.string())), ("branch_points", pa.int32())])
    parts = [pa.array([], kind)]
    for at in range(0, len(ids), SLICE_DOCS):
        held = zip(*(column.slice(at, SLICE_DOCS).to_pylist() for column in (ids, children, stamps, places)))
        rows = [walk(i, c, s, p) if i is not None else ([], 0) for i, c, s, p in held]
        parts.append(pa.array([{"thread": thread, "branch_points": branches} for thread, branches in rows], kind))
    return pa.concat_arrays(parts)


#: The planner may not repeat the walk in a filter before the threads are exploded: a task has one Python worker, not two.
_latest_thread = _latest_thread.asNondeterministic()


def tree_threads(docs: DataFrame) -> DataFrame:
    """(session_id, mapping, thread, branch_points) for exports with a ``root`` node."""
    schema = f"struct<id:string,mapping:map<string,{_NODE}>>"
    parsed = docs.select(F.from_json("doc", schema).alias("c")).filter(F.map_contains_key("c.mapping", "root"))
    nodes = F.map_values("c.mapping")
    keys = F.map_keys("c.mapping")
    found = _latest_thread(
        keys,
        F.transform(nodes, lambda n: n["children"]),
        F.transform(nodes, lambda n: F.get_json_object(n["message"], "$.inserted_at")),
        F.transform(keys, lambda k: F.coalesce(k.try_cast("long"), F.lit(2**63 - 1))),  # names after all numbers
    )
    return parsed.select(F.col("c.id").alias("session_id"), F.col("c.mapping").alias("mapping"), found.alias("w")).select(
        "session_id", "mapping", "w.thread", "w.branch_points"
    )


def parse_fragment_tree(docs: DataFrame) -> DataFrame:
    """Messages of the chosen thread, one per fragment."""
    nodes = tree_threads(docs).select("session_id", "mapping", F.posexplode("thread").alias("pos", "node"))
    messages = nodes.select("session_id", "pos", F.element_at("mapping", F.col("node"))["message"].alias("raw"))
    fragment = (
        "array<struct<type:string,content:string,files:array<struct<file_name:string,file_size:string>>,"
        "results:array<struct<title:string,url:string>>>>"
    )
    rows = messages.select(
        "session_id", "pos", "raw", F.posexplode(F.from_json(_js("raw", "$.fragments"), fragment)).alias("part", "f")
    )
    kind, content = F.col("f.type"), F.coalesce("f.content", F.lit(""))
    files = F.array_join(
        F.transform("f.files", lambda x: F.concat(F.lit("- "), x["file_name"], F.lit(" ("), x["file_size"], F.lit(" bytes)"))), "\n"
    )
    found = F.array_join(F.transform("f.results", lambda x: F.concat(F.lit("- "), x["title"], F.lit(" — "), x["url"])), "\n")
    body = (
        F.when(kind.isin("REQUEST", "RESPONSE"), content)
        .when((kind == "THINK") & (content != ""), F.concat(F.lit("[think]\n"), content))
        .when((kind == "FILE") & (files != ""), F.concat(F.lit("[FILE]\n"), files))
        .when(kind.isin("SEARCH", "TOOL_SEARCH") & (found != ""), F.concat(F.lit("["), kind, F.lit("] "), F.size("f.results"), F.lit(" results\n"), found))
        .when(kind == "TOOL_OPEN", "[TOOL_OPEN]")
    )
    role = F.when(kind == "REQUEST", "user").when(kind == "RESPONSE", "assistant").otherwise("note")
    stamp = F.when(~kind.isin("THINK", "FILE"), text.to_local_ts(_js("raw", "$.inserted_at")))
    return number_messages(
        rows.select("session_id", "pos", "part", role.alias("role"), stamp.alias("ts"), _clean(body).alias("text"), "raw"),
        "pos",
        "part",
    )


def parse_flat_chat(docs: DataFrame) -> DataFrame:
    """Exports with a plain ``messages`` array; reasoning becomes a note after its message."""
    rows = docs.select(
        _js("doc", "$.id").alias("session_id"), F.posexplode(F.from_json(_js("doc", "$.messages"), "array<string>")).alias("pos", "raw")
    )
    given = F.lower(F.coalesce(_js("raw", "$.role"), F.lit("")))
    role = F.when(given == "user", "user").when(given.isin("assistant", "ai", "bot"), "assistant").when(given == "system", "system")
    stamp = text.to_local_ts(F.coalesce(_js("raw", "$.create_time"), _js("raw", "$.timestamp")))
    thought = F.coalesce(
        *[
            F.when(text.strip(F.coalesce(_js("raw", f"$.{k}"), F.lit(""))) != "", F.concat(F.lit(f"[{k}]\n"), _js("raw", f"$.{k}")))
            for k in ("reasoning_content", "thinking_content")
        ]
    )
    none = F.lit(None).cast("string")
    pair = F.array(
        F.struct(role.alias("role"), stamp.alias("ts"), _js("raw", "$.content").alias("text")),
        F.struct(F.when(role.isNotNull(), F.lit("note")).alias("role"), none.alias("ts"), thought.alias("text")),
    )
    spread = rows.select("session_id", "pos", "raw", F.posexplode(pair).alias("part", "m")).select(
        "session_id", "pos", "part", "m.role", "m.ts", _clean(F.col("m.text")).alias("text"), "raw"
    )
    return number_messages(spread.filter(F.col("role").isNotNull()), "pos", "part")


# --- patch logs ------------------------------------------------------------------------


def _part(holder, key, empty: str, kinds: tuple[type, ...]):
    """What ``holder`` has at ``key``; lists grow up to it, and a map's entry of another kind is replaced."""
    if isinstance(holder, list):
        holder.extend(json.loads(empty) for _ in range(int(key) + 1 - len(holder)))
        return holder[int(key)]
    if not isinstance(holder.get(key), kinds):
        holder[key] = json.loads(empty)
    return holder[key]


def _patched(document, path: list, value, extend: bool) -> None:
    """Set ``value`` at ``path`` of a document, or append it (or its elements) to the list there."""
    *parents, leaf = path
    for key in parents:
        document = _part(document, key, "{}", (dict, list))
    if extend:
        _part(document, leaf, "[]", (list,)).extend(value if isinstance(value, list) else [value])
    elif isinstance(document, list):
        _part(document, leaf, "null", ())
        document[int(leaf)] = value
    elif isinstance(document, dict):
        document[leaf] = value
    else:
        raise TypeError("no place for a value")


@F.pandas_udf(T.StructType([T.StructField("state", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("failed", T.IntegerType())]))
def _replay(logs: pd.Series) -> pd.DataFrame:
    """Fold the patches of one session, which start with its last snapshot: kind 1 sets, kind 2 extends."""

    def fold(lines):
        state, done = None, 0
        for line in lines:
            try:
                patch = json.loads(line)
                if patch.get("kind") == 0:
                    state = patch["v"] if isinstance(patch.get("v"), dict) else {}
                elif state is None:
                    raise ValueError("no snapshot")
                else:
                    _patched(state, patch["k"], patch.get("v"), patch.get("kind") == 2)
                done += 1
            except (ValueError, TypeError, KeyError, IndexError, AttributeError):
                continue
        return None if state is None else json.dumps(state, ensure_ascii=False), done, len(lines) - done

    return pd.DataFrame([fold(x) for x in logs], columns=["state", "applied", "failed"])


def read_patch_logs(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, line_no, value) of every line."""
    stem = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    return read_lines(spark, path).select(stem.alias("session_id"), "line_no", "value")


def log_lines(logs: DataFrame) -> DataFrame:
    """(session_id, line_no, value) from whole logs (session_id, log)."""
    return logs.select("session_id", F.posexplode(F.split(F.coalesce("log", F.lit("")), "\n")).alias("line_no", "value"))


def replay_logs(lines: DataFrame) -> DataFrame:
    """(session_id, state, applied, failed, superseded) of every session with lines.

    A snapshot (kind 0) makes all lines before it pointless: these are counted
    as ``superseded`` and dropped first, so only the rest of a log meets in one
    row.
    """
    given = lines.filter(text.strip(F.coalesce("value", F.lit(""))) != "")
    snapshot = F.when(F.get_json_object("value", "$.kind") == "0", F.col("line_no"))
    last = given.groupBy("session_id").agg(F.max(snapshot).alias("last"))
    placed = given.join(last, "session_id").withColumn("live", F.col("last").isNull() | (F.col("line_no") >= F.col("last")))
    logs = placed.groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("line_no", "value")))).alias("lines"),
        F.count_if(~F.col("live")).alias("superseded"),
    )
    found = logs.select("session_id", "superseded", _replay(F.transform("lines", lambda x: x["value"])).alias("r"))
    zero = F.lit(0)
    return lines.select("session_id").distinct().join(found, "session_id", "left").select(
        "session_id", "r.state", F.coalesce("r.applied", zero).alias("applied"), F.coalesce("r.failed", zero).alias("failed"),
        F.coalesce("superseded", zero).alias("superseded"),
    )


def parse_patch_state(states: DataFrame) -> DataFrame:
    """Requests of a replayed document as user, reasoning, tool-call and assistant messages."""
    reply = "array<struct<kind:string,value:string,toolId:string,invocationMessage:string>>"
    requests = states.select("session_id", F.posexplode(F.from_json(_js("state", "$.requests"), "array<string>")).alias("pos", "raw"))
    asked = F.coalesce(_js("raw", "$.message.text"), F.when(~_js("raw", "$.message").startswith("{"), _js("raw", "$.message")))
    stamp = _js("raw", "$.timestamp")
    stamp = F.when(stamp.rlike(r"^[0-9.eE+]+$"), text.numeric_to_local_ts(stamp)).otherwise(text.to_local_ts(stamp))
    items = F.from_json(_js("raw", "$.response"), reply)
    base = requests.select("session_id", "pos", asked.alias("asked"), stamp.alias("stamp"), items.alias("items"))
    none = F.lit(None).cast("string")

    def note(i: Column) -> Column:
        said = F.coalesce(F.get_json_object(i["invocationMessage"], "$.value"), F.when(~i["invocationMessage"].startswith("{"), i["invocationMessage"]), F.lit(""))
        tool = F.when(F.coalesce(i["toolId"], F.lit("")) != "", i["toolId"]).otherwise(text.head(said, 60))
        raw = F.to_json(F.struct(F.lit("tool_call").alias("kind"), tool.alias("tool"), said.alias("detail")))
        thinking = (i["kind"] == "thinking") & (text.strip(F.coalesce(i["value"], F.lit(""))) != "")
        called = (i["kind"] == "toolInvocationSerialized") & (tool != "")
        return F.struct(
            F.lit("note").alias("role"),
            none.alias("ts"),
            F.when(thinking, F.concat(F.lit("[reasoning]\n"), i["value"])).when(called, F.concat(F.lit("[tool_call] "), tool, F.lit(": "), said)).alias("text"),
            F.when(called, raw).alias("raw"),
        )

    plain = F.filter("items", lambda i: i["kind"].isNull() & (text.strip(F.coalesce(i["value"], F.lit(""))) != ""))
    answer = F.array_join(F.transform(plain, lambda i: i["value"]), "\n")
    parts = F.concat(
        F.array(F.struct(F.lit("user").alias("role"), F.col("stamp").alias("ts"), F.col("asked").alias("text"), none.alias("raw"))),
        F.coalesce(F.transform("items", note), F.array().cast("array<struct<role:string,ts:string,text:string,raw:string>>")),
        F.array(F.struct(F.lit("assistant").alias("role"), none.alias("ts"), text.strip(answer).alias("text"), none.alias("raw"))),
    )
    rows = base.select("session_id", "pos", F.posexplode(parts).alias("part", "m")).select(
        "session_id", "pos", "part", "m.role", "m.ts", _clean(F.col("m.text")).alias("text"), "m.raw"
    )
    return number_messages(rows, "pos", "part")


# --- line logs ---------------------------------------------------------------------------


def _tool_names(rows: DataFrame) -> DataFrame:
    """Name of the latest call with the same call id, by line."""
    marked = rows.filter(F.col("call_id").isNotNull()).select("session_id", "line_no", "call_id", "called")
    scanned = running_scan(marked, ["session_id", "call_id"], ["line_no"], seq_block("line_no"), {"tool": Running("last", F.col("called"))})
    return scanned.select("session_id", "line_no", F.col("tool").alias("call_tool"))


def parse_transcript(lines: DataFrame) -> DataFrame:
    """Transcript lines (session_id, line_no, value): messages, reasoning, calls and results."""
    kind = _js("value", "$.type")
    rows = lines.select("session_id", "line_no", "value", kind.alias("type"))
    called = F.when(F.col("type") == "function_call", F.coalesce(_js("value", "$.name"), F.lit("?")))
    keyed = rows.withColumn("called", called).withColumn(
        "call_id", F.when(F.col("type").isin("function_call", "function_call_result"), F.coalesce(_js("value", "$.callId"), F.lit("")))
    )
    named = keyed.join(_tool_names(keyed), ["session_id", "line_no"], "left")
    blocks = F.from_json(_js("value", "$.content"), "array<struct<text:string>>")
    said = text.strip(_clean(F.array_join(F.transform(blocks, lambda b: b["text"]), "")))
    role = _js("value", "$.role")
    query_shape = r"(?s)<user_query>(.*?)</user_query>"
    asked = F.when(said.rlike(query_shape), text.strip(F.regexp_extract(said, query_shape, 1))).otherwise(said)
    context = F.when(said.rlike(query_shape), text.strip(F.regexp_replace(said, query_shape, "")))
    stamp = _js("value", "$.timestamp")
    stamp = F.when(stamp.rlike(r"^[0-9.]+$"), text.numeric_to_local_ts(stamp)).otherwise(text.to_local_ts(stamp))
    args = F.coalesce(_js("value", "$.arguments"), F.lit(""))
    output = F.coalesce(_js("value", "$.output.text"), F.when(~_js("value", "$.output").startswith("{"), _js("value", "$.output")), F.lit(""))
    output = text.strip(_clean(output))
    failed = F.lower(output).startswith("error")
    preview = F.concat(text.head(output, 400), F.when(F.length(output) > 400, "…").otherwise(""))
    tool = F.coalesce(_js("value", "$.name"), "call_tool", F.lit("?"))
    status = F.when(failed, "error").otherwise(F.coalesce(_js("value", "$.status"), F.lit("completed")))
    none = F.lit(None).cast("string")

    def msg(role: Column | str, body: Column, raw: Column = none) -> Column:
        return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), body.alias("text"), raw.alias("raw"))

    call_raw = F.to_json(F.struct(F.lit("tool_call").alias("kind"), F.col("called").alias("tool"), args.alias("detail")))
    result_raw = F.to_json(
        F.struct(F.lit("tool_result").alias("kind"), tool.alias("tool"), status.alias("status"), F.when(failed, output).alias("error"))
    )
    is_type = F.col("type")
    parts = (
        F.when((is_type == "message") & (role == "user"), F.array(msg("note", F.concat(F.lit("[context] "), F.nullif(context, F.lit("")))), msg("user", asked)))
        .when((is_type == "message") & (role == "assistant"), F.array(msg("assistant", said)))
        .when((is_type == "reasoning") & (said != ""), F.array(msg("note", F.concat(F.lit("[reasoning] "), said))))
        .when(is_type == "function_call", F.array(msg("note", F.concat(F.lit("[tool_call] "), "called", F.lit(": "), text.head(args, 200)), call_raw)))
        .when(
            is_type == "function_call_result",
            F.array(msg("note", F.concat(F.lit("[tool_result] "), tool, F.lit(": "), status, F.when(failed, F.concat(F.lit("; "), preview)).otherwise("")), result_raw)),
        )
    )
    spread = named.select("session_id", "line_no", stamp.alias("ts"), F.posexplode(parts).alias("part", "m")).select(
        "session_id", "line_no", "part", "ts", "m.role", "m.text", "m.raw"
    )
    return number_messages(spread, "line_no", "part")


def parse_event_log(lines: DataFrame) -> DataFrame:
    """Event lines (session_id, line_no, value): user, assistant, tool and policy events."""
    rows = lines.select("session_id", "line_no", "value", _js("value", "$.type").alias("type"))
    called = F.when(F.col("type") == "tool/call", F.coalesce(_js("value", "$.data.name"), F.lit("?")))
    call_id = F.when(F.col("type") == "tool/call", _js("value", "$.data.callId")).when(
        F.col("type") == "tool/result", _js("value", "$.data.message.toolCallId")
    )
    keyed = rows.withColumn("called", called).withColumn("call_id", F.nullif(call_id, F.lit("")))
    named = keyed.join(_tool_names(keyed), ["session_id", "line_no"], "left")
    ms = _js("value", "$.time").try_cast("double")
    stamp = F.when(ms > 0, text.numeric_to_local_ts(ms / 1000))
    blocks_of = "array<struct<type:string,text:string>>"

    def joined(path: str) -> Column:
        return text.strip(_clean(F.array_join(F.transform(F.from_json(_js("value", path), blocks_of), lambda b: b["text"]), "")))

    none = F.lit(None).cast("string")

    def msg(role: str, body: Column, raw: Column = none) -> Column:
        return F.struct(F.lit(role).alias("role"), body.alias("text"), raw.alias("raw"))

    replies = F.transform(
        F.from_json(_js("value", "$.data.message.content"), blocks_of),
        lambda b: F.struct(
            F.when(b["type"] == "text", "assistant").otherwise("note").alias("role"),
            F.when(text.strip(F.coalesce(b["text"], F.lit(""))) == "", none)
            .when(b["type"] == "reasoning", F.concat(F.lit("[reasoning] "), text.strip(b["text"])))
            .when(b["type"] == "text", text.strip(b["text"]))
            .alias("text"),
            none.alias("raw"),
        ),
    )
    args = F.coalesce(_js("value", "$.data.arguments"), F.lit(""))
    result = joined("$.data.message.content")
    flag = _js("value", "$.data.message.isError")
    failed = F.when(flag.isin("true", "1"), True).when(flag.isin("false", "0"), False).otherwise(F.lower(result).startswith("error"))
    preview = F.concat(text.head(result, 400), F.when(F.length(result) > 400, "…").otherwise(""))
    detail = F.nullif(
        F.concat_ws(" / ", F.nullif(_js("value", "$.data.error.code"), F.lit("")), F.nullif(_js("value", "$.data.error.message"), F.lit(""))), F.lit("")
    )
    tool = F.coalesce("call_tool", F.lit("unknown"))
    status = F.when(failed, "error").otherwise("completed")
    call_raw = F.to_json(F.struct(F.lit("tool_call").alias("kind"), F.col("called").alias("tool"), args.alias("detail")))
    result_raw = F.to_json(
        F.struct(
            F.lit("tool_result").alias("kind"), tool.alias("tool"), status.alias("status"), F.when(failed, F.coalesce(detail, result)).alias("error")
        )
    )
    kind = F.col("type")
    parts = (
        F.when(kind == "user/message", F.array(msg("user", joined("$.data.content"))))
        .when(kind == "assistant/message", replies)
        .when(kind.isin("approval/policy", "sandbox/mode", "permission/preset"), F.array(msg("note", F.concat(F.lit("[policy] "), kind, F.lit(" "), F.coalesce(_js("value", "$.data"), F.lit(""))))))
        .when(kind == "tool/call", F.array(msg("note", F.concat(F.lit("[tool_call] "), "called", F.lit(": "), text.head(args, 200)), call_raw)))
        .when(
            kind == "tool/result",
            F.array(msg("note", F.concat(F.lit("[tool_result] "), tool, F.lit(": "), status, F.when(failed, F.concat(F.lit("; "), preview)).otherwise("")), result_raw)),
        )
    )
    spread = named.select("session_id", "line_no", stamp.alias("ts"), F.posexplode(parts).alias("part", "m")).select(
        "session_id", "line_no", "part", "ts", "m.role", "m.text", "m.raw"
    )
    return number_messages(spread, "line_no", "part")


def parse_run_entries(entries: DataFrame) -> DataFrame:
    """Run entries (session_id, entry_seq, run_id, entry_type, payload, committed_at) with repeats removed.

    A request equal to the one before it with no answer between is dropped; an
    answer replaces equal assistant texts since the last request; reasoning
    keeps only its CJK variants when a run holds both kinds.
    """
    body = text.strip(F.coalesce(_js("payload", "$.data.text"), F.lit("")))
    rows = entries.select("session_id", "entry_seq", "run_id", "entry_type", "payload", "committed_at", body.alias("body")).withColumn(
        "key", text.fold(_clean(F.col("body")))
    )
    spoken = rows.filter(~(F.col("entry_type").isin("request", "answer", "assistant", "reasoning") & (F.col("body") == "")))
    order, block = ["entry_seq"], seq_block("entry_seq")
    whole = in_one_block(entries, block)
    runs = running_scan(spoken, ["session_id"], order, block, {"b": Running("prev", F.struct("run_id"))}, whole)
    changed = F.when(F.col("b").isNotNull() & F.col("b.run_id").eqNullSafe(F.col("run_id")), 0).otherwise(1)
    numbered = running_scan(
        runs.withColumn("changed", changed).drop("b"),
        ["session_id"],
        order,
        block,
        {
            "run_no": Running("sum", F.col("changed")),
            "answers": Running("sum", F.when(F.col("entry_type") == "answer", 1).otherwise(0)),
        },
        whole,
    )
    numbered = materialize(numbered)  # read for the repeated requests and for all rows
    requests = running_scan(
        numbered.filter(F.col("entry_type") == "request").select("session_id", "entry_seq", "key", "answers"),
        ["session_id"],
        order,
        block,
        {"b": Running("prev", F.struct("key", "answers"))},
        whole,
    )
    repeated = requests.filter((F.col("b.key") == F.col("key")) & (F.col("b.answers") == F.col("answers"))).select("session_id", "entry_seq")
    kept = numbered.join(repeated, ["session_id", "entry_seq"], "left_anti")
    blocks = running_scan(
        kept, ["session_id"], order, block, {"turn": Running("sum", F.when(F.col("entry_type") == "request", 1).otherwise(0))}, whole
    )
    blocks = materialize(blocks)  # read for last answers, for variants and for all rows
    last_answer = (
        blocks.filter(F.col("entry_type") == "answer")
        .groupBy("session_id", "turn", "key")
        .agg(F.max("entry_seq").alias("last_answer"))
    )
    share = F.length(F.col("body")) - F.length(F.regexp_replace("body", r"[\u4e00-\u9fff]", ""))
    is_cjk = share / F.greatest(F.length("body"), F.lit(1)) >= 0.05
    variants = (
        blocks.filter(F.col("entry_type") == "reasoning")
        .groupBy("session_id", "run_no")
        .agg(F.max(F.when(is_cjk, 1).otherwise(0)).alias("any_cjk"))
    )
    joined = blocks.join(last_answer, ["session_id", "turn", "key"], "left").join(variants, ["session_id", "run_no"], "left")
    kind = F.col("entry_type")
    replaced = kind.isin("assistant", "answer") & F.coalesce(F.col("entry_seq") < F.col("last_answer"), F.lit(False))
    foreign = (kind == "reasoning") & (F.coalesce("any_cjk", F.lit(0)) == 1) & ~is_cjk
    tool = F.coalesce(_js("payload", "$.data.toolName"), _js("payload", "$.data.tool"), F.lit("unknown"))
    inp = F.coalesce(_js("payload", "$.data.input"), F.lit("null"))
    status = F.coalesce(_js("payload", "$.data.status"), F.lit("unknown"))
    err = F.coalesce(
        F.nullif(_js("payload", "$.data.error.code"), F.lit("")),
        F.nullif(_js("payload", "$.data.error.message"), F.lit("")),
        F.when(~_js("payload", "$.data.error").startswith("{"), _js("payload", "$.data.error")),
        F.nullif(text.head(_js("payload", "$.data.content"), 120), F.lit("")),
    )
    shown = (
        F.when(kind.isin("request", "assistant", "answer"), F.col("body"))
        .when(kind == "reasoning", F.concat(F.lit("[reasoning]\n"), "body"))
        .when(kind == "tool_call", F.concat(F.lit("[tool_call] "), tool, F.lit(": "), text.head(inp, 300), F.when(F.length(inp) > 300, "…").otherwise("")))
        .when(
            kind == "tool_result",
            F.concat(F.lit("[tool_result] "), tool, F.lit(": "), status, F.when((status != "success") & err.isNotNull(), F.concat(F.lit(" "), err)).otherwise("")),
        )
    )
    role = F.when(kind == "request", "user").when(kind.isin("assistant", "answer"), "assistant").otherwise("note")
    return number_messages(
        joined.filter(~replaced & ~foreign).select(
            "session_id", "entry_seq", role.alias("role"), text.to_local_ts("committed_at").alias("ts"), shown.alias("text"), F.col("payload").alias("raw")
        ),
        "entry_seq",
        whole=whole,
    )


# --- block lists ----------------------------------------------------------------------------


def merge_text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (session_id, turn_no, block_no, speaker, is_text, ts, text): neighbouring texts become one message.

    Islands of text inside a turn; a turn is one record of the export.
    """
    filled = blocks.filter(F.coalesce("text", F.lit("")) != "")
    order = ["block_no"]
    scanned = running_scan(
        filled,
        ["session_id", "turn_no"],
        order,
        seq_block("block_no"),
        {"island": Running("sum", F.when(F.col("is_text"), 0).otherwise(1))},
    )
    texts = (
        scanned.filter("is_text")
        .groupBy("session_id", "turn_no", "island", "speaker", "ts")
        .agg(F.min("block_no").alias("block_no"), F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("parts"))
        .select(
            "session_id", "turn_no", "block_no", F.col("speaker").alias("role"), "ts",
            F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
        )
    )
    notes = scanned.filter(~F.col("is_text")).select("session_id", "turn_no", "block_no", F.lit("note").alias("role"), "ts", "text")
    both = texts.unionByName(notes).withColumn("raw", F.to_json(F.struct(F.col("role").alias("kind"))))
    return number_messages(both.withColumn("text", _clean(F.col("text"))), "turn_no", "block_no")


def parse_speech_blocks(docs: DataFrame) -> DataFrame:
    """Layout one: turns with ``speechesV2[].content[]`` blocks, newest turn first in the export."""
    turns = docs.select(_js("doc", "$.id").alias("session_id"), F.posexplode(F.from_json(_js("doc", "$.convs"), "array<string>")).alias("turn_no", "turn"))
    speeches = F.from_json(_js("turn", "$.speechesV2"), "array<struct<content:array<string>>>")
    blocks = turns.select(
        "session_id",
        "turn_no",
        F.when(_js("turn", "$.speaker") == "human", "user").when(_js("turn", "$.speaker") == "ai", "assistant").alias("speaker"),
        text.to_local_ts(_js("turn", "$.createTime")).alias("ts"),
        F.posexplode(F.flatten(F.transform(speeches, lambda s: F.coalesce(s["content"], F.array().cast("array<string>"))))).alias("block_no", "b"),
    ).filter(F.col("speaker").isNotNull())
    kind = _js("b", "$.type")
    note = (
        F.when(kind == "searchGuid", F.concat(F.lit("[search] "), F.coalesce(_js("b", "$.title"), F.lit("search"))))
        .when(kind.isin("deepSearch", "deepSearchAgent"), F.concat(F.lit("[think] "), F.coalesce(_js("b", "$.title"), F.lit("thinking"))))
        .when(kind == "pdf", F.concat(F.lit("[file] "), _js("b", "$.fileName")))
        .when(kind == "image", F.concat(F.lit("[image] "), _js("b", "$.fileName")))
        .when(kind == "step", F.concat(F.lit("[step] "), _js("b", "$.msg")))
        .when(kind == "doc_percent", F.concat(F.lit("[notice] "), _js("b", "$.content")))
        .when(kind.isin("prompt_url_card", "link_card"), F.concat(F.lit("[card] "), F.coalesce(_js("b", "$.desc"), _js("b", "$.content"), F.lit(""))))
        .when(kind == "drawWithSearchGuid", F.concat(F.lit("[draw] "), F.coalesce(_js("b", "$.prompt"), _js("b", "$.botPrompt"))))
    )
    said = F.coalesce(_js("b", "$.msg"), _js("b", "$.text"), _js("b", "$.content"))
    return merge_text_blocks(
        blocks.select("session_id", "turn_no", "block_no", "speaker", "ts", (kind == "text").alias("is_text"), F.when(kind == "text", said).otherwise(note).alias("text"))
    )


def unknown_blocks(docs: DataFrame) -> DataFrame:
    """Block types without a rule, counted instead of guessed."""
    known = ("text", "searchGuid", "deepSearch", "deepSearchAgent", "pdf", "image", "step", "doc_percent", "prompt_url_card", "link_card", "drawWithSearchGuid")
    turns = docs.select(F.explode(F.from_json(_js("doc", "$.convs"), "array<string>")).alias("turn"))
    speeches = F.from_json(_js("turn", "$.speechesV2"), "array<struct<content:array<string>>>")
    kinds = turns.select(F.explode(F.flatten(F.transform(speeches, lambda s: s["content"]))).alias("b")).select(_js("b", "$.type").alias("type"))
    return kinds.filter(~F.coalesce("type", F.lit("")).isin(*known)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def parse_round_blocks(docs: DataFrame) -> DataFrame:
    """Layout two: rounds with request and response message lists."""
    rounds = docs.select(_js("doc", "$.id").alias("session_id"), F.posexplode(F.from_json(_js("doc", "$.rounds"), "array<string>")).alias("turn_no", "r"))
    item = "array<struct<mime_type:string,content:string,meta_data:string>>"
    asked = F.transform(F.from_json(_js("r", "$.request_messages"), item), lambda b: F.struct(F.lit("user").alias("speaker"), b.alias("b")))
    said = F.transform(F.from_json(_js("r", "$.response_messages"), item), lambda b: F.struct(F.lit("assistant").alias("speaker"), b.alias("b")))
    empty = F.array().cast("array<struct<speaker:string,b:struct<mime_type:string,content:string,meta_data:string>>>")
    both = F.concat(F.coalesce(asked, empty), F.coalesce(said, empty))
    blocks = rounds.select("session_id", "turn_no", text.to_local_ts(_js("r", "$.created_at")).alias("ts"), F.posexplode(both).alias("block_no", "x"))
    mime = F.col("x.b.mime_type")
    names = F.from_json(F.get_json_object("x.b.meta_data", "$.resource_infos"), "array<struct<file_name:string>>")
    files = F.concat(F.when(mime == "doc/url", "[file] ").otherwise("[image] "), F.array_join(F.transform(names, lambda f: f["file_name"]), ", "))
    is_text = mime.isin("text/plain", "multi_load/iframe")
    body = F.when(is_text, F.col("x.b.content")).when(mime == "plan_cot/post", F.concat(F.lit("[think] "), "x.b.content")).when(mime.isin("doc/url", "image/url"), files)
    return merge_text_blocks(
        blocks.select("session_id", "turn_no", "block_no", F.col("x.speaker").alias("speaker"), "ts", F.coalesce(is_text, F.lit(False)).alias("is_text"), body.alias("text"))
    )


def parse_numbered_blocks(docs: DataFrame) -> DataFrame:
    """Layout three: messages with numbered block types."""
    messages = docs.select(_js("doc", "$.id").alias("session_id"), F.posexplode(F.from_json(_js("doc", "$.messages"), "array<string>")).alias("turn_no", "m"))
    blocks = messages.select(
        "session_id",
        "turn_no",
        F.when(_js("m", "$.user_type") == "1", "user").otherwise("assistant").alias("speaker"),
        text.to_local_ts(_js("m", "$.create_time")).alias("ts"),
        F.posexplode(F.from_json(_js("m", "$.content_block"), "array<string>")).alias("block_no", "b"),
    )
    kind = _js("b", "$.block_type").try_cast("int")

    def tagged(tag: str, *paths: str) -> Column:
        found = F.coalesce(*[F.nullif(text.strip(_js("b", f"$.content.{p}")), F.lit("")) for p in paths])
        return F.concat(F.lit(f"[{tag}] "), found)

    # Block numbers of the layout.
    note = (
        F.when(kind == 10040, tagged("think", "thinking_block.finish_title", "thinking_block.streaming_title"))
        .when(kind == 10082, tagged("ask", "interaction_ask_block.questions[0].title"))
        .when(kind == 10019, tagged("file-op", "file_operation_block.file_name", "file_operation_block.path"))
        .when(kind == 10030, tagged("artifact", "artifact_block.title"))
        .when(kind == 10025, tagged("search", "search_query_result_block.summary"))
        .when(kind == 2074, tagged("image", "creation_block.creations[0].image.key"))
    )
    said = text.strip(_js("b", "$.content.text_block.text"))
    return merge_text_blocks(
        blocks.select("session_id", "turn_no", "block_no", "speaker", "ts", (kind == 10000).alias("is_text"), F.when(kind == 10000, said).otherwise(note).alias("text"))
    )


# --- simple sources -----------------------------------------------------------------------


def read_daily_logs(spark: SparkSession, path: str) -> DataFrame:
    """One file per session with a single assistant message: <workspace>/.../<date>.md."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return daily_log_messages(rows.select(F.col("_metadata.file_path").alias("file"), "value"), path)


def daily_log_messages(files: DataFrame, root: str) -> DataFrame:
    inside = F.split(F.substring_index("file", root.rstrip("/") + "/", -1), "/")
    day = F.regexp_extract("file", r"([^/]+)\.md$", 1)
    return files.select(
        F.concat_ws("::", F.get(inside, F.lit(0)), day).alias("session_id"),
        F.lit(0).alias("seq"),
        F.lit("assistant").alias("role"),
        day.alias("ts"),
        F.col("value").alias("text"),
        F.lit(None).cast("string").alias("raw"),
    )


def unpivot_turns(turns: DataFrame) -> DataFrame:
    """Turn rows (session_id, turn_no, user_message, assistant_response, ts) as two messages each, empty ones dropped."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("user_message").alias("text")),
        F.struct(F.lit("assistant").alias("role"), F.col("assistant_response").alias("text")),
    )
    rows = turns.select("session_id", "turn_no", "ts", F.posexplode(pair).alias("part", "m"))
    return number_messages(
        rows.select("session_id", "turn_no", "part", "m.role", "ts", _clean(F.col("m.text")).alias("text"), F.lit(None).cast("string").alias("raw")),
        "turn_no",
        "part",
    )


SPANS = "array<struct<name:string,type:string,status:string,duration:double,startedAt:string,toolName:string,agentName:string>>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace files as (file, doc); one JSON document per file."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def trace_spans(traces: DataFrame) -> DataFrame:
    return traces.select(F.explode(F.from_json(_js("doc", "$.spans"), SPANS)).alias("s")).select("s.*")


def trace_status(traces: DataFrame) -> DataFrame:
    readable = F.try_parse_json("doc").isNotNull() & text.strip("doc").startswith("{")
    spans = F.size(F.from_json(_js("doc", "$.spans"), SPANS))
    return traces.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(~F.coalesce(readable, F.lit(False))).alias("bad_files"),
        F.coalesce(F.sum(F.greatest(spans, F.lit(0))), F.lit(0)).alias("spans"),
    )
