"""From parsed histories to the three tables, and keeping those tables current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.plans.ordinal import with_ordinal
from tracewell.plans.scan import Running, running_scan, seq_block

def _js(col: str | Column, path: str) -> Column:
    return F.get_json_object(F.col(col) if isinstance(col, str) else col, path)


def step_of(raw: str = "raw", error_chars: int | None = None, detail_chars: int | None = None) -> Column:
    """Tool step told by a message's raw JSON, null when it is none; error and input are kept whole unless limited."""
    kind = F.coalesce(F.nullif(_js(raw, "$.kind"), F.lit("")), _js(raw, "$.entry_type"))
    tool = F.coalesce(*[F.nullif(_js(raw, p), F.lit("")) for p in ("$.tool", "$.data.toolName", "$.data.tool")])
    none = F.lit(None).cast("string")
    given = F.coalesce(*[F.nullif(_js(raw, p), F.lit("")) for p in ("$.status", "$.data.status")], F.lit("unknown"))
    plain_error = F.when(~_js(raw, "$.data.error").startswith("{"), _js(raw, "$.data.error"))
    nested = F.coalesce(
        F.nullif(_js(raw, "$.data.error.code"), F.lit("")), F.nullif(_js(raw, "$.data.error.message"), F.lit("")), plain_error
    )
    error = text.head(F.coalesce(_js(raw, "$.error"), F.nullif(nested, F.lit(""))), error_chars)
    call_detail = F.coalesce(_js(raw, "$.detail"), text.head(_js(raw, "$.data.input"), detail_chars))
    is_call = kind == "tool_call"
    step = F.struct(
        tool.alias("tool"),
        F.when(is_call, "call").otherwise("result").alias("phase"),
        F.when(is_call, none).otherwise(given).alias("status"),
        F.when(is_call, none).otherwise(error).alias("error"),
        F.when(is_call, call_detail).otherwise(_js(raw, "$.detail")).alias("detail"),
    )
    return F.when(kind.isin("tool_call", "tool_result") & tool.isNotNull(), step)


def build_tables(
    records: DataFrame, roles: Sequence[str] | None = None, strip_raw: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sessions, messages and steps from records with nested messages.

    The archive path keeps every role and the raw text as given; the live path
    passes ``roles`` and ``strip_raw``.  Steps are numbered over tool messages
    only, whatever the role filter.
    """
    sessions = records.select("sid", "source", "session_id", "title", "category", "created_at", "updated_at", "file", "model")
    rows = records.select("sid", F.posexplode("messages").alias("seq", "m"))
    flat = rows.select(
        "sid",
        "seq",
        F.coalesce("m.role", F.lit("note")).alias("role"),
        F.col("m.timestamp").alias("ts"),
        F.coalesce("m.text", F.lit("")).alias("given"),
        F.col("m.raw").alias("payload"),
    )
    clean = text.strip(text.normalize_newlines("given"))
    said = flat.select("sid", "seq", "role", "ts", clean.alias("clean"), "given").filter(F.col("clean") != "")
    if roles is not None:
        said = said.filter(F.col("role").isin(list(roles)))
    dense = running_scan(said, ["sid"], ["seq"], seq_block(), {"nth": Running("sum", F.lit(1))})
    messages = dense.select(
        "sid",
        (F.col("nth") - 1).cast("int").alias("seq"),
        "role",
        "ts",
        text.cjk_bigram_rewrite("clean").alias("text"),
        (F.col("clean") if strip_raw else F.col("given")).alias("raw"),
    )
    tools = flat.select("sid", "seq", "ts", step_of("payload").alias("s")).filter(F.col("s").isNotNull())
    counted = running_scan(tools, ["sid"], ["seq"], seq_block(), {"nth": Running("sum", F.lit(1))})
    steps = counted.select("sid", (F.col("nth") - 1).cast("int").alias("seq"), "ts", "s.tool", "s.phase", "s.status", "s.error", "s.detail")
    return sessions, messages, steps


def flat_steps(messages: DataFrame) -> DataFrame:
    """Steps from parsed message rows (session_id, seq, ts, raw)."""
    tools = messages.select("session_id", "seq", "ts", step_of("raw").alias("s")).filter(F.col("s").isNotNull())
    counted = running_scan(tools, ["session_id"], ["seq"], seq_block(), {"nth": Running("sum", F.lit(1))})
    return counted.select("session_id", (F.col("nth") - 1).cast("int").alias("seq"), "ts", "s.*")


def dominant_model(mentions: DataFrame) -> DataFrame:
    """Most mentioned model per session, ties to the one seen first: sid, seq, model rows in."""
    counted = mentions.filter(F.coalesce("model", F.lit("")) != "").groupBy("sid", "model").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    return counted.groupBy("sid").agg(F.min_by("model", F.struct(-F.col("n"), F.col("first_seq"))).alias("model"))


def outline(sessions: DataFrame, messages: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Listing with ordinal, title, dates, message_count and preview.

    Sources are listed in the given order (else by name), newest first inside
    a source.  Ordinals come from ranges of rows and their sizes, not from a global window.
    """
    counts = messages.groupBy("sid").agg(
        F.count_if(F.col("role").isin("user", "assistant")).alias("message_count"),
        F.min_by("raw", F.when((F.col("role") == "user") & (F.coalesce("raw", F.lit("")) != ""), F.col("seq"))).alias("first_user"),
    )
    rank = F.lit(0)
    if sources:
        rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(sources)], F.lit(len(sources)))
    stamp = F.coalesce("updated_at", F.lit(""))
    listed = sessions.join(counts, "sid", "left").select(
        rank.alias("rank"),
        "source",
        "sid",
        "title",
        "created_at",
        "updated_at",
        F.coalesce("message_count", F.lit(0).cast("long")).alias("message_count"),
        text.head(text.fold(F.coalesce("first_user", "title", F.lit(""))), 80).alias("preview"),
        stamp.alias("stamp"),
    )
    numbered = with_ordinal(listed, [F.col("rank"), F.col("source"), F.desc("stamp"), F.col("sid")])
    return numbered.select(
        (F.col("ordinal") + 1).alias("no"), "source", "sid", "title", "created_at", "updated_at", "message_count", "preview"
    )


# --- schema guard --------------------------------------------------------------------

#: Fields a record type must have.
REQUIRED_PATHS = {
    "session/title": ("$.data.title",),
    "user/message": ("$.data.content",),
    "assistant/message": ("$.data.message.content",),
    "tool/call": ("$.data.name",),
    "tool/result": ("$.data.message",),
}


def shape_problems(lines: DataFrame, required: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Distinct (session_id, problem): record types missing a required field."""
    required = REQUIRED_PATHS if required is None else required
    kind = _js("value", "$.type")
    found = None
    for name, paths in required.items():
        missing = F.coalesce(*[F.when(_js("value", p).isNull(), F.lit(f"{name} lacks {p}")) for p in paths])
        found = F.when(kind == name, missing) if found is None else found.when(kind == name, missing)
    return lines.select("session_id", found.alias("problem")).filter(F.col("problem").isNotNull()).distinct()


def schema_fingerprint(lines: DataFrame) -> DataFrame:
    """Twelve hex digits over the sorted keys of every record type of a session."""
    keys = lines.select("session_id", _js("value", "$.type").alias("type"), F.explode(F.json_object_keys("value")).alias("key"))
    per_type = (
        keys.filter(F.col("type").isNotNull())
        .groupBy("session_id", "type")
        .agg(F.array_sort(F.collect_set("key")).alias("keys"))  # bounded by the key vocabulary
    )
    entry = F.concat(F.lit('"'), "type", F.lit('":'), F.to_json("keys"))
    shape = per_type.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("type", entry.alias("e")))).alias("types"))
    canon = F.concat(F.lit("{"), F.array_join(F.transform("types", lambda t: t["e"]), ","), F.lit("}"))
    return shape.select("session_id", F.substring(F.sha2(canon, 256), 1, 12).alias("fingerprint"))


def guard(lines: DataFrame, required: dict[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of sound sessions, and the lossy sessions with their first problem."""
    problems = shape_problems(lines, required)
    lossy = problems.groupBy("session_id").agg(F.min("problem").alias("problem"))
    return lines.join(lossy.select("session_id"), "session_id", "left_anti"), lossy


# --- incremental upkeep ---------------------------------------------------------------


def classify_listing(listed: DataFrame, stored: DataFrame, ok_sources: DataFrame) -> DataFrame:
    """(sid, source, state): new, updated, unchanged, gone or protected.

    Stored sids of a source are gone only when that source scanned fine and
    listed at least one session; sources listing none are protected.
    """
    left = listed.select("sid", F.col("source").alias("l_source"), F.col("updated_at").alias("l_at"), F.lit(True).alias("listed"))
    right = stored.select("sid", F.col("source").alias("s_source"), F.col("updated_at").alias("s_at"), F.lit(True).alias("stored"))
    counts = listed.groupBy("source").agg(F.count(F.lit(1)).alias("n_listed"))
    scanned = ok_sources.select("source", F.lit(True).alias("ok")).distinct()
    joined = (
        left.join(right, "sid", "full_outer")
        .withColumn("source", F.coalesce("l_source", "s_source"))
        .join(scanned, "source", "left")
        .join(counts, "source", "left")
    )
    changed = (F.coalesce("l_at", F.lit("")) != "") & ~F.col("l_at").eqNullSafe(F.col("s_at"))
    state = (
        F.when(F.col("stored").isNull(), "new")
        .when(F.col("listed") & changed, "updated")
        .when(F.col("listed"), "unchanged")
        .when(F.col("ok").isNull(), "unscanned")
        .when(F.coalesce("n_listed", F.lit(0)) == 0, "protected")
        .otherwise("gone")
    )
    return joined.select("sid", "source", state.alias("state"))


def upsert(current: DataFrame, changed: DataFrame, parsed_sids: DataFrame, dropped_sids: DataFrame) -> DataFrame:
    """Table with the rows of parsed sids replaced and dropped sids removed."""
    touched = parsed_sids.select("sid").unionByName(dropped_sids.select("sid")).distinct()
    return current.join(touched, "sid", "left_anti").unionByName(changed)


def suppression_counts(suppressed: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows per suppressed sid and table: what a purge would remove."""
    out = suppressed.select("sid").distinct()
    for name, table in tables.items():
        hit = table.join(out.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.count(F.lit(1)).alias(name))
        out = out.join(hit, "sid", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def without_suppressed(table: DataFrame, suppressed: DataFrame) -> DataFrame:
    return table.join(suppressed.select("sid").distinct(), "sid", "left_anti")


def corpus_watermark(files: DataFrame) -> DataFrame:
    """Newest modification time per source: (source, mtime) rows in."""
    return files.groupBy("source").agg(F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("files"))


def staleness(watermark: DataFrame, recorded: DataFrame) -> DataFrame:
    """stale per source: current newer than recorded, null when either is unknown."""
    joined = watermark.select("source", "mtime").join(recorded.select("source", F.col("mtime").alias("recorded")), "source", "full_outer")
    return joined.withColumn("stale", F.col("mtime") > F.col("recorded"))


def snapshot_fingerprint(sessions: DataFrame, steps: DataFrame, stale: bool | None = None) -> DataFrame:
    """sessions, steps and error counts in one row."""
    a = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    b = steps.agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "error").alias("errors"))
    return a.join(b).withColumn("stale", F.lit(stale).cast("boolean"))


# --- artifacts -------------------------------------------------------------------------


def artifact_edits(lines: DataFrame) -> DataFrame:
    """Edits and writes among tool calls of event lines (session_id, line_no, value)."""
    args = F.coalesce(_js("value", "$.data.arguments"), F.lit(""))
    old, new = F.get_json_object(args, "$.old_string"), F.get_json_object(args, "$.new_string")
    path, content = F.get_json_object(args, "$.file_path"), F.get_json_object(args, "$.content")
    edit = old.isNotNull() & new.isNotNull()
    write = path.isNotNull() & old.isNull() & (content.isNotNull() | new.isNotNull())
    ms = _js("value", "$.time").try_cast("double")
    rows = lines.filter((_js("value", "$.type") == "tool/call") & (edit | write)).select(
        F.col("session_id").alias("sid"),
        "line_no",
        F.when(ms > 0, text.numeric_to_local_ts(ms / 1000)).alias("ts"),
        F.coalesce(_js("value", "$.data.tool"), F.lit("")).alias("tool"),
        path.alias("file_path"),
        old.alias("old_text"),
        F.when(edit, new).otherwise(F.coalesce(new, content)).alias("new_text"),
    )
    dense = running_scan(rows, ["sid"], ["line_no"], seq_block("line_no"), {"nth": Running("sum", F.lit(1))})
    return dense.select("sid", (F.col("nth") - 1).cast("int").alias("seq"), "ts", "tool", "file_path", "old_text", "new_text")


def artifact_coverage(sessions: DataFrame, artifacts: DataFrame) -> DataFrame:
    total = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    having = artifacts.select("sid").distinct().join(sessions.select("sid"), "sid", "left_semi").agg(F.count(F.lit(1)).alias("with_artifacts"))
    pct = F.when(F.col("sessions") > 0, F.round(F.col("with_artifacts") * 100.0 / F.col("sessions"), 1)).otherwise(F.lit(0.0))
    return total.join(having).withColumn("pct", pct)
