"""Ordered analyses: turns, runs, loops, skill chains, as-of joins, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import steps as ST
from tracewell.plans.ordinal import ranged_blocks
from tracewell.plans.scan import Running, floor_quantile, in_one_block, running_scan, seq_block, value_runs
from tracewell.session import materialize

STREAK_MIN = 5
CYCLE_MIN = 3
SPIN_MIN = 5
#: How far a skill's following calls are followed and reported.
AFTER_STEPS = 12
CHAIN_LEN = 8


# --- turns ------------------------------------------------------------------


def split_turns(messages: DataFrame, whole: bool | None = None) -> DataFrame:
    """Add turn_no: a turn starts at each user message but the first."""
    users = F.when(F.col("role") == "user", 1).otherwise(0)
    scanned = running_scan(messages, ["sid"], ["seq"], seq_block(), {"__users": Running("sum", users)}, whole)
    return scanned.withColumn("turn_no", F.greatest(F.lit(1), F.col("__users")).cast("int")).drop("__users")


def turn_counts(messages: DataFrame) -> DataFrame:
    """Turns per session: user messages, at least one."""
    return messages.groupBy("sid").agg(
        F.greatest(F.lit(1), F.count_if(F.col("role") == "user")).cast("int").alias("turns")
    )


def read_turn(messages: DataFrame, turn: int | str = "all") -> DataFrame:
    """Messages of one turn, the ``last`` turn, or all of them.

    A number beyond a session's last turn gives no rows for that session;
    ``turn_bounds`` reports which sessions have it.
    """
    turns = split_turns(messages)
    if turn == "all":
        return turns
    if turn == "last":
        ends = turn_counts(messages)
        return turns.join(ends, "sid").filter(F.col("turn_no") == F.col("turns")).drop("turns")
    if not isinstance(turn, int) or turn < 1:
        raise ValueError(f"turn must be 'all', 'last' or a positive number: {turn!r}")
    return turns.filter(F.col("turn_no") == turn)


def turn_bounds(messages: DataFrame, turn: int) -> DataFrame:
    return turn_counts(messages).withColumn("in_range", (F.lit(turn) >= 1) & (F.lit(turn) <= F.col("turns")))


def turn_overview(messages: DataFrame, preview: int = 120) -> DataFrame:
    """Per turn: message count, roles seen, preview of its first message."""
    first = F.min_by("raw", "seq")
    return (
        split_turns(messages)
        .groupBy("sid", "turn_no")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.min("seq").alias("first_seq"),
            F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
            text.head(text.fold(first), preview).alias("preview"),
        )
    )


def numbered_user_turns(messages: DataFrame) -> DataFrame:
    """User messages with their 1-based number inside the session."""
    users = messages.filter(F.col("role") == "user")
    return running_scan(users, ["sid"], ["seq"], seq_block(), {"turn": Running("sum", F.lit(1))}).withColumn(
        "turn", F.col("turn").cast("int")
    )


def session_intro(messages: DataFrame) -> DataFrame:
    """First user text and user/assistant counts per session."""
    return messages.groupBy("sid").agg(
        F.min_by("raw", F.when(F.col("role") == "user", F.col("seq"))).alias("first_user"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
    )


def coarse_timeline(messages: DataFrame, cut: int = 400) -> DataFrame:
    """First user and last assistant text per session."""
    return messages.groupBy("sid").agg(
        text.head(F.min_by("raw", F.when(F.col("role") == "user", F.col("seq"))), cut).alias("first_user"),
        text.head(F.max_by("raw", F.when(F.col("role") == "assistant", F.col("seq"))), cut).alias("last_assistant"),
    )


def mid_timeline(messages: DataFrame, cut: int = 800) -> DataFrame:
    return messages.filter(F.col("role") == "user").select("sid", "seq", text.head("raw", cut).alias("raw"))


def coherence(messages: DataFrame) -> DataFrame:
    """Mean bigram similarity of adjacent user turns; 1.0 for a single turn."""
    users = messages.filter((F.col("role") == "user") & (text.strip(F.coalesce("raw", F.lit(""))) != ""))
    grams = users.select("sid", "seq", F.array_distinct(text.bigrams("raw")).alias("grams"))
    scanned = running_scan(
        grams, ["sid"], ["seq"], seq_block(), {"before": Running("prev", F.struct(F.col("grams").alias("g")))}
    )
    sim = F.when(F.col("before").isNotNull(), text.jaccard("grams", "before.g"))
    return scanned.groupBy("sid").agg(
        F.count(F.lit(1)).alias("turns"), F.coalesce(F.avg(sim), F.lit(1.0)).alias("coherence")
    )


# --- chain patterns ----------------------------------------------------------


def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("sid").agg(F.count(F.lit(1)).alias("n_steps"))


def step_p95(counts: DataFrame) -> DataFrame:
    hist = counts.groupBy("n_steps").agg(F.count(F.lit(1)).alias("n"))
    return floor_quantile(hist, [], "n_steps", {"p95": 0.95})


def long_sessions(steps: DataFrame) -> DataFrame:
    """Sessions with more steps than the floor-indexed 95th percentile."""
    counts = step_counts(steps)
    limit = step_p95(counts)  # one row
    return counts.join(F.broadcast(limit), F.col("n_steps") > F.col("p95")).select("sid", "n_steps", "p95")


def same_tool_streaks(steps: DataFrame, minimum: int = STREAK_MIN) -> DataFrame:
    calls = steps.filter(ST.is_call()).select("sid", "seq", "tool")
    runs = value_runs(calls, ["sid"], "seq", "tool", seq_block())
    return runs.filter(F.col("length") >= minimum).select("sid", "tool", F.col("first_pos").alias("first_seq"), "length")


def tool_loops(steps: DataFrame, minimum: int = CYCLE_MIN) -> DataFrame:
    """A-B loops found by a left-to-right scan over calls without adjacent repeats.

    The scan consumes whole cycles, so each maximal alternating stretch is
    entered at its first or second element.  Neighbouring stretches share one
    element; a stretch of odd length hands its entry offset on unchanged and
    one of even length flips it, hence the offset is the parity of the even
    stretches before it.
    """
    calls = steps.filter(ST.is_call()).select("sid", "seq", "tool")
    whole = in_one_block(calls, seq_block())
    kept = running_scan(
        calls, ["sid"], ["seq"], seq_block(), {"before": Running("prev", F.struct(F.col("tool").alias("t")))}, whole
    ).filter(F.col("before").isNull() | (F.col("before.t") != F.col("tool")))
    kept = kept.select("sid", "seq", "tool", F.col("before.t").alias("prev_tool"))
    # the tool two places back is the prev_tool of the row before
    linked = running_scan(
        kept,
        ["sid"],
        ["seq"],
        seq_block(),
        {"row_before": Running("prev", F.struct("seq", "tool", "prev_tool"))},
        whole,
    )
    breaks = ~F.coalesce(F.col("row_before.prev_tool") == F.col("tool"), F.lit(False))
    # an element pair (row before, row) starts a stretch when the alternation breaks
    pairs = linked.filter(F.col("row_before").isNotNull()).select(
        "sid",
        "seq",
        F.col("row_before.seq").alias("left_seq"),
        F.col("row_before.tool").alias("left_tool"),
        "tool",
        F.when(breaks, 1).otherwise(0).alias("starts"),
    )
    if not whole:
        pairs = materialize(pairs)
    stretched = running_scan(pairs, ["sid"], ["seq"], seq_block(), {"stretch": Running("sum", F.col("starts"))}, whole)
    stretches = stretched.groupBy("sid", "stretch").agg(
        (F.count(F.lit(1)) + 1).alias("length"),
        F.min(F.struct("left_seq", "left_tool", "seq", "tool")).alias("first"),
    )
    entered = running_scan(
        stretches,
        ["sid"],
        ["stretch"],
        seq_block("stretch"),
        {"evens": Running("sum", F.when(F.col("length") % 2 == 0, 1).otherwise(0))},
        whole or None,  # a session has at most as many stretches as rows
    )
    before = F.col("evens") - F.when(F.col("length") % 2 == 0, 1).otherwise(0)
    offset = before % 2
    cycles = F.floor((F.col("length") - offset) / 2)
    a = F.when(offset == 0, F.col("first.left_tool")).otherwise(F.col("first.tool"))
    b = F.when(offset == 0, F.col("first.tool")).otherwise(F.col("first.left_tool"))
    return entered.select(
        "sid",
        F.concat(a, F.lit("↔"), b).alias("loop"),
        cycles.cast("long").alias("cycles"),
        F.when(offset == 0, F.col("first.left_seq")).otherwise(F.col("first.seq")).alias("first_seq"),
    ).filter(F.col("cycles") >= minimum)


def tool_spins(steps: DataFrame, minimum: int = SPIN_MIN) -> DataFrame:
    """Runs of error results of one tool in a session, other tools ignored."""
    results = steps.filter(F.col("phase") == "result").select(
        "sid", "tool", "seq", F.coalesce(F.col("status") == "error", F.lit(False)).alias("failed")
    )
    runs = value_runs(results, ["sid", "tool"], "seq", "failed", seq_block())
    return runs.filter(F.col("failed") & (F.col("length") >= minimum)).select(
        "sid", "tool", F.col("first_pos").alias("first_seq"), "length"
    )


def top_sessions(steps: DataFrame, n: int = 10) -> DataFrame:
    return step_counts(steps).orderBy(F.desc("n_steps"), "sid").limit(n)


# --- skills -------------------------------------------------------------------


def skill_invocations(steps: DataFrame, sessions: DataFrame) -> DataFrame:
    """Skill calls with their outcome and the distinct-adjacent calls that follow.

    Every row learns its latest skill call by one scan.  The first later result
    of the same tool closes the call; the first calls after it form the chain.
    """
    name = ST.skill_name(F.col("tool"), F.col("detail"))
    opener = F.when(ST.is_skill_call(), F.struct(F.col("seq").alias("open_seq"), F.col("tool").alias("open_tool")))
    rows = steps.select("sid", "seq", "tool", "phase", "status", "error", opener.alias("opener"))
    owned = (
        running_scan(rows, ["sid"], ["seq"], seq_block(), {"open": Running("last", F.col("opener"))})
        .filter(F.col("open").isNotNull() & F.col("opener").isNull())
        .select("sid", "seq", "tool", "phase", "status", "error", "open.open_seq", "open.open_tool")
    )
    closes = (
        owned.filter((F.col("phase") == "result") & (F.col("tool") == F.col("open_tool")))
        .groupBy("sid", "open_seq")
        .agg(F.min(F.struct("seq", "status", "error")).alias("close"))
    )
    later = (
        owned.filter(F.col("phase") == "call")
        .select("sid", "open_seq", "seq", "tool")
        .join(closes.select("sid", "open_seq", F.col("close.seq").alias("close_seq")), ["sid", "open_seq"])
        .filter(F.col("seq") > F.col("close_seq"))
    )
    followed = ST.top_per_group(later, ["sid", "open_seq"], [F.col("seq")], AFTER_STEPS, "nth")
    # at most AFTER_STEPS rows per call
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "tool"))), lambda x: x["tool"])
    deduped = F.filter(
        F.col("after"), lambda x, i: (i == 0) | (x != F.get(F.col("after"), i - 1))
    )
    chains = (
        followed.groupBy("sid", "open_seq")
        .agg(ordered.alias("after"))
        .select("sid", "open_seq", F.slice(deduped, 1, CHAIN_LEN).alias("after_tools"))
    )
    calls = steps.filter(ST.is_skill_call()).select(
        "sid",
        F.col("seq").alias("open_seq"),
        "ts",
        F.coalesce(name, F.lit("")).alias("skill"),
        F.coalesce(ST.skill_args(F.col("tool"), F.col("detail")), F.lit("")).alias("args"),
    )
    joined = calls.join(closes, ["sid", "open_seq"], "left").join(chains, ["sid", "open_seq"], "left")
    status = F.when(F.col("close").isNull(), "no_result").otherwise(
        F.coalesce(F.nullif("close.status", F.lit("")), F.lit("unknown"))
    )
    return ST.with_source(joined, sessions).select(
        "sid",
        F.col("open_seq").alias("seq"),
        "ts",
        "source",
        "skill",
        "args",
        status.alias("status"),
        F.coalesce("close.error", F.lit("")).alias("error"),
        F.coalesce("after_tools", F.array().cast("array<string>")).alias("after_tools"),
    )


def skill_summary(invocations: DataFrame) -> DataFrame:
    """Counts per skill."""
    named = invocations.withColumn("skill", F.when(F.col("skill") == "", "?").otherwise(F.col("skill")))
    ok = F.col("status").isin(*ST.OK_STATUS)
    none = F.col("status") == "no_result"
    per_session = named.groupBy("skill", "source", "sid").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(ok).alias("ok"),
        F.count_if(none).alias("no_result"),
    )
    return per_session.groupBy("skill").agg(
        F.sum("calls").alias("calls"),
        F.count_distinct("sid").alias("sessions"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.sum("ok").alias("ok"),
        F.sum(F.col("calls") - F.col("ok") - F.col("no_result")).alias("err"),
        F.sum("no_result").alias("no_result"),
    )


def skill_top_chains(invocations: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent behaviour chains per skill (ties by chain text)."""
    chain = F.array_join("after_tools", "→")
    counted = (
        invocations.filter(F.size("after_tools") > 0)
        .select(F.when(F.col("skill") == "", "?").otherwise(F.col("skill")).alias("skill"), chain.alias("chain"))
        .groupBy("skill", "chain")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return ST.top_per_group(counted, ["skill"], [F.desc("n"), F.col("chain")], k)


def skill_samples(invocations: DataFrame, args_k: int = 3, anchors_k: int = 10) -> DataFrame:
    """Argument samples and anchors per skill, as ranked rows of kind ``args`` or ``anchor``."""
    named = invocations.withColumn("skill", F.when(F.col("skill") == "", "?").otherwise(F.col("skill")))
    by_place = [F.col("sid"), F.col("seq")]
    args = ST.top_per_group(named.filter(F.col("args") != ""), ["skill"], by_place, args_k).select(
        "skill", F.lit("args").alias("kind"), "rank", text.head("args", 80).alias("value")
    )
    anchors = ST.top_per_group(named, ["skill"], by_place, anchors_k).select(
        "skill", F.lit("anchor").alias("kind"), "rank", F.concat_ws("#", "sid", "seq").alias("value")
    )
    return args.unionByName(anchors)


# --- as-of joins ----------------------------------------------------------------


def turn_asof(events: DataFrame, messages: DataFrame) -> DataFrame:
    """User turn running at each event's stamp: the last turn with ts <= event ts.

    Turns without a stamp are ignored.  ``events`` has sid, seq, ts.
    """
    turns = numbered_user_turns(messages).filter(F.coalesce("ts", F.lit("")) != "").select(
        "sid", "ts", F.lit(0).alias("kind"), F.col("turn").alias("pos"), F.col("turn"), F.lit(None).cast("int").alias("seq")
    )
    marks = events.filter(F.coalesce("ts", F.lit("")) != "").select(
        "sid", "ts", F.lit(1).alias("kind"), F.col("seq").alias("pos"), F.lit(None).cast("int").alias("turn"), "seq"
    )
    order = ["ts", "kind", "pos"]
    placed = ranged_blocks(turns.unionByName(marks), [F.col(c) for c in ("sid", *order)])
    scanned = running_scan(placed, ["sid"], order, F.col("range_block"), {"at_turn": Running("max", F.col("turn"))})
    hits = scanned.filter(F.col("kind") == 1).select("sid", "seq", F.col("at_turn").alias("turn"))
    return events.select("sid", "seq", "ts").join(hits, ["sid", "seq"], "left")


def stage_windows(chain_nodes: DataFrame) -> DataFrame:
    """Distinct stages of each chain with parsed span."""
    stages = chain_nodes.select("chain_id", "stage_no", "stage", "span").distinct()
    span = text.date_span("span")
    return stages.select("*", span["start"].alias("start_day"), span["end"].alias("end_day"))


def _stage_days(windows: DataFrame, margin_days: int) -> DataFrame:
    """(chain_id, day, day_stage): the first stage of a chain that covers a day."""
    spans = windows.filter(F.col("start_day").isNotNull() & (F.col("start_day") <= F.date_add("end_day", margin_days)))
    days = F.explode(F.sequence("start_day", F.date_add("end_day", margin_days)))
    return (
        spans.select("chain_id", "stage_no", days.alias("d"))
        .groupBy("chain_id", F.col("d").cast("string").alias("day"))
        .agg(F.min("stage_no").alias("day_stage"))
    )


def _with_day(invocations: DataFrame) -> DataFrame:
    return invocations.withColumn("day", F.nullif(text.head(F.coalesce("ts", F.lit("")), 10), F.lit("")))


def _after(windows: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds the stage's name and whether the call's day lies behind its end."""
    ends = windows.select("chain_id", "stage_no", "stage", "end_day")
    late = F.coalesce(F.col("day") > F.col("end_day").cast("string"), F.lit(False))
    return placed.join(ends, ["chain_id", "stage_no"], "left").withColumn("late", late)


def stage_calls(
    invocations: DataFrame,
    chain_members: DataFrame,
    chain_nodes: DataFrame,
    messages: DataFrame,
    margin_days: int = 0,
) -> DataFrame:
    """Skill calls of a chain's members placed in its stages: by node, else by day.

    Day placement joins on exploded calendar days of the stage spans, so it is
    an equi-join; the first stage per (chain, day) is chosen before joining.
    Calls of other sessions are counted by ``other_stage_calls``.
    """
    turns = turn_asof(invocations, messages).select("sid", "seq", "turn")
    calls = _with_day(invocations.join(turns, ["sid", "seq"], "left"))
    windows = stage_windows(chain_nodes)
    node_hit = (
        chain_nodes.select("chain_id", "stage_no", "sid", "turn")
        .groupBy("chain_id", "sid", "turn")
        .agg(F.min("stage_no").alias("node_stage"))
    )
    members = chain_members.select("chain_id", "sid").distinct()
    placed = (
        calls.join(members, "sid")
        .join(node_hit, ["chain_id", "sid", "turn"], "left")
        .join(_stage_days(windows, margin_days), ["chain_id", "day"], "left")
        .withColumn("stage_no", F.coalesce("node_stage", "day_stage"))
    )
    kind = F.when(F.col("node_stage").isNotNull(), "member").when(F.col("day_stage").isNotNull(), "member_span").otherwise("unassigned")
    named = _after(windows, placed.withColumn("kind", kind))
    given = F.col("kind") != "unassigned"
    return named.select(
        "chain_id", "sid", "seq", F.when(given, F.col("turn")).alias("turn"), "skill", "stage_no", "stage",
        F.when(F.col("late") & given, F.concat("kind", F.lit("_after"))).otherwise(F.col("kind")).alias("kind"),
    )


def other_stage_calls(
    invocations: DataFrame, chain_members: DataFrame, chain_nodes: DataFrame, margin_days: int = 0
) -> DataFrame:
    """(chain_id, stage_no, skill, kind, n_calls): calls of other sessions on the days of a chain's stages.

    All calls are counted per day and skill before they meet the chains, and the
    members' own are taken off, so no call is repeated for every chain.
    """
    calls = _with_day(invocations).filter(F.col("day").isNotNull())
    windows = stage_windows(chain_nodes)
    every = calls.groupBy("day", "skill").agg(F.count(F.lit(1)).alias("n"))
    own = (
        calls.join(chain_members.select("chain_id", "sid").distinct(), "sid")
        .groupBy("chain_id", "day", "skill").agg(F.count(F.lit(1)).alias("own"))
    )
    counted = (
        every.join(_stage_days(windows, margin_days), "day").join(own, ["chain_id", "day", "skill"], "left")
        .withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).filter("n > 0").withColumnRenamed("day_stage", "stage_no")
    )
    named = _after(windows, counted)
    kind = F.when(F.col("late"), "temporal_after").otherwise("temporal")
    return named.groupBy("chain_id", "stage_no", "skill", kind.alias("kind")).agg(F.sum("n").alias("n_calls"))


# --- picks and budgets ---------------------------------------------------------------


def even_pick(df: DataFrame, keys: list[str], order: list[str], block: Column, k: int) -> DataFrame:
    """k evenly spaced rows of each ordered bucket: index round-half-even(i*(n-1)/(k-1))."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    numbered = running_scan(df, keys, order, block, {"__nth": Running("sum", F.lit(1))})
    i = F.col("__nth") - 1
    joined = numbered.join(counts, keys)
    if k <= 1:
        return joined.filter(i == 0).drop("__n", "__nth")
    # row i is picked when some j in 0..k-1 rounds to it; j is near i*(k-1)/(n-1)
    near = F.floor(i * (k - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    picks = F.array(*[F.bround((near + d) * (F.col("__n") - 1) / (k - 1)).cast("long") for d in (-1, 0, 1, 2)])
    valid = F.array(*[((near + d) >= 0) & ((near + d) <= k - 1) for d in (-1, 0, 1, 2)])
    hit = F.exists(F.arrays_zip(picks.alias("p"), valid.alias("v")), lambda z: z["v"] & (z["p"] == i))
    return joined.filter((F.col("__n") <= k) | hit).drop("__n", "__nth")


def within_budget(
    df: DataFrame, keys: list[str], order: list[str], block: Column, cost: Column, budget: Column, min_cut: int
) -> DataFrame:
    """Rows kept whole while the running cost fits, plus one cut row if enough is left.

    Adds ``fit`` in whole, cut and the room left for a cut row.
    """
    scanned = running_scan(df.withColumn("__cost", cost), keys, order, block, {"__upto": Running("sum", F.col("__cost"))})
    limited = scanned.withColumn("__budget", budget)
    room = F.col("__budget") - (F.col("__upto") - F.col("__cost"))
    fits = F.col("__upto") <= F.col("__budget")
    first_over = ~fits & (room >= 0)
    kept = limited.withColumn("room", F.when(~fits, room)).withColumn(
        "fit", F.when(fits, "whole").when(first_over & (room >= min_cut), "cut")
    )
    return kept.filter(F.col("fit").isNotNull()).drop("__cost", "__upto", "__budget")


def budgeted_text(messages: DataFrame, budget: int, min_cut: int = 100) -> DataFrame:
    """Texts of a session in order while their length plus one fits the budget; one cut text if enough room is left."""
    cost = F.length(F.coalesce("raw", F.lit(""))) + 1
    kept = within_budget(
        messages.select("sid", "seq", "raw"), ["sid"], ["seq"], seq_block(), cost, F.lit(budget), min_cut
    )
    block = F.when(F.col("fit") == "whole", F.col("raw")).otherwise(F.substring("raw", F.lit(1), F.col("room").cast("int")))
    return kept.select("sid", "seq", "fit", block.alias("block"))


def context_pack(messages: DataFrame, sessions: DataFrame, total_budget: int = 2000) -> DataFrame:
    """Whole turns per session under max(200, total / sessions) tokens, then one cut turn if over 40 are left.

    Rows are (sid, turn_no, fit, block); the header's own cost counts first.
    """
    n = sessions.agg(F.count(F.lit(1)).alias("__n"))
    per = n.select(F.greatest(F.lit(200), F.floor(F.lit(total_budget) / F.greatest(F.lit(1), F.col("__n")))).alias("__per"))
    whole = in_one_block(messages, seq_block())
    turns = split_turns(messages.select("sid", "seq", "role", "raw"), whole)
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), text.strip(text.normalize_newlines("raw")))
    # only turns that start within the budget can be kept, so a turn's text is gathered under that bound
    with_len = running_scan(
        turns.select("sid", "seq", "turn_no", line.alias("line")),
        ["sid"],
        ["seq"],
        seq_block(),
        {"__chars": Running("sum", F.length("line"))},
        whole,
    ).join(F.broadcast(per))
    costs = with_len.groupBy("sid", "turn_no").agg(
        _lines_tokens("line").alias("cost"), F.min(F.col("__chars") - F.length("line")).alias("__start"), F.max("__per").alias("__per")
    )
    header_cost = _pack_header_cost(sessions, turn_counts(messages))
    costed = costs.join(header_cost, "sid")
    scanned = running_scan(costed, ["sid"], ["turn_no"], seq_block("turn_no"), {"__upto": Running("sum", F.col("cost"))}, whole or None)
    upto = F.col("__upto") + F.col("head_cost")
    room = F.col("__per") - (upto - F.col("cost"))
    fit = F.when(upto <= F.col("__per"), "whole").when((room > 40) & (upto - F.col("cost") <= F.col("__per")), "cut")
    chosen = scanned.select("sid", "turn_no", fit.alias("fit"), room.alias("room"), "__start").filter(F.col("fit").isNotNull())
    body = (
        with_len.join(chosen, ["sid", "turn_no"])
        .filter((F.col("fit") == "whole") | (F.col("__chars") - F.length("line") - F.col("__start") <= F.col("room") * 4))
        .groupBy("sid", "turn_no", "fit", "room")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    )
    seg = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    cut = F.substring(seg, F.lit(1), (F.col("room") * 4).cast("int"))
    return body.select("sid", "turn_no", "fit", F.when(F.col("fit") == "whole", seg).otherwise(cut).alias("block"))


def _lines_tokens(line: str) -> Column:
    """Token estimate of newline-joined lines plus the turn heading, from per-line sums."""
    other = F.length(F.regexp_replace(line, r"[\u4e00-\u9fff\u3000-\u303f]", ""))
    cjk = F.sum(F.length(line) - other)
    rest = F.sum(other) + F.count(F.lit(1)) - 1
    return (cjk + F.floor(rest / 4) + 1 + 4).cast("long")


def _pack_header_cost(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    header = F.concat(
        F.lit("## "),
        text.normalize_newlines("title"),
        F.lit("\n\n- source: "),
        F.col("source"),
        F.lit(" | date: "),
        text.head(F.coalesce("created_at", F.lit("")), 10),
        F.lit("\n- session_id: "),
        F.col("session_id"),
        F.lit(" | turns: "),
        F.col("turns"),
        F.lit("\n\n"),
    )
    return sessions.join(turns, "sid").select("sid", text.est_tokens(header).alias("head_cost"))


def transcript_pack(messages: DataFrame, steps: DataFrame, budget: int) -> DataFrame:
    """Messages, then steps, as anchored lines while the running length fits the budget.

    The cut falls between lines, so no line is split.
    """
    said = messages.select(
        "sid",
        F.lit(0).alias("part_no"),
        "seq",
        F.concat(F.lit("["), "sid", F.lit("#m"), "seq", F.lit("] "), "role", F.lit(": "), F.coalesce("raw", F.lit(""))).alias("line"),
    )
    done = steps.select(
        "sid",
        F.lit(1).alias("part_no"),
        "seq",
        F.concat(
            F.lit("["), "sid", F.lit("#"), "seq", F.lit("] "), "tool", F.lit(" "), "phase", F.lit(" "),
            F.coalesce("status", F.lit("")), F.lit(" "), F.coalesce("error", F.lit("")),
        ).alias("line"),
    )
    block = F.col("part_no") * F.lit(1 << 40) + seq_block()
    scanned = running_scan(
        said.unionByName(done),
        ["sid"],
        ["part_no", "seq"],
        block,
        {"__upto": Running("sum", F.length("line") + 1)},
    )
    return scanned.filter(F.col("__upto") <= budget).select(
        "sid", F.when(F.col("part_no") == 0, "message").otherwise("step").alias("part"), "seq", "line"
    )


def session_pack(sessions: DataFrame, messages: DataFrame, steps: DataFrame) -> DataFrame:
    """Session meta with its error steps and all turns, as ordered rows (part, part_no, seq).

    Rows instead of nested lists: a long session never has to fit one cell.
    """
    meta = sessions.select("sid", "title")
    turns = split_turns(messages.select("sid", "seq", "role", "raw")).select(
        "sid", F.lit("turn").alias("part"), F.col("turn_no").alias("part_no"), "seq", F.col("role").alias("label"), F.col("raw").alias("body")
    )
    failed = steps.filter(F.col("status") == "error").select(
        "sid", F.lit("error").alias("part"), F.lit(0).alias("part_no"), "seq", F.col("tool").alias("label"), F.col("error").alias("body")
    )
    return turns.unionByName(failed).join(meta, "sid").select("sid", "title", "part", "part_no", "seq", "label", "body")


def monthly_anchor_packs(rows: DataFrame, k: int, budget: int) -> DataFrame:
    """k evenly spaced rows per month, marked kept while their running cost fits the budget.

    ``rows`` has sid, seq, ts and cost.  Months are cut into ranges of rows for
    the even pick; at most k rows per month reach the budget scan.
    """
    dated = rows.withColumn("month", text.month_key("ts")).filter(F.col("month").isNotNull())
    order = ["ts", "sid", "seq"]
    ranged = ranged_blocks(dated, [F.col(c) for c in ("month", *order)])
    picked = even_pick(ranged, ["month"], order, F.col("range_block"), k).drop("range_block").withColumn("__all", F.lit(0))
    month_no = F.expr("cast(replace(month, '-', '') as bigint)")
    scanned = running_scan(
        picked, ["__all"], ["month", "ts", "sid", "seq"], month_no, {"__upto": Running("sum", F.col("cost"))}
    )
    return scanned.withColumn("kept", F.col("__upto") <= budget).drop("__all", "__upto")
