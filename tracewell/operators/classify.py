"""Classification, triage, attribution and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.functions import text
from tracewell.operators import sequence as SQ
from tracewell.operators import steps as ST
from tracewell.plans.contains import contains_pairs
from tracewell.session import materialize


def topic_hints(intro: DataFrame, topics: DataFrame) -> DataFrame:
    """(sid, topic, keyword): first keyword by length, topic name, keyword found in title + opening.

    ``intro`` has sid, title and first_user; keywords shorter than two
    characters are ignored.
    """
    probe = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), text.head(F.coalesce("first_user", F.lit("")), 120))
    keywords = (
        topics.select(F.col("name").alias("topic"), F.explode("keywords").alias("keyword"))
        .filter(F.length("keyword") >= 2)
        .distinct()
    )
    # every keyword belongs to its first topic by name
    needles = keywords.groupBy("keyword").agg(F.min("topic").alias("topic")).withColumn("needle", F.col("keyword"))
    found = contains_pairs(intro.select("sid", probe.alias("probe")), needles, "sid", "probe", "keyword", "needle")
    rank = F.struct((-F.length("keyword")).alias("l"), F.col("topic"), F.col("keyword"))
    return (
        found.join(needles.select("keyword", "topic"), "keyword")
        .groupBy("sid")
        .agg(F.min(rank).alias("best"))
        .select("sid", "best.topic", "best.keyword")
    )


# --- attribution ---------------------------------------------------------------


def attribute(errors: DataFrame, rules: Sequence[R.Rule] = R.DEFAULT_RULES, face: str = "errors", subject: str = "error") -> DataFrame:
    """First matching rule of a face per row (null struct when none)."""
    return errors.withColumn("rule", R.attribution(F.col(subject), rules, face))


def attribution_summary(errors: DataFrame, rules: Sequence[R.Rule] = R.DEFAULT_RULES) -> DataFrame:
    """Per pattern: counts, tools, the rule of its first attributed error, all rule ids, conflict flag."""
    rows = attribute(errors, rules)
    place = F.struct("sid", "seq")
    first = F.min_by("rule", F.when(F.col("rule").isNotNull(), place))
    out = rows.groupBy("pattern").agg(
        F.min_by("class", place).alias("class"),
        F.count(F.lit(1)).alias("count"),
        F.count_if(~F.col("resolved")).alias("given_up"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        first.alias("rule"),
        F.array_sort(F.collect_set("rule.rule_id")).alias("rule_ids"),
    )
    return out.withColumn("conflict", F.size("rule_ids") > 1)


def attribution_anchors(errors: DataFrame, k: int = 5) -> DataFrame:
    return ST.top_per_group(errors, ["pattern"], [F.col("sid"), F.col("seq")], k).select(
        "pattern", "rank", "sid", "seq", text.clean_error_sample("error").alias("error")
    )


def attribution_totals(summary: DataFrame, rules: Sequence[R.Rule] = R.DEFAULT_RULES) -> DataFrame:
    """Totals and coverage percentages in one row."""
    hit = F.col("rule").isNotNull()
    totals = summary.agg(
        F.count(F.lit(1)).alias("patterns_total"),
        F.count_if(hit).alias("patterns_attributed"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("errors_total"),
        F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("errors_attributed"),
        F.count_distinct("rule.rule_id").alias("rules_hit"),
    )

    def pct(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.round(F.col(part) * 100.0 / F.col(whole), 1)).otherwise(F.lit(0.0))

    return totals.select(
        "*",
        F.lit(len(rules)).cast("long").alias("rules_total"),
        pct("patterns_attributed", "patterns_total").alias("pct_patterns"),
        pct("errors_attributed", "errors_total").alias("pct_errors"),
    )


def split_reviewed(summary: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add ``verdict`` to rows whose (pattern, rule) was reviewed; the others stay null."""
    reviewed = verdicts.select(F.col("pattern_key").alias("pattern"), F.col("rule_id").alias("rid"), "verdict")
    return summary.withColumn("rid", F.col("rule.rule_id")).join(reviewed, ["pattern", "rid"], "left").drop("rid")


# --- suggestions ------------------------------------------------------------------


def suggestions(totals: DataFrame, statuses: DataFrame, min_count: int = 3, max_items: int = 15) -> DataFrame:
    """Merged template groups with enough errors, most unresolved first, with ledger status."""
    known = statuses.select(F.col("key").alias("title"), "status")
    kept = totals.filter(F.col("total") >= min_count).join(known, "title", "left")
    return (
        kept.withColumn("status", F.coalesce("status", F.lit("pending")))
        .orderBy(F.desc("unresolved_count"), F.desc("total"), "title")
        .limit(max_items)
    )


def leftover_patterns(stats: DataFrame, groups: DataFrame) -> DataFrame:
    taken = groups.filter(F.col("root").isNotNull()).select("pattern")
    return stats.join(taken, "pattern", "left_anti").select("pattern", "count", "given_up").orderBy(
        F.desc("count"), F.desc("given_up"), "pattern"
    )


def ledger_coverage(suggested: DataFrame, ledger: DataFrame, topic_prefix: str = "topic:") -> DataFrame:
    """One row per key: decided, undecided, stale_adopted, stale_other or topic."""
    left = suggested.select(F.col("title").alias("key"), F.lit(True).alias("suggested")).distinct()
    joined = left.join(ledger.select("key", "status"), "key", "full_outer")
    status = F.coalesce("status", F.lit("pending"))
    place = (
        F.when(F.col("suggested") & (status != "pending"), "decided")
        .when(F.col("suggested"), "undecided")
        .when(F.col("key").startswith(topic_prefix), "topic")
        .when(F.col("status") == "adopted", "stale_adopted")
        .otherwise("stale_other")
    )
    return joined.select("key", "status", place.alias("place"))


# --- distillation triage --------------------------------------------------------------


def triage_patterns(errors: DataFrame, cutoff: str | None, min_count: int = 2, recurring_cap: int = 20) -> DataFrame:
    """Patterns with enough errors in the window: new ones, and the top recurring ones.

    first_seen counts a missing stamp as the empty string, over the whole history.
    """
    ts = F.coalesce("ts", F.lit(""))
    inside = F.lit(True) if cutoff is None else ts >= cutoff
    stats = (
        errors.groupBy("pattern")
        .agg(
            F.min_by("class", F.struct("sid", "seq")).alias("class"),
            F.min(ts).alias("first_seen"),
            F.count_if(inside).alias("count"),
            F.array_sort(F.collect_set("tool")).alias("tools"),
        )
        .filter((F.col("count") >= min_count) & (F.col("pattern") != ""))
    )
    is_new = F.lit(True) if cutoff is None else F.col("first_seen") >= cutoff
    marked = stats.withColumn("kind", F.when(is_new, "new").otherwise("recurring"))
    recurring = marked.filter(F.col("kind") == "recurring").orderBy(F.desc("count"), "pattern").limit(recurring_cap)
    return marked.filter(F.col("kind") == "new").unionByName(recurring)


def triage_skills(invocations: DataFrame, cutoff: str | None) -> DataFrame:
    """Skills used in the window with their first successful anchor and first chain."""
    rows = ST.recent(invocations.withColumn("ts", F.coalesce("ts", F.lit(""))), cutoff).filter(F.col("skill") != "")
    ok = F.col("status").isin(*ST.OK_STATUS)
    place = F.struct("sid", "seq")
    return rows.groupBy("skill").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(ok).alias("n_ok"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(F.when(ok, F.concat_ws("#", "sid", F.format_string("%09d", "seq")))).alias("sample"),
        F.min_by("after_tools", F.when(ok & (F.size("after_tools") > 0), place)).alias("chain"),
    )


def known_by_cards(keys: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Add known_card: the loosely normalised key occurs in a card's text."""
    needle = text.loose_key(key)
    body = text.loose_key(F.concat_ws("\n", "title", "evidence", "summary"))
    needles = keys.select(F.col(key).alias("__k"), needle.alias("__needle")).distinct()
    hits = contains_pairs(cards.select("id", body.alias("__body")), needles, "id", "__body", "__k", "__needle")
    known = hits.select(F.col("__k").alias(key)).distinct().withColumn("known_card", F.lit(True))
    return keys.join(known, key, "left").withColumn("known_card", F.coalesce("known_card", F.lit(False)))


# --- intent triage -----------------------------------------------------------------------


def intent_triage(
    sessions: DataFrame,
    messages: DataFrame,
    topics: DataFrame,
    members: DataFrame,
    noise: DataFrame,
    *,
    lookup_words: Sequence[str],
    integrate_words: Sequence[str],
    craft_words: Sequence[str],
    max_turns: int = 3,
    include_deep: bool = False,
    coherence: bool = True,
) -> DataFrame:
    """Verdict per unassigned session; sessions over max_turns are never noise.

    Without ``coherence`` that column is left out, and the grams of all turns with it.
    """
    users = messages.filter(F.col("role") == "user").select("sid", "seq", "role", F.coalesce("raw", F.lit("")).alias("raw"))
    filled = text.strip("raw") != ""
    counts = users.groupBy("sid").agg(
        F.count(F.lit(1)).alias("user_turns"),
        F.count_if(filled).alias("turns"),
        F.min_by("raw", F.when(filled, F.col("seq"))).alias("first_user"),
    )
    open_sessions = (
        sessions.select("sid", "source", "title", "created_at")
        .join(members.select("sid").distinct(), "sid", "left_anti")
        .join(noise.select("sid").distinct(), "sid", "left_anti")
        .join(counts, "sid")
        .filter(F.col("turns") > 0)
    )
    if not include_deep:
        open_sessions = open_sessions.filter(F.col("user_turns") <= max_turns)
    # read twice below; the stage that joins the hints then sorts these rows only
    open_sessions = materialize(open_sessions)
    joined = open_sessions.join(topic_hints(open_sessions, topics), "sid", "left")
    if coherence:
        joined = joined.join(SQ.coherence(messages).select("sid", "coherence"), "sid", "left")
    lookup = text.contains_any("first_user", lookup_words)
    integrate = text.contains_any("first_user", integrate_words)
    craft = text.contains_any("first_user", craft_words)
    hinted = F.col("topic").isNotNull()
    shallow = (
        F.when(hinted, "topic_hint")
        .when(integrate, "substantive")
        .when(craft, "craft_material")
        .when(lookup & (F.col("turns") == 1), "noise_high")
        .when(lookup, "noise_maybe")
        .otherwise("substantive")
    )
    deep = F.when(hinted, "deep_topic_hint").otherwise("deep_unassigned")
    return joined.select(
        "sid",
        "source",
        text.head(F.coalesce("title", F.lit("")), 44).alias("title"),
        text.head(F.coalesce("created_at", F.lit("")), 10).alias("created_at"),
        text.head("first_user", 200).alias("first_user"),
        F.when(F.col("user_turns") > max_turns, deep).otherwise(shallow).alias("verdict"),
        "topic",
        lookup.alias("lookup"),
        integrate.alias("integrate"),
        craft.alias("craft"),
        "turns",
        *([F.round("coherence", 3).alias("coherence")] if coherence else []),
    )


def noise_candidates(sessions: DataFrame, messages: DataFrame, steps: DataFrame, members: DataFrame, max_chars: int = 40) -> DataFrame:
    """Sessions with exactly one user turn, a short opening, no topic and no steps."""
    users = messages.filter(F.col("role") == "user").groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("raw", "seq").alias("first_user")
    )
    short = users.filter((F.col("n") == 1) & (F.length(text.strip(F.coalesce("first_user", F.lit("")))) < max_chars))
    return (
        sessions.select("sid", "title")
        .join(short.select("sid", "first_user"), "sid")
        .join(members.select("sid").distinct(), "sid", "left_anti")
        .join(steps.select("sid").distinct(), "sid", "left_anti")
    )


# --- before/after evaluation -----------------------------------------------------------------

#: Parts into which sessions are dealt, so that a pattern's errors of one day spread over as many tasks.
PARTS = 8


def evaluate_rules(
    ledger: DataFrame,
    errors: DataFrame,
    since: str | None = None,
    *,
    window_days: int = 7,
    min_per_window: int = 5,
    min_total: int = 20,
    threshold: float = 0.10,
    topic_prefix: str = "topic:",
) -> DataFrame:
    """Adopted entries judged by errors before and after their boundary.

    Targets (note patterns, else the key) meet distinct error patterns by
    equality or by exact substring joins.  Windows are cut into days and errors, counted per pattern,
    session and second, meet them by pattern, day and a hash of the session: only errors of a window's days
    are joined, and one pattern with most errors is spread over days and tasks.
    """
    if window_days < 1:
        raise ValueError("window_days must be at least 1")
    errors = materialize(errors.select("pattern", "sid", "ts", "resolved"))
    adopted = ledger.filter((F.col("status") == "adopted") & ~F.col("key").startswith(topic_prefix))
    stamp = _parse_stamp("adopted_at")
    fallback = F.lit(since).cast("string") if since else F.lit(None).cast("string")
    entries = adopted.select(
        "key",
        text.note_patterns("note").alias("note_patterns"),
        F.coalesce(stamp, _parse_stamp_col(fallback)).alias("boundary"),
    )
    targets = entries.select(
        "key",
        F.explode(F.when(F.size("note_patterns") > 0, F.col("note_patterns")).otherwise(F.array("key"))).alias("target"),
    ).select("key", text.normalize_error("target").alias("target")).filter(F.col("target") != "").distinct()
    patterns = errors.select("pattern").filter(F.col("pattern") != "").distinct()
    hit_patterns = materialize(_hit_patterns(targets, patterns))
    # errors are counted per pattern, session and second before entries meet them
    cells = errors.filter(F.coalesce("ts", F.lit("")) != "").groupBy("pattern", "sid", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("resolved")).alias("open")
    )
    hits = _count_union(hit_patterns, errors).select("key", F.col("errors").alias("pattern_hits"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    bounded = entries.filter(F.col("boundary").isNotNull()).select(
        "key",
        F.date_format("boundary", fmt).alias("mid"),
        F.date_format(F.col("boundary") - F.make_dt_interval(F.lit(window_days)), fmt).alias("lo"),
        F.date_format(F.col("boundary") + F.make_dt_interval(F.lit(window_days)), fmt).alias("hi"),
    )
    days = F.transform(F.sequence(F.to_date("lo"), F.to_date("hi")), lambda d: d.cast("string"))
    windowed = (
        bounded.join(hit_patterns, "key")
        .withColumn("bin", F.explode(F.concat(days, F.array(F.lit("")))))  # '' for stamps that start with no date
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    )
    day = F.substring("ts", 1, 10)
    dated = F.coalesce(F.expr("cast(try_cast(substring(ts, 1, 10) as date) as string)") == day, F.lit(False))
    binned = cells.withColumn("bin", F.when(dated, day).otherwise("")).withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(PARTS)).cast("int"))
    placed = (
        windowed.join(binned, ["pattern", "bin", "part"])
        .filter((F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi")))
        .withColumn("side", F.when(F.col("ts") < F.col("mid"), "before").otherwise("after"))
    )
    per_session = placed.groupBy("key", "side", "sid").agg(F.sum("n").alias("n"), F.sum("open").alias("open"))
    windows = per_session.groupBy("key").agg(
        *[
            agg.alias(f"{side}_{name}")
            for side in ("before", "after")
            for name, agg in (
                ("errors", F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))),
                ("unresolved", F.coalesce(F.sum(F.when(F.col("side") == side, F.col("open"))), F.lit(0))),
                ("sessions", F.count_if(F.col("side") == side)),
                ("recurred", F.count_if((F.col("side") == side) & (F.col("n") >= 2))),
            )
        ]
    )
    joined = entries.join(windows, "key", "left").join(hits, "key", "left")
    zero = F.lit(0).cast("long")
    names = [f"{s}_{n}" for s in ("before", "after") for n in ("errors", "unresolved", "sessions", "recurred")]
    filled = joined.select(
        "key",
        "boundary",
        (F.size("note_patterns") > 0).alias("from_note"),
        F.coalesce("pattern_hits", zero).alias("pattern_hits"),
        *[F.coalesce(n, zero).alias(n) for n in names],
    )
    ub, ua = _rate("before_unresolved", "before_errors"), _rate("after_unresolved", "after_errors")
    rb, ra = _rate("before_recurred", "before_sessions"), _rate("after_recurred", "after_sessions")
    du, dr = relative_change(ub, ua), relative_change(rb, ra)
    limit = F.lit(threshold - 1e-9)
    few = (
        (F.col("before_errors") < min_per_window)
        | (F.col("after_errors") < min_per_window)
        | (F.col("before_errors") + F.col("after_errors") < min_total)
    )
    worse = F.coalesce(du >= limit, F.lit(False)) | F.coalesce(dr >= limit, F.lit(False))
    better = F.coalesce(du <= -limit, F.lit(False)) | F.coalesce(dr <= -limit, F.lit(False))
    verdict = (
        F.when(F.col("boundary").isNull() | few, "inconclusive").when(worse, "worsened").when(better, "improved").otherwise("unchanged")
    )
    return filled.select(
        "key",
        F.date_format("boundary", fmt).alias("boundary"),
        "from_note",
        "pattern_hits",
        *names,
        ub.alias("before_unresolved_rate"),
        ua.alias("after_unresolved_rate"),
        rb.alias("before_recurrence_rate"),
        ra.alias("after_recurrence_rate"),
        du.alias("delta"),
        verdict.alias("verdict"),
        F.when(F.col("boundary").isNull(), "no boundary").when(few, "few samples").alias("reason"),
    )


def _parse_stamp_col(col: Column) -> Column:
    return F.coalesce(
        F.when(col.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), col.try_cast("timestamp_ntz")),
        F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), col.try_cast("timestamp_ntz")),
    )


def _parse_stamp(name: str) -> Column:
    return _parse_stamp_col(F.col(name))


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) / before; from 0 to more counts as +100 %; null when a side is null."""
    return F.when(before.isNull() | after.isNull(), F.lit(None).cast("double")).when(
        before == 0, F.when(after <= 0, 0.0).otherwise(1.0)
    ).otherwise((after - before) / before)


def pattern_union(targets: DataFrame, errors: DataFrame) -> DataFrame:
    """(key, patterns, errors) of every key of ``targets`` (key, target): what its targets hit together.

    An error that several targets of a key hit counts once.  Keys whose targets hit nothing have no row.
    """
    errors = materialize(errors.select("pattern"))
    patterns = errors.filter(F.col("pattern") != "").distinct()
    return _count_union(_hit_patterns(targets.select("key", "target").filter(F.col("target") != "").distinct(), patterns), errors)


def _hit_patterns(targets: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, pattern), each once."""
    matched = _match_patterns(targets.select("target").distinct(), patterns)
    return targets.join(matched, "target").select("key", "pattern").distinct()


def _count_union(hit_patterns: DataFrame, errors: DataFrame) -> DataFrame:
    totals = errors.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return hit_patterns.join(totals, "pattern").groupBy("key").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("errors"))


def _match_patterns(targets: DataFrame, patterns: DataFrame) -> DataFrame:
    """(target, pattern) equal, or one inside the other with the shorter having 8+ characters."""
    t = targets.select("target", F.col("target").alias("t_text"))
    p = patterns.select("pattern", F.col("pattern").alias("p_text"))
    equal = t.join(p, F.col("t_text") == F.col("p_text")).select("target", "pattern")
    long_t, long_p = t.filter(F.length("t_text") >= 8), p.filter(F.length("p_text") >= 8)
    t_in_p = contains_pairs(long_p, long_t, "pattern", "p_text", "target", "t_text").select("target", "pattern")
    p_in_t = contains_pairs(long_t, long_p, "target", "t_text", "pattern", "p_text").select("target", "pattern")
    return equal.unionByName(t_in_p).unionByName(p_in_t).distinct()


# --- review levels and packs ----------------------------------------------------------------------

#: Review levels, weakest first.
LEVELS = ("R0", "R1", "R2", "R3")


def review_level(entries: Column, candidates: Column, write_back: Column) -> Column:
    return F.when(entries <= 0, "R0").when(candidates <= 0, "R1").when(write_back, "R3").otherwise("R2")


def weakest_level(df: DataFrame, level: str = "level") -> DataFrame:
    """Lowest level of the rows; R0 when there is none."""
    return df.agg(F.coalesce(F.min(level), F.lit("R0")).alias("level"))


REVIEW_VERDICTS = ("accepted", "rejected", "revise")


def _numbered(rows: DataFrame, prefix: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with ids like E-001; the limit is applied before numbering."""
    top = rows.orderBy(*order).limit(limit).withColumn("__one", F.lit(1))
    ranked = ST.top_per_group(top, ["__one"], order, limit, "__n")
    return ranked.withColumn("item_id", F.concat(F.lit(prefix + "-"), F.lpad(F.col("__n").cast("string"), 3, "0"))).drop("__one", "__n")


def review_pack(
    attribution: DataFrame,
    tools: DataFrame,
    skills: DataFrame,
    chains: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    limit: int = 40,
    rules: Sequence[R.Rule] = R.DEFAULT_RULES,
) -> DataFrame:
    """Numbered items of every face with facts as JSON and the rule candidate."""
    facts_errors = F.to_json(F.struct("count", "given_up", "tools"))
    by_count = [F.desc("count"), F.col("pattern")]
    numbered = _numbered(attribution, "E", by_count, limit)
    parts = [
        numbered.select(
            "item_id", F.lit("errors").alias("face"), F.col("pattern").alias("subject"), facts_errors.alias("facts"), F.col("rule.rule_id").alias("rule_id")
        )
    ]
    if verdicts is not None:
        reviewed = split_reviewed(attribution, verdicts)
        facts = F.to_json(
            F.struct("count", "given_up", "tools", F.coalesce("verdict", F.lit("")).alias("reviewed"), F.col("rule").isNull().alias("rule_gap"))
        )
        parts.append(
            _numbered(reviewed, "A", by_count, limit).select(
                "item_id", F.lit("attrib").alias("face"), F.col("pattern").alias("subject"), facts.alias("facts"), F.col("rule.rule_id").alias("rule_id")
            )
        )
    failing = tools.filter(F.col("error") > 0).withColumn("fail_rate", F.round(F.col("error") / F.col("calls"), 4))
    parts.append(
        _numbered(failing, "T", [F.desc("error"), F.col("tool")], limit).select(
            "item_id",
            F.lit("tools").alias("face"),
            F.col("tool").alias("subject"),
            F.to_json(F.struct("calls", "error", "fail_rate", "given_up")).alias("facts"),
            R.attribution(F.col("tool"), rules, "tools")["rule_id"].alias("rule_id"),
        )
    )
    parts.append(
        _numbered(skills.filter(F.col("skill") != ""), "S", [F.desc("calls"), F.col("skill")], limit).select(
            "item_id",
            F.lit("skills").alias("face"),
            F.col("skill").alias("subject"),
            F.to_json(F.struct("calls", "ok", "err", "no_result")).alias("facts"),
            R.attribution(F.col("skill"), rules, "skills")["rule_id"].alias("rule_id"),
        )
    )
    if chains is not None:
        parts.append(
            _numbered(chains, "C", [F.col("chain_id")], limit).select(
                "item_id",
                F.lit("chains").alias("face"),
                F.col("chain_id").alias("subject"),
                F.to_json(F.struct("members", "anchored_members")).alias("facts"),
                R.attribution(F.col("chain_id"), rules, "chains")["rule_id"].alias("rule_id"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("verdict", F.lit(""))


def check_pack(items: DataFrame, slots: DataFrame) -> DataFrame:
    """Problems of a filled pack: (item_id, problem)."""
    copies = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("item_subject"))
    joined = copies.join(slots.select("item_id", "subject", F.col("verdict").alias("given")), "item_id", "full_outer")
    problems = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "slot without item"),
            F.when(F.col("subject").isNull() & F.col("n").isNotNull(), "item without slot"),
            F.when(F.col("n") > 1, "item id repeated"),
            F.when(F.col("n").isNotNull() & (F.col("subject") != F.col("item_subject")), "subject differs"),
            F.when(~F.coalesce("given", F.lit("")).isin("", *REVIEW_VERDICTS), "unknown verdict"),
        )
    )
    return joined.select("item_id", F.explode(problems).alias("problem"))


# --- ledgers -------------------------------------------------------------------------------------------


def ledger_upsert(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply status updates in order: key, status, adopted_at, note, updated_at, entry_no.

    adopted keeps an earlier adoption stamp unless one is given (else the
    update's own stamp); leaving adopted clears it.  note null keeps, '' clears
    the text to empty.  The state after all updates follows from the last
    update, the last note given, and the last unbroken stretch of adoption.
    """
    seed = current.select("key", "status", "adopted_at", "note", "updated_at", F.lit(-1).cast("long").alias("entry_no"))
    log = seed.unionByName(updates.select("key", "status", "adopted_at", "note", "updated_at", F.col("entry_no").cast("long").alias("entry_no")))
    place = F.struct("updated_at", "entry_no")
    broken = (
        log.filter(F.col("status") != "adopted").groupBy("key").agg(F.max(place).alias("broken_at"))
    )
    last = log.groupBy("key").agg(
        F.max_by("status", place).alias("status"),
        F.max("updated_at").alias("updated_at"),
        F.max_by("note", F.when(F.col("note").isNotNull(), place)).alias("note"),
    )
    stretch = (
        log.join(broken, "key", "left")
        .filter((F.col("status") == "adopted") & (F.col("broken_at").isNull() | (place > F.col("broken_at"))))
        .groupBy("key")
        .agg(
            F.max_by("adopted_at", F.when(F.col("adopted_at").isNotNull(), place)).alias("given"),
            F.min_by(
                F.when(F.col("entry_no") >= 0, F.col("updated_at")), F.when(F.col("entry_no") >= 0, place)
            ).alias("started"),
        )
    )
    joined = last.join(stretch, "key", "left")
    return joined.select(
        "key",
        "status",
        F.when(F.col("status") == "adopted", F.coalesce("given", "started")).alias("adopted_at"),
        "note",
        "updated_at",
    )


def ledger_sync(ledger: DataFrame, derived: DataFrame) -> DataFrame:
    """Action per derived row: created, filled (adopted_at was empty) or unchanged."""
    current = ledger.select("key", F.col("adopted_at").alias("has"), F.lit(True).alias("exists"))
    joined = derived.filter(F.coalesce("key", F.lit("")) != "").join(current, "key", "left")
    action = (
        F.when(F.col("exists").isNull(), "created")
        .when((F.coalesce("has", F.lit("")) == "") & (F.coalesce("adopted_at", F.lit("")) != ""), "filled")
        .otherwise("unchanged")
    )
    return joined.select("key", action.alias("action"), "status", "adopted_at", "note")


def apply_sync(ledger: DataFrame, derived: DataFrame, stamp: str) -> DataFrame:
    """Ledger after the sync: created rows added, empty adopted_at filled, nothing overwritten."""
    actions = ledger_sync(ledger, derived)
    fills = actions.filter(F.col("action") == "filled").select("key", F.col("adopted_at").alias("fill"))
    kept = ledger.join(fills, "key", "left").select(
        "key",
        "status",
        F.when(F.col("fill").isNotNull() & (F.col("status") == "adopted"), F.col("fill")).otherwise(F.col("adopted_at")).alias("adopted_at"),
        "note",
        F.when(F.col("fill").isNotNull(), stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    new = actions.filter(F.col("action") == "created").select(
        "key", "status", "adopted_at", "note", F.lit(stamp).alias("updated_at")
    )
    return kept.unionByName(new)


def backfill_adopted_at(ledger: DataFrame) -> DataFrame:
    """Adopted rows without a stamp take their last update's stamp."""
    empty = (F.col("status") == "adopted") & (F.coalesce("adopted_at", F.lit("")) == "") & (F.coalesce("updated_at", F.lit("")) != "")
    return ledger.withColumn("adopted_at", F.when(empty, F.col("updated_at")).otherwise(F.col("adopted_at")))


def upsert_verdicts(current: DataFrame, updates: DataFrame, keys: Sequence[str] = ("face", "subject", "key")) -> DataFrame:
    """Verdict per key: the latest wins (updates after current rows on equal stamps, then the larger values)."""
    columns = [c for c in current.columns]
    both = current.withColumn("__late", F.lit(0)).unionByName(updates.select(*columns).withColumn("__late", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("reviewed_at", "__late", *rest)).alias("r"))
    return latest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
