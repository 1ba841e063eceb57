"""Near-duplicate sessions, topic candidates and template groups."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.functions import text
from tracewell.operators import steps as ST
from tracewell.plans import alike, similar
from tracewell.plans.components import connected_components
from tracewell.plans.contains import contains_pairs
from tracewell.plans.scan import Running, running_scan, seq_block
from tracewell.session import materialize, stored

#: Similarity limits of the duplicate search.
DUP_THRESHOLD = 0.90
BAND_THRESHOLD = 0.80
DISCOVER_CHARS = 2000
DISCOVER_J = 0.75
SIZE_RATIO = 0.70
#: Feature weights and similarity limit of topic candidates.
WEIGHTS = {"title": 0.5, "first": 0.3, "tools": 0.2}
MIN_SIM = 0.35
_FEATURES = {"title": "title_grams", "first": "first_grams", "tools": "tools"}
#: Pairs of a component whose greedy one task does.
COMPONENT_EDGES = 200_000


def session_grams(messages: DataFrame, limit: int | None = None, name: str = "grams") -> DataFrame:
    """Bigram set of each session's joined user text (optionally its first ``limit`` characters).

    Messages are never joined to one string: bigrams inside messages and the
    ones across neighbouring messages are collected as a set.
    """
    users = messages.filter(F.col("role") == "user").select("sid", "seq", F.coalesce("raw", F.lit("")).alias("raw"))
    if limit is not None:
        upto = running_scan(users, ["sid"], ["seq"], seq_block(), {"upto": Running("sum", F.length("raw"))})
        start = F.col("upto") - F.length("raw")
        users = upto.filter(start < limit).select(
            "sid", "seq", F.substring("raw", F.lit(1), (F.lit(limit) - start).cast("int")).alias("raw")
        )
    clean = users.select("sid", "seq", text.squash("raw").alias("clean")).filter(F.col("clean") != "")
    tail = F.struct(F.right("clean", F.lit(1)).alias("c"))
    linked = running_scan(clean, ["sid"], ["seq"], seq_block(), {"before": Running("prev", tail)})
    across = F.when(F.col("before").isNotNull(), F.array(F.concat("before.c", text.head("clean", 1)))).otherwise(
        F.array().cast("array<string>")
    )
    grams = F.array_distinct(F.concat(text.bigrams("clean"), across))
    return (
        linked.select("sid", F.explode(grams).alias("gram")).groupBy("sid").agg(F.collect_set("gram").alias(name))
    )


def zero_user_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    users = messages.filter(F.col("role") == "user").select("sid").distinct()
    return sessions.join(users, "sid", "left_anti").select("sid", F.coalesce("title", F.lit("")).alias("title"))


def no_text_sessions(sessions: DataFrame, grams: DataFrame) -> DataFrame:
    """Sessions whose user text has no bigram."""
    return sessions.join(grams.select("sid"), "sid", "left_anti").select("sid")


def _classes(
    items: DataFrame, group: Sequence[str], arrays: Sequence[str], known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Items (those not ``known``) with their class, and one row per class; grams become 64-bit hashes.

    Texts are turned into gram sets once and stored in order, which packs well; both results are read from that.
    Sets are shuffled once, the rest works on ids.
    """
    hashed = items.select(
        "sid",
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        *group,
        *[F.array_sort(F.transform(a, lambda g: F.xxhash64(g))).alias(a) for a in arrays],
    )
    keyed = stored(similar.with_class(hashed, group, arrays).withColumns({f"n_{a}": F.size(a) for a in arrays}))
    for a in arrays:
        keyed = keyed.filter(F.col(f"n_{a}") > 0)
    members = keyed.select("sid", "created_at", *group, "class_key")
    if known is not None:
        members = materialize(members.join(known.select("sid").distinct(), "sid", "left_anti"))
    named = members.groupBy("class_key").agg(F.min("sid").alias("cls"), F.count(F.lit(1)).alias("copies"))
    sets = keyed.groupBy("class_key").agg(F.first(F.struct(*group, *arrays)).alias("c"))
    columns = [F.col(f"c.{c}").alias(c) for c in [*group, *arrays]]
    classes = stored(sets.join(named, "class_key").select("class_key", "cls", "copies", *columns, F.size("c.grams").alias("n")))
    return materialize(members.join(classes.select("class_key", "cls"), "class_key").drop("class_key")), classes.drop("class_key")


def duplicate_clusters(
    items: DataFrame, threshold: float = DUP_THRESHOLD, group: Sequence[str] = (), parity: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """(group, rep, sid, jaccard) for every member of a cluster of two or more but its representative.

    Items that are ``known`` (sid) are left out.

    ``items`` has sid, created_at, grams (and ``head_grams`` when ``parity``:
    pairs must then also pass the prefilter on the first characters).  The
    representative is the earliest by (created_at, sid).  ``jaccard`` is null
    for members joined only through others.
    """
    group = list(group)
    arrays = ["grams", "head_grams"] if parity else ["grams"]
    members, classes = _classes(items, group, arrays, known)
    classes = classes.drop("copies")
    extra = _passes_prefilter if parity else None
    comps = similar.class_clusters(classes, threshold, group, extra)
    labelled = members.join(comps, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    sizes = labelled.groupBy(*group, "component").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("created_at", "sid", "cls")).alias("rep")
    )
    clustered = labelled.join(sizes.filter(F.col("size") > 1), [*group, "component"]).filter(F.col("sid") != F.col("rep.sid"))
    pairs = clustered.select(
        F.least("cls", "rep.cls").alias("a"), F.greatest("cls", "rep.cls").alias("b")
    ).filter(F.col("a") != F.col("b")).distinct()
    pairs = materialize(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    compared = materialize(classes.select("cls", *arrays).join(ends, "cls", "left_semi"))
    direct = similar._verify(pairs, compared, threshold, extra)
    placed = clustered.select(
        *group,
        F.col("rep.sid").alias("rep"),
        "sid",
        "cls",
        F.col("rep.cls").alias("rep_cls"),
        F.least("cls", "rep.cls").alias("a"),
        F.greatest("cls", "rep.cls").alias("b"),
    ).join(direct, ["a", "b"], "left")
    j = F.when(F.col("cls") == F.col("rep_cls"), F.lit(1.0)).otherwise(F.round("j", 3))
    return placed.select(*group, "rep", "sid", j.alias("jaccard"))


def duplicate_candidates(items: DataFrame, known: DataFrame, threshold: float = DUP_THRESHOLD) -> DataFrame:
    """Duplicate clusters among the sessions that are not ``known`` (sid)."""
    return duplicate_clusters(items, threshold, known=known)


def _passes_prefilter(a: Column, b: Column) -> Column:
    na, nb = F.size(a["head_grams"]), F.size(b["head_grams"])
    both = F.size(F.array_intersect(a["head_grams"], b["head_grams"]))
    return (F.least(na, nb) >= F.greatest(na, nb) * F.lit(SIZE_RATIO)) & (both / (na + nb - both) >= F.lit(DISCOVER_J))


def similar_pairs(items: DataFrame, threshold: float = BAND_THRESHOLD, group: Sequence[str] = ()) -> DataFrame:
    """Pairs of different texts at or above the threshold, with kind duplicate or band.

    One row per pair of distinct texts, named by the smallest sid holding each,
    with the number of holders: copies are counted, not paired.
    """
    group = list(group)
    _, classes = _classes(items, group, ["grams"])
    pairs = similar.class_pairs(classes, threshold, group, keep=["copies"])
    return (
        pairs.select(
            "a",
            "b",
            "a_copies",
            "b_copies",
            F.round("j", 3).alias("jaccard"),
            F.when(F.col("j") >= DUP_THRESHOLD, "duplicate").otherwise("band").alias("kind"),
        )
    )


def dedupe_summary(items: DataFrame, clusters: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """members, reps and duplicates per group."""
    group = list(group)
    total = items.groupBy(*group).agg(F.count(F.lit(1)).alias("members"))
    dups = clusters.groupBy(*group).agg(F.count(F.lit(1)).alias("duplicates"))
    joined = total.join(dups, group, "left") if group else total.join(dups, how="left")
    joined = joined.withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))
    return joined.withColumn("reps", F.col("members") - F.col("duplicates"))


def filter_clusters(clusters: DataFrame, min_jaccard: float) -> DataFrame:
    """Members at or above a similarity, and those without one; clusters left empty vanish."""
    return clusters.filter(F.col("jaccard").isNull() | (F.col("jaccard") >= min_jaccard))


def dropped_by_filter(clusters: DataFrame, min_jaccard: float) -> DataFrame:
    return clusters.agg(F.count_if(F.col("jaccard") < min_jaccard).alias("dropped"))


# --- topic candidates -------------------------------------------------------------


def candidate_features(
    sessions: DataFrame, messages: DataFrame, steps: DataFrame, exclude: DataFrame | None = None, top_tools: int = 3
) -> DataFrame:
    """Title bigrams, first-user bigrams (200 characters) and top tools per session."""
    kept = sessions.select("sid", F.coalesce("title", F.lit("")).alias("title"))
    if exclude is not None:
        kept = kept.join(exclude.select("sid").distinct(), "sid", "left_anti")
    body = text.squash(F.coalesce("raw", F.lit("")))
    firsts = (
        messages.filter((F.col("role") == "user") & (body != ""))
        .groupBy("sid")
        .agg(F.min_by("raw", "seq").alias("raw"))
        .select("sid", text.head(text.squash("raw"), 200).alias("first_user"))
    )
    counted = steps.filter(F.coalesce("tool", F.lit("")) != "").groupBy("sid", "tool").agg(F.count(F.lit(1)).alias("n"))
    tops = (
        ST.top_per_group(counted, ["sid"], [F.desc("n"), F.col("tool")], top_tools)
        .groupBy("sid")
        .agg(F.collect_set("tool").alias("tools"))
    )
    return kept.join(firsts, "sid", "left").join(tops, "sid", "left").select(
        "sid",
        "title",
        F.array_distinct(text.bigrams("title")).alias("title_grams"),
        F.array_distinct(text.bigrams("first_user")).alias("first_grams"),
        F.coalesce("tools", F.array().cast("array<string>")).alias("tools"),
    )


def _may_reach(weights: dict[str, float], min_sim: float) -> Column:
    """Whether the sizes of rows x and y allow the similarity: a Jaccard is at most the ratio of the sizes."""
    top, base = F.lit(0.0), F.lit(0.0)
    for name in _FEATURES:
        a, b = F.col(f"x.sizes.{name}"), F.col(f"y.sizes.{name}")
        both = (a > 0) & (b > 0)
        w = F.lit(float(weights[name]))
        top = top + F.when(both, w * F.least(a, b) / F.greatest(a, b)).otherwise(0.0)
        base = base + F.when(both, w).otherwise(0.0)
    return (base > 0) & (top >= base * min_sim - F.lit(1e-9))


def _weights(weights: dict[str, float] | None) -> dict[str, float]:
    merged = {**WEIGHTS, **(weights or {})}
    return {c: float(merged[n]) for n, c in _FEATURES.items()}


def candidate_pairs(
    features: DataFrame, weights: dict[str, float] | None = None, min_sim: float = MIN_SIM, max_posting: int | None = None
) -> DataFrame:
    """Pairs sharing a gram of title or opening, at or above the similarity.

    ``max_posting`` leaves out grams that more sessions hold; there is no limit
    by default.  Features missing on either side drop out of the weights.

    Most sessions of one language share most grams, so sessions are compared in pairs of blocks (``plans/alike.py``).
    The pairs themselves grow with the square of like sessions; ``candidate_clusters`` needs none of them.
    """
    if max_posting is None:
        return alike.near_pairs(alike.hashed(features, list(_FEATURES.values())), alike.rule(_weights(weights), min_sim))
    weights = {**WEIGHTS, **(weights or {})}
    features = materialize(
        features.select("sid", *[F.transform(c, lambda g: F.xxhash64(g)).alias(c) for c in _FEATURES.values()]).withColumn(
            "sizes", F.struct(*[F.size(c).alias(n) for n, c in _FEATURES.items()]))
    )
    reach = _may_reach(weights, min_sim)
    rows = features.select("sid", "sizes", F.explode(F.array_union("title_grams", "first_grams")).alias("gram"))
    common = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= max_posting))
    side = rows.join(common.select("gram"), "gram", "left_semi")
    pairs = _met(side, side, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.sid") < F.col("y.sid")) & reach)
    payload = F.struct(*_FEATURES.values())
    joined = pairs.join(features.select(F.col("sid").alias("a"), payload.alias("fa")), "a").join(
        features.select(F.col("sid").alias("b"), payload.alias("fb")), "b"
    )
    top, base = F.lit(0.0), F.lit(0.0)
    for name, column in _FEATURES.items():
        a, b = F.col(f"fa.{column}"), F.col(f"fb.{column}")
        present = (F.size(a) > 0) & (F.size(b) > 0)
        both = F.size(F.array_intersect(a, b))
        w = F.lit(float(weights[name]))
        top = top + F.when(present, w * (both / (F.size(a) + F.size(b) - both))).otherwise(0.0)
        base = base + F.when(present, w).otherwise(0.0)
    sim = F.when(base > 0, top / base).otherwise(0.0)
    return joined.select("a", "b", sim.alias("sim")).filter(F.col("sim") >= min_sim)


def _met(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
    """(a, b), a < b, of rows that meet the condition, once."""
    joined = x.alias("x").join(y.alias("y"), condition)
    return joined.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def candidate_clusters(
    features: DataFrame, weights: dict[str, float] | None = None, min_sim: float = MIN_SIM, min_size: int = 2
) -> DataFrame:
    """``seed_clusters`` of the candidate pairs, without listing these: (seed, sid, sim, size)."""
    sets = alike.hashed(features, list(_FEATURES.values()))
    return _sized(alike.near_clusters(sets, alike.rule(_weights(weights), min_sim)), min_size)


def _sized(rows: DataFrame, min_size: int) -> DataFrame:
    rows = rows.withColumn("sim", F.round("sim", 3))
    counted = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(counted.filter(F.col("size") >= min_size), "seed")


def _greedy(edges: pd.DataFrame) -> pd.DataFrame:
    """Seeds of one component visited one by one: degree descending, then sid; each takes its neighbours that are left."""
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, sim in zip(edges["a"], edges["b"], edges["sim"]):
        near.setdefault(a, []).append((b, sim))
        near.setdefault(b, []).append((a, sim))
    rows, taken = [], set()
    for seed in sorted(near, key=lambda s: (-len(near[s]), s)):
        if seed not in taken:
            taken.add(seed)
            rows.append((seed, seed, 1.0))
            rows += [(seed, other, sim) for other, sim in near[seed] if other not in taken]
            taken.update(other for other, _ in near[seed])
    return pd.DataFrame(rows, columns=["seed", "sid", "sim"])


def seed_clusters(pairs: DataFrame, min_size: int = 2, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """Greedy seed clusters: (seed, sid, sim), seeds by degree descending, then sid.

    The greedy of one component does not depend on others, so each runs in a task of its own.  Components of more
    than ``component_edges`` pairs are worked off in rounds over the cluster instead; both ways give the same.
    """
    pairs = materialize(pairs.select("a", "b", "sim"))
    components = connected_components(pairs).select(F.col("node").alias("a"), "component")
    placed = materialize(pairs.join(components, "a"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    large = materialize(sizes.filter(F.col("edges") > component_edges).select("component"))
    small = placed.join(large, "component", "left_anti")
    rows = small.groupBy("component").applyInPandas(_greedy, "seed string, sid string, sim double")
    if not large.isEmpty():
        rows = rows.unionByName(_seeds_in_rounds(placed.join(large, "component", "left_semi").drop("component")))
    return _sized(rows, min_size)


def _seeds_in_rounds(pairs: DataFrame) -> DataFrame:
    """(seed, sid, sim) of large components.

    A session is a seed when no earlier seed is its neighbour, so seeds are
    found in rounds: every undecided session that precedes all its undecided
    neighbours becomes a seed and its neighbours are taken.  This is the same
    result as visiting sessions one by one.
    """
    both = materialize(
        pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim").unionByName(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "sim")
        )
    )
    degree = both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = materialize(degree.select("node", F.struct((-F.col("degree")).alias("d"), F.col("node").alias("s")).alias("rank")))
    ranked = materialize(
        both.join(nodes.select(F.col("node").alias("u"), F.col("rank").alias("ru")), "u")
        .join(nodes.select(F.col("node").alias("v"), F.col("rank").alias("rv")), "v")
        .select("u", "v", "ru", "rv")
    )
    state = materialize(nodes.select("node", F.lit(0).alias("state")))  # 0 undecided, 1 seed, 2 taken
    while True:
        open_nodes = state.filter(F.col("state") == 0).select("node")
        live = ranked.join(open_nodes.select(F.col("node").alias("u")), "u", "left_semi").join(
            open_nodes.select(F.col("node").alias("v")), "v", "left_semi"
        )
        blocked = live.filter(F.col("rv") < F.col("ru")).select(F.col("u").alias("node")).distinct()
        new_seeds = open_nodes.join(blocked, "node", "left_anti").withColumn("now", F.lit(1))
        taken = (
            live.join(new_seeds.select(F.col("node").alias("v")), "v", "left_semi")
            .select(F.col("u").alias("node"))
            .distinct()
            .withColumn("now", F.lit(2))
        )
        marks = new_seeds.unionByName(taken).groupBy("node").agg(F.min("now").alias("now"))
        state = materialize(
            state.join(marks, "node", "left").select(
                "node", F.when(F.col("state") == 0, F.coalesce("now", F.lit(0))).otherwise(F.col("state")).alias("state")
            )
        )
        if state.filter(F.col("state") == 0).limit(1).count() == 0:
            break
    seeds = state.filter(F.col("state") == 1).select("node")
    seed_rank = nodes.join(seeds, "node", "left_semi").select(F.col("node").alias("v"), F.col("rank").alias("rv"))
    followers = (
        both.join(seed_rank, "v")
        .join(seeds.select(F.col("node").alias("u")), "u", "left_anti")
        .groupBy(F.col("u").alias("sid"))
        .agg(F.min(F.struct("rv", "v", "sim")).alias("best"))
        .select(F.col("best.v").alias("seed"), "sid", F.col("best.sim").alias("sim"))
    )
    own = seeds.select(F.col("node").alias("seed"), F.col("node").alias("sid"), F.lit(1.0).alias("sim"))
    return own.unionByName(followers)


def cluster_keywords(clusters: DataFrame, features: DataFrame, stopwords: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Top grams per cluster by members holding them, ties by gram."""
    rows = clusters.select("seed", "sid").join(
        features.select("sid", F.explode(F.array_union("title_grams", "first_grams")).alias("gram")), "sid"
    )
    rows = rows.filter(F.col("gram").rlike(r"^[\u4e00-\u9fffA-Za-z]{2,}$"))
    if stopwords:
        rows = rows.filter(~F.col("gram").isin(list(stopwords)))
    counted = rows.groupBy("seed", "gram").agg(F.count(F.lit(1)).alias("n"))
    return ST.top_per_group(counted, ["seed"], [F.desc("n"), F.col("gram")], k)


# --- template groups and cards -----------------------------------------------------------


def template_groups(stats: DataFrame, samples: DataFrame, templates: Sequence[R.Template] = R.DEFAULT_TEMPLATES) -> DataFrame:
    """(pattern, root): patterns under the merged template group they fall in; root null when none matches.

    Templates that share a pattern belong together; the root is the smallest
    template number of the joined templates.
    """
    by_sample = (
        samples.select("pattern", F.explode(R.template_hits(F.col("error"), templates)).alias("t"))
        .groupBy("pattern")
        .agg(F.collect_set("t").alias("more"))  # at most one entry per template
    )
    hits = stats.join(by_sample, "pattern", "left").select(
        "pattern",
        F.array_sort(
            F.array_union(
                R.template_hits(F.col("pattern"), templates), F.coalesce("more", F.array().cast("array<int>"))
            )
        ).alias("hits"),
    )
    hits = materialize(hits)
    links = (
        hits.filter(F.size("hits") > 0)
        .select(F.get("hits", F.lit(0)).alias("a"), F.explode("hits").alias("b"))
        .distinct()
    )
    roots = connected_components(links)
    return hits.select("pattern", F.get("hits", F.lit(0)).alias("node")).join(roots, "node", "left").select(
        "pattern", F.col("component").alias("root")
    )


def group_titles(stats: DataFrame, groups: DataFrame, samples: DataFrame, templates: Sequence[R.Template] = R.DEFAULT_TEMPLATES) -> DataFrame:
    """Per merged group: title and owner of its largest template, totals over the union once."""
    by_sample = samples.select("pattern", F.explode(R.template_hits(F.col("error"), templates)).alias("t"))
    by_pattern = stats.select("pattern", F.explode(R.template_hits(F.col("pattern"), templates)).alias("t"))
    sizes = (
        by_pattern.unionByName(by_sample)
        .distinct()
        .join(stats.select("pattern", "count"), "pattern")
        .join(groups, "pattern")
        .groupBy("root", "t")
        .agg(F.sum("count").alias("n"))
    )
    best = sizes.groupBy("root").agg(F.max(F.struct(F.col("n"), (-F.col("t")).alias("neg"))).alias("m"))
    title, owner = None, None
    for i, tpl in enumerate(templates):
        is_it = F.col("m.neg") == -i
        title = F.when(is_it, tpl.title) if title is None else title.when(is_it, tpl.title)
        owner = F.when(is_it, tpl.owner) if owner is None else owner.when(is_it, tpl.owner)
    totals = (
        stats.join(groups.filter(F.col("root").isNotNull()), "pattern")
        .groupBy("root")
        .agg(F.sum("count").alias("total"), F.sum("given_up").alias("unresolved_count"))
    )
    return totals.join(best, "root").select("root", title.alias("title"), owner.alias("owner"), "total", "unresolved_count")


def _trigger_words(cards: DataFrame) -> DataFrame:
    return (
        cards.select("id", F.explode("triggers").alias("word"))
        .select("id", text.loose_key("word").alias("word"))
        .filter(F.col("word") != "")
        .distinct()
    )


def related_triggers(cards: DataFrame) -> DataFrame:
    """(word, other): distinct trigger words that are equal or one inside the other, both directions."""
    vocabulary = _trigger_words(cards).select("word").distinct()
    texts = vocabulary.select(F.col("word").alias("long"), F.col("word").alias("long_text"))
    needles = vocabulary.select(F.col("word").alias("short"), F.col("word").alias("short_text"))
    related = contains_pairs(texts, needles, "long", "long_text", "short", "short_text")
    return (
        related.select(F.col("long").alias("word"), F.col("short").alias("other"))
        .unionByName(related.select(F.col("short").alias("word"), F.col("long").alias("other")))
        .distinct()
    )


def confusable_triggers(cards: DataFrame) -> DataFrame:
    """Related triggers with the number of cards that hold each: (trigger, other_trigger, cards, other_cards).

    One row per pair of words, whatever the number of cards; a word that several
    cards share is related to itself.  The cards follow by looking a word up.
    """
    words = _trigger_words(cards)
    holders = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        related_triggers(cards)
        .join(holders.select("word", F.col("n").alias("cards")), "word")
        .join(holders.select(F.col("word").alias("other"), F.col("n").alias("other_cards")), "other")
    )
    return rows.filter((F.col("word") != F.col("other")) | (F.col("cards") > 1)).select(
        F.col("word").alias("trigger"), F.col("other").alias("other_trigger"), "cards", "other_cards"
    )


def duplicate_cards(cards: DataFrame, errors: DataFrame) -> DataFrame:
    """Error patterns already described by cards: (key, sessions, n_cards, first_card)."""
    keys = errors.select("sid", text.loose_key("pattern").alias("key")).filter(F.col("key") != "")
    seen = keys.groupBy("key", "sid").agg(F.lit(1).alias("one")).groupBy("key").agg(F.sum("one").alias("sessions"))
    body = text.loose_key(F.concat_ws("\n", "title", "evidence", "summary"))
    texts = cards.select("id", body.alias("body"))
    needles = seen.select("key", F.col("key").alias("needle"))
    found = contains_pairs(texts, needles, "id", "body", "key", "needle")
    holding = found.groupBy("key").agg(F.count(F.lit(1)).alias("n_cards"), F.min("id").alias("first_card"))
    return holding.join(seen, "key").select("key", "sessions", "n_cards", "first_card")
