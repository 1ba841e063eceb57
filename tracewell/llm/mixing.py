"""Mixing sources to target weights over a domain-language-source tree.

Budgets go down the tree: a node's budget is split over its children by
weight, but no child gets more than it holds over ``max_epochs`` passes.  What a
full child leaves goes to its siblings (water filling); only when all of them
are full is the node itself full, and the rest goes to the node's siblings.
Capacities are summed bottom-up first, so one pass per level suffices.

Leaf statistics are aggregated before anything meets in one task.  A leaf's
last, partial epoch takes a prefix of its documents in seeded order: hash-order
buckets are summed, whole buckets below the cut are taken in place, and only
the one bucket that holds the cut is put in order row by row.  So a leaf with a
third of all rows is never in one task, and texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import plain_text, stored

LEVELS = ("domain", "lang", "source")
BUDGET_SHARE = 0.75
MAX_EPOCHS = 2
SEED = 17
BUCKET_ROWS = 1024
#: Weights of nodes, by path; nodes not listed have weight 1.
WEIGHTS = {
    "web": 45, "code": 25, "books": 20, "forum": 10,
    **{f"{domain}/{lang}": weight for domain in ("web", "code", "books", "forum")
       for lang, weight in (("en", 50), ("de", 20), ("fr", 20), ("es", 10))},
    "web/en/src0": 3, "web/de/src0": 3, "web/fr/src0": 3, "web/es/src0": 3,
}
#: Fixed value: what a token is.
TOKEN = r"[^\x20\x09-\x0D]+"


def source_domain(source: str = "source") -> Column:
    """Domain by the number a source's name ends with; sources without number are 'other'."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]{1,9})$", 1)
    kind = F.when(number != "", number.try_cast("int") % 4)
    return F.when(kind == 0, "web").when(kind == 1, "code").when(kind == 2, "books").when(kind == 3, "forum").otherwise("other")


def token_count(text: str = "text") -> Column:
    return F.regexp_count(plain_text(text), F.lit(TOKEN)).cast("long")


def _split(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Budget of every child from (parents, name, weight, capacity, parent_budget), by closed-form water filling."""
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = children.withColumn("left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn(
        "share", F.sum("weight").over(after)
    )
    full = F.col("capacity").cast("double") * F.col("share") <= F.col("left").cast("double") * F.col("weight")
    marked = stepped.withColumn("full", full)
    level = marked.withColumn("level_left", F.first(F.when(~F.col("full"), F.col("left")), True).over(whole)).withColumn(
        "level_share", F.first(F.when(~F.col("full"), F.col("share")), True).over(whole)
    )
    part = F.floor(F.col("level_left").cast("double") * F.col("weight") / F.col("level_share")).cast("long")
    return level.select(*parents, name, F.when(F.col("full"), F.col("capacity")).otherwise(part).alias("budget"))


def leaf_budgets(
    leaves: DataFrame, weights: dict[str, int], total_budget: Column, levels: tuple[str, ...] = LEVELS
) -> DataFrame:
    """(levels, budget) from leaves (levels, capacity).  A weight of 0 excludes a node.

    ``total_budget`` is an expression over the sum of all capacities, ``capacity``.
    """
    spark = leaves.sparkSession
    given = spark.createDataFrame(list(weights.items()) or [("", 1)], "node string, weight long")
    above = leaves.agg(F.sum("capacity").alias("capacity")).select(
        F.least("capacity", total_budget.cast("long")).alias("parent_budget")
    )
    for depth, name in enumerate(levels):
        parents = list(levels[:depth])
        nodes = leaves.groupBy(*parents, name).agg(F.sum("capacity").alias("capacity"))
        nodes = (
            nodes.withColumn("node", F.concat_ws("/", *parents, name))
            .join(F.broadcast(given), "node", "left")  # as many rows as the caller lists weights
            .withColumn("weight", F.coalesce("weight", F.lit(1))).filter("weight > 0").drop("node")
        )
        children = nodes.join(above, parents) if parents else nodes.crossJoin(above)  # one row above the first level
        above = _split(children, parents, name).withColumnRenamed("budget", "parent_budget")
    return above.withColumnRenamed("parent_budget", "budget")


def _order_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def _bucket() -> Column:
    slot = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
    return F.floor(slot * F.col("buckets") / F.lit(2**32)).cast("long")


def mix(
    docs: DataFrame,
    weights: dict[str, int] = WEIGHTS,
    domain: Column | None = None,
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The mixture: one row (document, domain, n_tokens, epoch) per document and epoch it is used in.

    ``document`` is a struct of all columns of ``docs``, so no name can clash;
    ``doc_id``, ``text``, ``lang`` and ``source`` are needed.  The budget is
    ``budget_share`` of all tokens.  Null lang or source is the empty name, a
    null text has no tokens.  Leaves that get nothing and leaves without tokens
    give no rows; documents without tokens are used in whole epochs, and in the
    partial one where they precede the cut.  Rows that repeat an id are ordered
    by their token count.  No row in, no row out.
    """
    tree = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "doc_id", "text",
        F.coalesce(domain if domain is not None else source_domain(), F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )
    leaves = stored(
        tree.groupBy(*LEVELS).agg(F.count("*").alias("n"), F.sum(token_count()).alias("tokens")), "mix-leaves"
    )
    held = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    wanted = F.floor(F.col("capacity") / max_epochs * budget_share)
    budgets = leaf_budgets(held, weights, wanted)
    plan = (
        leaves.join(budgets, list(LEVELS)).filter("tokens > 0 AND budget > 0")
        .withColumn("whole", F.floor(F.col("budget") / F.col("tokens")))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
        .withColumn("buckets", F.ceil(F.col("n") / bucket_rows))
        .select(*LEVELS, "whole", "rest", "buckets")
    )
    plan = stored(plan, "mix-plan")  # one row for each leaf; read back, so that its size decides how it is joined

    partial = tree.join(plan.filter("rest > 0").withColumn("epoch", F.col("whole")), list(LEVELS)).withColumn("order_key", _order_key(seed))
    sums = partial.groupBy(*LEVELS, _bucket().alias("bucket"), "rest").agg(F.sum(token_count()).alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    cuts = (
        sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy(*LEVELS)
        .agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("cut"))
    )
    plan = stored(
        plan.join(cuts, list(LEVELS), "left").select(*LEVELS, "whole", "rest", "buckets", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.room").alias("room")),
        "mix-cuts",
    )

    used = (
        tree.join(plan, list(LEVELS))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
        .withColumn("order_key", _order_key(seed))
        .withColumn("bucket", F.when(F.col("epoch") == F.col("whole"), _bucket()))
    )
    taken = used.filter((F.col("epoch") < F.col("whole")) | (F.col("bucket") < F.col("cut_bucket")))
    edge = used.filter((F.col("epoch") == F.col("whole")) & (F.col("bucket") == F.col("cut_bucket")))
    row = ["document", "domain", token_count().alias("n_tokens"), "epoch"]
    ordered = edge.select(*row, *LEVELS[1:], "doc_id", "order_key", "room").withColumn(
        "upto", F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("order_key", "n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    )
    return taken.select(*row).unionByName(ordered.filter("upto <= room").select("document", "domain", "n_tokens", "epoch"))


def oracle(weights: dict[str, int] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """SQL for the rows (doc_id, domain, lang, source, n_tokens, epoch) of ``mix`` over ``documents``."""
    listed = ", ".join(f"('{node}', {weight})" for node, weight in weights.items())
    parts = [
        r"""d AS (SELECT doc_id, CASE CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN -1
      ELSE CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER) % 4 END WHEN 0 THEN 'web' WHEN 1 THEN 'code' WHEN 2 THEN 'books'
      WHEN 3 THEN 'forum' ELSE 'other' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        f"given(node, weight) AS (VALUES {listed})",
        f"leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS capacity FROM d GROUP BY ALL)",
        f"b0 AS (SELECT least(sum(capacity), CAST(floor(CAST(sum(capacity) AS DOUBLE) / {max_epochs} * {budget_share}) AS BIGINT)) AS budget FROM leaf)",
    ]
    for k, name in enumerate(LEVELS, 1):
        above, own = ", ".join(LEVELS[: k - 1]), ", ".join(LEVELS[:k])
        by = f"PARTITION BY {above} " if above else ""
        order = f"{by}ORDER BY capacity / weight, {name}"
        path = " || '/' || ".join(LEVELS[:k])
        parts.append(f"""n{k} AS (SELECT {own}, coalesce(any_value(weight), 1) AS weight, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaf
    LEFT JOIN given ON node = {path} GROUP BY {own}),
  s{k} AS (SELECT {own}, weight, capacity, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share, row_number() OVER ({order}) AS place
    FROM n{k} {f"JOIN b{k - 1} USING ({above})" if above else "CROSS JOIN b0"}),
  f{k} AS (SELECT *, CAST(capacity AS DOUBLE) * share <= CAST(remain AS DOUBLE) * weight AS filled FROM s{k}),
  b{k} AS (SELECT {own}, CASE WHEN filled THEN capacity ELSE CAST(floor(CAST(min_by(remain, place) FILTER (WHERE NOT filled) OVER ({by}) AS DOUBLE) * weight
    / min_by(share, place) FILTER (WHERE NOT filled) OVER ({by})) AS BIGINT) END AS budget FROM f{k})""")
    parts.append("""p AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM leaf JOIN b3 USING (domain, lang, source)
    WHERE tokens > 0 AND budget > 0)""")
    parts.append(f"""r AS (SELECT d.*, whole AS epoch, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM d JOIN p USING (domain, lang, source) WHERE rest > 0)""")
    return "WITH " + ",\n  ".join(parts) + """
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(whole)) AS BIGINT) AS epoch FROM d JOIN p USING (domain, lang, source)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS BIGINT) FROM r WHERE upto <= rest"""
