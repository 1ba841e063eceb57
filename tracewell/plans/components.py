"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node id.

    Each round takes the smallest label among neighbours (pre-aggregated, so a
    hub is no bottleneck) and then follows labels one hop, which makes the
    number of rounds logarithmic on long chains.  Labels are written to the
    checkpoint folder each round; the driver sees only the change count.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        offered = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        lowered = labels.join(offered, "node", "left").select(
            "node", F.least("label", "offer").alias("mid"), F.col("label").alias("old")
        )
        hop = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        jumped = lowered.join(hop, "mid", "left").select(
            "node", F.least("mid", "far").alias("label"), "old"
        )
        stepped = materialize(jumped)
        moved = stepped.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = stepped.select("node", "label")
        if moved == 0:
            return labels.withColumnRenamed("label", "component")


def contracted_components(edges: DataFrame) -> DataFrame:
    """Same as ``connected_components`` of (a, b), for edge lists with many more edges than nodes; reads ``edges`` twice.

    First only each node's edge to its smallest neighbour counts, so there are no more edges than nodes.  That leaves
    half as many components at most (without edges from a node to itself); the other edges then count once for each
    two of them that they connect.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = connected_components(both.groupBy("a").agg(F.min("b").alias("b")))
    for end in ("a", "b"):
        edges = edges.join(first.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end)
    rest = materialize(
        edges.filter("a_part != b_part")
        .select(F.least("a_part", "b_part").alias("a"), F.greatest("a_part", "b_part").alias("b"))
        .distinct()
    )
    if rest.isEmpty():
        return first
    second = connected_components(rest).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return first.join(second, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
