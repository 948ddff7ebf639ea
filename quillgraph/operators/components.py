"""Connected components by hooking and contraction over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.staging import discard, stage


def _rooted(up: DataFrame, name: str) -> DataFrame:
    """``up`` (node, component) with every pointer followed to its end, by jumps that double what is followed."""
    while True:
        top = up.select(F.col("node").alias("at"), F.col("component").alias("top"))
        new = stage(up.join(top, up.component == top["at"]).select("node", F.col("component").alias("was"), F.col("top").alias("component")), name)
        discard(up)
        up = new.select("node", "component")
        up._stage_path = new._stage_path
        if new.where("component <> was").isEmpty():
            return up


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``links`` (a, b).

    Every node points to the smallest of itself and its neighbours; pointers are followed to their ends, ends become the
    nodes of the next round, and links inside one of them go. So only the first round reads all links. A node that is
    left over draws others in or is drawn in by the next round, so two rounds halve the nodes at least.
    Minimums are combined before they are dealt; a hub costs one row per task. Nodes without a link do not appear.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), name + "_edges")
    rounds = []
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = _rooted(stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), name), name)
        rounds.append(up)
        end = lambda e: up.select(F.col("node").alias(e), F.col("component").alias("c" + e))  # noqa: E731, B023
        far = edges.join(end("a"), "a").join(end("b"), "b").where("ca <> cb")
        left = stage(far.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), name + "_edges")
        discard(edges)
        edges = left
        if edges.isEmpty():
            break
    discard(edges)
    labels = rounds.pop()
    while rounds:
        lower, upper = rounds.pop(), labels
        later = upper.select(F.col("node").alias("at"), F.col("component").alias("last"))
        labels = stage(lower.join(later, lower.component == later["at"], "left").select("node", F.coalesce("last", "component").alias("component")), name)
        discard(lower, upper)
    return labels
