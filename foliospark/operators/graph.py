"""Graphs as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Components of an undirected graph of bigint pairs: (node, label), label = smallest node reached.

    Every round each node hooks to its least neighbour and paths of hooks are halved until all end at a root; then
    the edges are relabelled, those inside one label and repeated ones go, and the next round sees the rest only. A
    group around a hub is gone after a round or two, a path in order after one. Edges are folded before they are
    shuffled; a node with very many edges is a skewed join key that adaptive execution splits. Nothing is collected
    but whether something is left. Raises when ``rounds`` were not enough, and never returns half-merged labels.
    """
    left = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a != b").distinct(), False)
    merged: DataFrame | None = None
    for _ in range(rounds):
        ends = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        for _ in range(rounds):
            # two halvings a pass: hooks around a hub need none, those of a group of near copies one or two
            for _ in range(2):
                over = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
                step = step.select("node", "label").join(over, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("moved"))
            step = cut(step, False)
            if not step.filter("moved").limit(1).count():
                break
        step = step.select("node", "label")
        if merged is None:
            merged = step
        else:
            onward = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            merged = cut(merged.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label")), False)
        for end in ("a", "b"):
            left = left.join(step.select(F.col("node").alias(end), F.col("label").alias(f"{end}2")), end)
        left = cut(left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a != b").distinct(), False)
        if not left.limit(1).count():
            return merged
    raise RuntimeError(f"components did not settle in {rounds} rounds")
