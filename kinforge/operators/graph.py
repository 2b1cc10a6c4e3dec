"""Distributed connected components by min-neighbour contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.session import discard, materialize

MAX_ROUNDS = 100


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component = least node reachable.

    Each round points a node at its least neighbour, follows the pointers once,
    merges the pointed groups and keeps the edges between different groups; the
    edge set shrinks at least geometrically and hubs are reduced map-side. A
    round writes its pointers and the edges left to the shared folder, and the
    rounds' pointers are followed at the end. Direction, repeats, loops and null
    ends of edges do not matter (an edge with a null end is no edge).
    """
    rest = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    rest = materialize(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not steps or not rest.isEmpty():
        if len(steps) == MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        both = rest.union(rest.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        jump = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = materialize(least.join(jump, "up").select("node", "top"), "pointers")
        left = rest.join(step.select(F.col("node").alias("a"), F.col("top").alias("ta")), "a")
        pairs = left.join(step.select(F.col("node").alias("b"), F.col("top").alias("tb")), "b").where("ta <> tb")
        fewer = materialize(pairs.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(rest)
        rest = fewer
        steps.append(step)
    labels = steps[0].select("node", F.col("top").alias("component"))
    for step in steps[1:]:
        moved = step.select(F.col("node").alias("component"), F.col("top"))
        labels = labels.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    if steps[1:]:
        labels = materialize(labels, "labels")
        discard(*steps)
    discard(rest)
    return labels
