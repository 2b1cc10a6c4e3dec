"""Linkage between sources, incremental attachment and cluster churn."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators.graph import connected_components
from kinforge.session import materialize


def cross_source(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs whose records come from different sources: deduplication turned linkage."""
    a = records.select(F.col("record_id").alias("a"), F.col("source").alias("sa"))
    b = records.select(F.col("record_id").alias("b"), F.col("source").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where("sa <> sb").select(*pairs.columns)


def placements(clusters: DataFrame, arrivals: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """(record_id, cluster) of new records: each joins the cluster of its best pair.

    ``scored`` are pairs between an arrival ``a`` and any record ``b``; an arrival
    without a pair at the threshold founds a cluster of its own, arrivals linked
    only to arrivals are clustered together.
    """
    links = scored.where(F.col("prob") >= threshold)
    known = links.join(clusters.select(F.col("record_id").alias("b"), "cluster"), "b")
    best = known.groupBy("a").agg(F.max_by("cluster", F.struct("prob", F.col("cluster"))).alias("cluster"))
    best = materialize(best.select(F.col("a").alias("record_id"), "cluster"), "attached")
    left = arrivals.join(best, "record_id", "left_anti").select("record_id")
    inner = links.join(left.select(F.col("record_id").alias("a")), "a", "left_semi").join(left.select(F.col("record_id").alias("b")), "b", "left_semi")
    parts = connected_components(inner).select(F.col("node").alias("record_id"), F.col("component").alias("cluster"))
    fresh = left.join(parts, "record_id", "left").select("record_id", F.coalesce("cluster", "record_id").alias("cluster"))
    return best.unionByName(fresh)


def attach(clusters: DataFrame, arrivals: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Clusters after new records arrive; old records never move."""
    return clusters.select("record_id", "cluster").unionByName(placements(clusters, arrivals, scored, threshold))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_clusters_before, n_intact, n_split, n_merged) over records on both sides."""
    both = before.select("record_id", F.col("cluster").alias("c0")).join(after.select("record_id", F.col("cluster").alias("c1")), "record_id")
    cells = both.groupBy("c0", "c1").agg(F.count("*").alias("n"))
    splits = cells.groupBy("c0").agg(F.count("*").alias("parts"), F.min("c1").alias("c1"))
    merges = cells.groupBy("c1").agg(F.count("*").alias("sources"))
    state = splits.join(merges, "c1")
    return state.agg(
        F.count("*").alias("n_clusters_before"),
        F.count_if((F.col("parts") == 1) & (F.col("sources") == 1)).alias("n_intact"),
        F.count_if(F.col("parts") > 1).alias("n_split"),
        F.count_if((F.col("parts") == 1) & (F.col("sources") > 1)).alias("n_merged"),
    )


def carry_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """(c1, c0): new clusters keep an old id by greedy largest overlap, one to one.

    A new cluster whose old ones went nowhere else is decided by one aggregate; other
    decisions stay inside one component of the overlap graph, which is one group.
    """
    both = before.select("record_id", F.col("cluster").alias("c0")).join(after.select("record_id", F.col("cluster").alias("c1")), "record_id")
    cells = materialize(both.groupBy("c0", "c1").agg(F.count("*").alias("n")), "cells")
    split = cells.groupBy("c0").agg(F.count("*").alias("parts")).where("parts > 1").select("c0")
    shared = materialize(cells.join(split, "c0", "left_semi").select("c1").distinct(), "shared")
    alone = cells.join(shared, "c1", "left_anti").groupBy("c1").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("c0"))).alias("x")).select("c1", F.col("x.c0").alias("c0"))
    # a cluster that shares an old one, and all clusters it is connected with through old ones
    edges = cells.join(shared, "c1", "left_semi").select(F.concat(F.lit("0|"), "c0").alias("a"), F.concat(F.lit("1|"), "c1").alias("b"))
    parts = connected_components(edges)
    keyed = cells.join(parts, F.concat(F.lit("0|"), F.col("c0")) == F.col("node")).select("component", "c0", "c1", "n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used0, out = set(), {}
        for r in pdf.sort_values(["n", "c0", "c1"], ascending=[False, True, True]).itertuples():
            if r.c0 not in used0 and r.c1 not in out:
                used0.add(r.c0)
                out[r.c1] = r.c0
        return pd.DataFrame({"c1": list(out), "c0": list(out.values())}, dtype=object)

    return alone.unionByName(keyed.groupBy("component").applyInPandas(run, "c1 string, c0 string"))
