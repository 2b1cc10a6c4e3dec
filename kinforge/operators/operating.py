"""Operating points: threshold curves, precision, cost and budget rules.

The curve over all thresholds comes from one merge forest (a maximum spanning
forest taken edge by edge in descending score), not from one clustering a
threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.prefix import running_sums
from kinforge.operators.graph import connected_components


def threshold_grid(scores: list[float], grid: int = 200) -> list[float]:
    """Distinct scores, descending, thinned evenly to at most ``grid``."""
    distinct = sorted(set(scores), reverse=True)
    if len(distinct) <= grid:
        return distinct
    return [distinct[i] for i in dict.fromkeys(np.round(np.linspace(0, len(distinct) - 1, grid)).astype(int).tolist())]


def merge_steps(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Change of the metric sums at each score: (score, d_p, d_r, d_tp, d_pred).

    Computed inside each connected component, whose merges do not touch others;
    d_p and d_r change the B-cubed sums, d_tp and d_pred the pair counts.
    """
    edges = scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    parts = connected_components(edges)
    sizes = truth.groupBy("entity_id").agg(F.count("*").alias("size"))
    ids = truth.join(sizes, "entity_id").select(F.col("record_id").alias("r"), "entity_id", "size")
    keyed = edges.join(parts, edges["a"] == parts["node"]).select("component", "a", "b", "score")
    for side in "ab":
        keyed = keyed.join(ids.select(F.col("r").alias(side), F.col("entity_id").alias(f"e{side}"), F.col("size").alias(f"s{side}")), side)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home: dict = {}
        cells: dict = {}
        size: dict = {}
        for r, e, s in [*zip(pdf["a"], pdf["ea"], pdf["sa"], strict=True), *zip(pdf["b"], pdf["eb"], pdf["sb"], strict=True)]:
            home[r], cells[r], size[e] = r, {e: 1}, s

        def find(x):
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        state = {r: (1, 1) for r in home}  # a cluster's records and sum of squared cells

        out = []
        for e in pdf.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples():
            x, y = find(e.a), find(e.b)
            if x == y:
                continue
            if len(cells[x]) < len(cells[y]):
                x, y = y, x
            (nx, qx), (ny, qy) = state[x], state.pop(y)
            both, mine = 0, cells[x]
            d_r = 0.0
            for k, v in cells.pop(y).items():  # only shared entities change their cells
                had = mine.get(k, 0)
                mine[k] = had + v
                both += had * v
                d_r += 2 * had * v / size[k]
            home[y] = x
            n, q = nx + ny, qx + qy + 2 * both
            state[x] = (n, q)
            out.append((e.score, q / n - qx / nx - qy / ny, d_r, both, nx * ny))
        return pd.DataFrame(out, columns=["score", "d_p", "d_r", "d_tp", "d_pred"])

    return keyed.groupBy("component").applyInPandas(run, "score double, d_p double, d_r double, d_tp long, d_pred long")


def threshold_curve(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(threshold, precision, recall, tp, fp, fn) at every score where clusters merge."""
    steps = merge_steps(scored, truth).groupBy("score").agg(*[F.sum(c).alias(c) for c in ("d_p", "d_r", "d_tp", "d_pred")])
    base = truth.groupBy("entity_id").count().agg(
        F.sum("count").alias("n"), F.count("*").cast("double").alias("r0"), F.sum(F.expr("count * (count - 1) div 2")).alias("true_pairs")
    )
    run = running_sums(steps, "score", ["d_p", "d_r", "d_tp", "d_pred"])
    run = run.select("score", *[F.col(f"run_{c}").alias(c) for c in ("d_p", "d_r", "d_tp", "d_pred")]).crossJoin(F.broadcast(base))  # one-row side
    n = F.col("n")
    return run.select(
        F.col("score").alias("threshold"),
        ((n + F.col("d_p")) / n).alias("precision"),
        ((F.col("r0") + F.col("d_r")) / n).alias("recall"),
        F.col("d_tp").alias("tp"),
        (F.col("d_pred") - F.col("d_tp")).alias("fp"),
        (F.col("true_pairs") - F.col("d_tp")).alias("fn"),
    )


def precision_point(curve: DataFrame, target: float) -> DataFrame:
    """Highest recall at the target precision; if none, the highest precision. ``met`` says which."""
    ok = F.col("precision") >= target
    key = F.struct(ok.cast("int"), F.when(ok, F.col("recall")).otherwise(F.col("precision")), F.when(ok, F.col("precision")).otherwise(F.col("recall")), "threshold")
    best = curve.agg(F.max_by(F.struct("threshold", "precision", "recall", ok.alias("met")), key).alias("x"))
    return best.select("x.*")


def cost_point(curve: DataFrame, fp_cost: float, fn_cost: float) -> DataFrame:
    """Least cost; of equal ones the higher threshold."""
    cost = F.col("fp") * fp_cost + F.col("fn") * fn_cost
    return curve.agg(F.min_by(F.struct("threshold", cost.cast("double").alias("cost")), F.struct(cost, -F.col("threshold"))).alias("x")).select("x.*")


def _times(scored: DataFrame) -> Column:
    """Pairs that a row stands for: its ``n`` if it has one."""
    return F.col("n") if "n" in scored.columns else F.lit(1).cast("long")


def fp_budget_threshold(scores: DataFrame, budget_per_record: float, n_records: int) -> float:
    """Lowest threshold that lets at most floor(budget x n) of ``score`` through.

    A group of ties that would overrun is left out whole.
    """
    allowed = math.floor(budget_per_record * n_records)
    counts = scores.groupBy("score").agg(F.sum(_times(scores)).alias("count"))
    inside = running_sums(counts, "score", ["count"]).where(F.col("run_count") <= allowed).agg(F.min("score")).first()[0]
    if inside is not None:
        return float(inside)
    top = counts.agg(F.max("score")).first()[0]
    return math.inf if top is None else float(np.nextafter(top, math.inf))


def pairwise_precision_threshold(scored: DataFrame, target: float) -> DataFrame:
    """Loosest score at which pairs with score >= it keep the target precision (ties together)."""
    cells = scored.groupBy("score").agg(F.sum(F.col("label").cast("long") * _times(scored)).alias("pos"), F.sum(_times(scored)).alias("n"))
    run = running_sums(cells, "score", ["pos", "n"]).select("score", F.col("run_pos").alias("tp"), F.col("run_n").alias("passed"))
    return run.where(F.col("tp") >= target * F.col("passed")).agg(F.min("score").alias("threshold"), F.max("tp").alias("tp"), F.max("passed").alias("passed"))


def best_f1_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, f1) of the best cut over tie groups; the higher one on equal F1."""
    cells = scored.groupBy("score").agg(F.sum(F.col("label").cast("long") * _times(scored)).alias("pos"), F.sum(_times(scored)).alias("n"))
    all_pos = cells.agg(F.sum("pos").alias("all_pos"))
    run = running_sums(cells, "score", ["pos", "n"]).select("score", F.col("run_pos").alias("tp"), F.col("run_n").alias("passed")).crossJoin(F.broadcast(all_pos))  # one-row side
    f1 = 2.0 * F.col("tp") / (F.col("passed") + F.col("all_pos"))
    return run.agg(F.max_by(F.struct(F.col("score").alias("threshold"), f1.alias("f1")), F.struct(f1, "score")).alias("x")).select("x.*")


def auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area with average ranks for ties; null without both labels."""
    by = by or []
    cells = scored.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long") * _times(scored)).alias("pos"), F.sum(_times(scored)).alias("n"))
    ranked = running_sums(cells, "score", ["n"], descending=False, by=tuple(by)).withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    area = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q")))
    return sums.select(*by, area.alias("auc"), F.col("p").alias("n_pos"), F.col("q").alias("n_neg"))


def sweep(values: Iterable[float], measure) -> list[tuple[float, object]]:
    """Apply ``measure`` at each threshold of a short list."""
    return [(t, measure(t)) for t in values]
