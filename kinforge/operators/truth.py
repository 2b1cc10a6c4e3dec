"""Imperfect truth: corrected precision and recall, disagreement samples, kappa."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.draws import order_key


def _clip(x: float) -> float:
    return min(1.0, max(0.0, x))


def corrected_precision_recall(
    obs_precision: float, obs_recall: float, dup_rate: float, overlay_rate: float, dup_ci: tuple[float, float] | None = None, overlay_ci: tuple[float, float] | None = None
) -> dict[str, float]:
    """True pairwise precision and recall behind those observed against an erroneous truth.

    A share d = ``dup_rate`` of the real pairs is keyed apart and a share
    o = ``overlay_rate`` of the pairs in play that are none is keyed together, so
    observed precision is P (1 - d) + (1 - P) o. Observed recall runs over keyed
    pairs, of which a share o is spurious; the point takes none of those as
    linked and unseen pairs as recalled like the others, the band lets both be
    anything. Bands span the corners of the rates' intervals. A NaN observation
    gives NaN for its metric.
    """
    for name, rate in (("dup_rate", dup_rate), ("overlay_rate", overlay_rate)):
        if not 0 <= rate < 1:
            raise ValueError(f"{name} must be in [0, 1)")
    for name, obs in (("precision", obs_precision), ("recall", obs_recall)):
        if not (math.isnan(obs) or 0 <= obs <= 1):
            raise ValueError(f"{name} must be in [0, 1]")
    for ci, point in ((dup_ci, dup_rate), (overlay_ci, overlay_rate)):
        if ci and not (0 <= ci[0] <= point <= ci[1] < 1):
            raise ValueError("an interval must lie in [0, 1) and hold its rate")
    corners = list(itertools.product(dup_ci or (dup_rate,), overlay_ci or (overlay_rate,)))
    if max([dup_rate + overlay_rate, *(d + o for d, o in corners)]) >= 1:
        raise ValueError("the rates, and the ends of their intervals, must sum to less than 1")

    def precision(d: float, o: float) -> float:
        return _clip((obs_precision - o) / (1 - d - o))

    def recall_band(d: float, o: float) -> tuple[float, float]:
        return (1 - d) * _clip((obs_recall - o) / (1 - o)), (1 - d) * _clip(obs_recall / (1 - o)) + d

    nan = float("nan")
    p = [nan] * 3 if math.isnan(obs_precision) else [precision(dup_rate, overlay_rate), min(precision(*c) for c in corners), max(precision(*c) for c in corners)]
    r = [nan] * 3
    if not math.isnan(obs_recall):
        r = [_clip(obs_recall / (1 - overlay_rate)), min(recall_band(*c)[0] for c in corners), min(1.0, max(recall_band(*c)[1] for c in corners))]
    return {"precision": p[0], "recall": r[0], "precision_lo": p[1], "precision_hi": p[2], "recall_lo": r[1], "recall_hi": r[2]}


def allocate(counts: dict[str | None, int], n: int) -> dict[str | None, int]:
    """At least one for each stratum, the rest by largest remainder, none above its size."""
    order = sorted(counts, key=lambda k: (k is None, k or ""))
    n = min(n, sum(counts.values()))
    out = {k: 1 if counts[k] else 0 for k in order}
    if sum(out.values()) > n:
        raise ValueError("fewer draws than strata")
    while (spare := n - sum(out.values())) > 0:
        room = {k: counts[k] - out[k] for k in order if counts[k] > out[k]}
        total = sum(counts[k] for k in room)
        quota = {k: spare * counts[k] / total for k in room}
        step = {k: min(room[k], int(quota[k])) for k in room}
        if not any(step.values()):
            for k in sorted(room, key=lambda k: -(quota[k] - int(quota[k])))[:spare]:
                step[k] = 1
        for k, v in step.items():
            out[k] += v
    return out


def disagreements(a: DataFrame, b: DataFrame, strata: list[str] | None = None) -> DataFrame:
    """Pairs that two labelings (a, b, label[, strata]) treat differently; absent differs from any label."""
    strata = strata or []

    def side(df: DataFrame, name: str) -> DataFrame:
        out = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("label").alias(name), *[F.col(s).alias(f"{s}_{name}") for s in strata])
        if out.groupBy("a", "b").count().where("count > 1").limit(1).count():
            raise ValueError("a pair is labelled twice")
        return out

    both = side(a, "la").join(side(b, "lb"), ["a", "b"], "full").where(~F.col("la").eqNullSafe(F.col("lb")))
    return both.select("a", "b", "la", "lb", *[F.coalesce(f"{s}_la", f"{s}_lb").alias(s) for s in strata])


def disagreement_sample(a: DataFrame, b: DataFrame, n: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """Stratified sample of the disagreements without replacement, with weight N_h / n_h.

    The order inside a stratum is a hash of the pair; a null stratum is its own.
    """
    return sample_of(disagreements(a, b, strata), n, seed, strata)


def sample_of(diff: DataFrame, n: int, seed: int, strata: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The stratified sample of listed disagreements (a, b, la, lb[, strata]).

    Where ``sizes`` (strata, n) gives the strata's sizes, ``diff`` needs only hold
    the ``n`` first of each in hashed order.
    """
    name = F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("<null>")) for s in strata]) if strata else F.lit("all")
    diff = diff.withColumn("stratum", name)
    sized = diff.groupBy("stratum").agg(F.count("*").alias("n")) if sizes is None else sizes.groupBy(name.alias("stratum")).agg(F.sum("n").alias("n"))
    counts = {r["stratum"]: r["n"] for r in sized.collect()}
    take = allocate(counts, n) if counts else {}
    quota = F.lit(0)
    weight = F.lit(None).cast("double")
    for s, k in take.items():
        quota = F.when(F.col("stratum") == s, k).otherwise(quota)
        weight = F.when(F.col("stratum") == s, F.lit(counts[s] / k)).otherwise(weight)
    rn = F.row_number().over(Window.partitionBy("stratum").orderBy(order_key("a", "b", salt=str(seed)), "a", "b"))
    most = max(take.values(), default=0)  # a fixed bound lets each task drop the rest before the shuffle
    return diff.withColumn("rn", rn).where(F.col("rn") <= most).where(F.col("rn") <= quota).select("a", "b", "la", "lb", "stratum", weight.alias("weight"))
