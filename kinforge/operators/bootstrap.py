"""Resampled intervals over units, from sufficient statistics.

A statistic is a function of sums over units (entities, blocks, records or
pairs), so the data is reduced to one row of sums a unit; every replicate only
reweights those rows. Weights are Poisson(1) counts drawn by hash: units need
not be on one machine, and reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.draws import SPAN, draw
from kinforge.operators.metrics import aligned

NAN_SHARE = 0.2
#: Cumulative Poisson(1) probabilities, as parts of the draws' span; from the last one on the count is 7.
CUTS = tuple(math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * SPAN) for k in range(7))
#: Odd multipliers of the draws' mixing.
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
REPS_AT_ONCE = 64


def poisson_weights(base: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """(units, replicates) counts, from a 32-bit draw of each unit and the replicate's number.

    The two are mixed by a 32-bit finaliser (xor-shift and multiply), so a unit's
    count in a replicate is the same wherever it is computed. Replicate 0 is the
    data itself.
    """
    h = base.astype(np.uint32)[:, None] ^ (reps.astype(np.uint32) * np.uint32(MIX[0]))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX[1])
    h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX[2])
    h ^= h >> np.uint32(16)
    out = np.searchsorted(np.array(CUTS, np.uint32), h.reshape(-1), "right").reshape(h.shape).astype(float)
    out[:, reps == 0] = 1.0
    return out


def bcubed_units(pred: DataFrame, truth: DataFrame, unit: str = "t") -> DataFrame:
    """(unit, n, p, r): sums of the frozen per-record B-cubed terms of each unit."""
    rows = aligned(pred, truth)
    cells = rows.groupBy("p", "t").agg(F.sum("w").alias("n"))
    np_, nt = cells.groupBy("p").agg(F.sum("n").alias("np")), cells.groupBy("t").agg(F.sum("n").alias("nt"))
    full = cells.join(np_, "p").join(nt, "t")
    n = F.col("n").cast("double")
    return full.groupBy(F.col(unit).alias("unit")).agg(F.sum("n").alias("n"), F.sum(n * n / F.col("np")).alias("p"), F.sum(n * n / F.col("nt")).alias("r"))


def pair_units(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(unit, n_true, n_found): true pairs of each entity, and those among ``pairs``."""
    from kinforge.operators.metrics import canonical_pairs, true_pairs

    found = canonical_pairs(pairs).withColumn("hit", F.lit(1))
    return true_pairs(truth).join(found, ["a", "b"], "left").groupBy(F.col("entity_id").alias("unit")).agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))


def replicate_sums(units: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(rep, sums...): replicate 0 is the data itself.

    Every task keeps one vector of sums a replicate and hands on that only, so
    what is shuffled follows the tasks and replicates, not the units.
    """
    sums = [c for c in units.columns if c != "unit"]
    base = draw(F.col("unit").cast("string"), f"boot{seed}").alias("__base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_boot + 1, len(sums)))
        for batch in batches:
            u = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([np.nan_to_num(batch.column(k + 1).to_numpy(zero_copy_only=False)) for k in range(len(sums))], axis=1)
            for lo in range(0, n_boot + 1, REPS_AT_ONCE):
                reps = np.arange(lo, min(n_boot + 1, lo + REPS_AT_ONCE))
                total[reps] += poisson_weights(u, reps).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot + 1), pa.int32()), *(pa.array(total[:, k]) for k in range(len(sums)))], names=["rep", *sums])

    ddl = "rep int, " + ", ".join(f"`{c}` double" for c in sums)
    parts = units.select(base, *[F.col(c).cast("double").alias(c) for c in sums]).mapInArrow(run, ddl)
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in sums])


#: Statistic of each metric from its sums.
STATISTICS: dict[str, Callable[[], Column]] = {
    "bcubed_precision": lambda: F.col("p") / F.col("n"),
    "bcubed_recall": lambda: F.col("r") / F.col("n"),
    "bcubed_f1": lambda: 2 * F.col("p") * F.col("r") / (F.col("n") * (F.col("p") + F.col("r"))),
    "pair_completeness": lambda: F.when(F.col("n_true") > 0, F.col("n_found") / F.col("n_true")),
}


def statistic(metric: str | Column) -> Column:
    """A named metric's, or any expression over the units' sums."""
    return STATISTICS[metric]() if isinstance(metric, str) else metric


def replicates(units: DataFrame, metric: str | Column, n_boot: int = 500, seed: int = 0) -> DataFrame:
    """(rep, value)."""
    return replicate_sums(units, n_boot, seed).select("rep", statistic(metric).alias("value"))


def intervals(units: DataFrame, metrics: dict[str, str | Column], n_boot: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(metric, point, lo, hi) of several metrics on shared draws, from one pass over the units."""
    sums = replicate_sums(units, n_boot, seed)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), statistic(m).cast("double").alias("value")) for n, m in metrics.items()]))
    values = sums.select("rep", pairs.alias("x")).select("rep", "x.*")
    some = F.when(F.col("rep") > 0, F.col("value"))
    return values.groupBy("metric").agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("point"), F.percentile(some, F.lit(alpha / 2)).alias("lo"), F.percentile(some, F.lit(1 - alpha / 2)).alias("hi")
    )


def percentile_ci(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(point, lo, hi) by linear quantiles of the replicates."""
    some = F.when(F.col("rep") > 0, F.col("value"))
    return values.agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("point"),
        F.percentile(some, F.lit(alpha / 2)).alias("lo"),
        F.percentile(some, F.lit(1 - alpha / 2)).alias("hi"),
    )


def bca(boots: np.ndarray, point: float, jack: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """Bias-corrected accelerated interval; ties with the point count half."""
    boots = boots[~np.isnan(boots)]
    normal = NormalDist()
    below = ((boots < point).sum() + 0.5 * (boots == point).sum()) / len(boots)
    z0 = normal.inv_cdf(min(1 - 0.5 / len(boots), max(0.5 / len(boots), below)))
    d = jack.mean() - jack
    scale = (d**2).sum() ** 1.5
    a = (d**3).sum() / (6 * scale) if scale > 0 else 0.0
    out = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal.inv_cdf(q)
        out.append(float(np.quantile(boots, normal.cdf(z0 + z / (1 - a * z)))))
    return out[0], out[1]


def bootstrap_ci(units: DataFrame, metric: str | Column, n_boot: int = 500, seed: int = 0, method: str = "percentile", alpha: float = 0.05) -> dict[str, float]:
    """Point and interval of a named metric; raises when over a fifth of replicates is undefined.

    The acceleration of ``bca`` needs the leave-one-unit-out values: their power
    sums are taken in Spark, and only the replicates reach the driver.
    """
    got = replicates(units, metric, n_boot, seed).orderBy("rep").collect()
    point = got[0]["value"]
    boots = np.array([np.nan if r["value"] is None else r["value"] for r in got[1:]], float)
    if np.isnan(boots).mean() > NAN_SHARE:
        raise ValueError("too many undefined replicates")
    good = boots[~np.isnan(boots)]
    if good.std() == 0:
        return {"point": point, "lo": point, "hi": point}
    if method == "percentile":
        lo, hi = np.quantile(good, [alpha / 2, 1 - alpha / 2])
        return {"point": point, "lo": float(lo), "hi": float(hi)}
    sums = [c for c in units.columns if c != "unit"]
    total = units.agg(*[F.sum(c).alias(c) for c in sums])
    left = units.crossJoin(F.broadcast(total.select(*[F.col(c).alias(f"all_{c}") for c in sums])))  # one-row side
    left = left.select(*[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in sums]).select(statistic(metric).alias("j")).where("j IS NOT NULL")
    mean = left.agg(F.avg("j")).first()[0]
    d = F.lit(mean) - F.col("j")
    power = left.agg(F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3")).first()
    a = power["s3"] / (6 * power["s2"] ** 1.5) if power["s2"] else 0.0
    normal = NormalDist()
    below = ((good < point).sum() + 0.5 * (good == point).sum()) / len(good)
    z0 = normal.inv_cdf(min(1 - 0.5 / len(good), max(0.5 / len(good), below)))
    ends = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(good, normal.cdf(z0 + z / (1 - a * z)))))
    return {"point": point, "lo": ends[0], "hi": ends[1]}


def paired_delta(units_a: DataFrame, units_b: DataFrame, metric: str | Column, n_boot: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(delta, lo, hi, sign_stable) of A - B on shared draws."""
    a = replicates(units_a, metric, n_boot, seed).withColumnRenamed("value", "va")
    b = replicates(units_b, metric, n_boot, seed).withColumnRenamed("value", "vb")
    ci = percentile_ci(a.join(b, "rep").select("rep", (F.col("va") - F.col("vb")).alias("value")), alpha)
    return ci.select(F.col("point").alias("delta"), "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("sign_stable"))


def paired_rate_delta(pairs: DataFrame, above_a: Column, above_b: Column, unit: Column, n_boot: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(metric, point, lo, hi): link rates of two arms on the same pairs, and their difference on shared draws."""
    units = pairs.select(unit.alias("unit"), F.lit(1.0).alias("n"), above_a.cast("double").alias("a"), above_b.cast("double").alias("b"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    return intervals(units, {"rate_a": a / n, "rate_b": b / n, "delta": (a - b) / n}, n_boot, seed, alpha)


def group_intervals(units: DataFrame, group: str, groups: list[str], num: str, den: str, n_boot: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(metric, point, lo, hi): a ratio by group, each group's gap to the rest, and the spread, on shared draws.

    ``units`` has unit, ``group`` and the sums ``num`` and ``den``; ``groups`` are the
    values to report, and every unit counts in the whole.
    """
    wide = units.select(
        "unit", F.col(num).alias("num"), F.col(den).alias("den"),
        *[F.when(F.col(group) == g, F.col(c)).otherwise(0.0).alias(f"{s}_{i}") for i, g in enumerate(groups) for c, s in ((num, "num"), (den, "den"))],
    )

    def part(i: int) -> Column:
        return F.try_divide(F.col(f"num_{i}"), F.col(f"den_{i}"))

    def rest(i: int) -> Column:
        return F.try_divide(F.col("num") - F.col(f"num_{i}"), F.col("den") - F.col(f"den_{i}"))

    metrics: dict[str, Column] = {"all": F.try_divide("num", "den")}
    for i, g in enumerate(groups):
        metrics |= {f"rate:{g}": part(i), f"gap:{g}": part(i) - rest(i)}
    if len(groups) > 1:
        metrics["spread"] = F.greatest(*map(part, range(len(groups)))) - F.least(*map(part, range(len(groups))))
    return intervals(wide, metrics, n_boot, seed, alpha)
