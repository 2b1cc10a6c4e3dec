"""Variance components, detectability and seeds needed."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variance_components(df: DataFrame, factors: list[str], value: str = "value") -> dict[str, float]:
    """Crossed random effects by the method of moments, from group means only.

    A factor's component is the variance of its level means less the residual's
    share, never below 0, and NaN for a factor with one level. ``residual`` is
    what the additive fit leaves. Rows without a value are left out; too few rows
    for a residual, and values that are not finite, are errors.
    """
    if not factors:
        raise ValueError("no factors")
    df = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    finite = F.sum(F.when(F.isnan(value) | (F.abs(value) == float("inf")), 1).otherwise(0))
    n, grand, odd = df.agg(F.count("*"), F.avg(value), finite).first()
    if odd:
        raise ValueError("values must be finite")
    means, sizes, effects = {}, {}, df.withColumn("__fit", F.lit(grand))
    for f in factors:
        m = df.groupBy(F.col(f).alias("__level")).agg(F.avg(value).alias("__mean"))
        row = m.agg(F.var_samp("__mean").alias("v"), F.count("*").alias("k")).first()
        means[f], sizes[f] = row["v"], row["k"]
        effects = effects.join(m, F.col(f).eqNullSafe(F.col("__level"))).withColumn("__fit", F.col("__fit") + F.col("__mean") - grand).drop("__level", "__mean")
    free = n - 1 - sum(k - 1 for k in sizes.values())
    if free <= 0:
        raise ValueError(f"not enough rows for a residual: {n} rows leave {free} degrees of freedom")
    residual = effects.agg(F.sum(F.pow(F.col(value) - F.col("__fit"), 2))).first()[0] / free
    out = {f: max(0.0, means[f] - residual * sizes[f] / n) if sizes[f] > 1 else float("nan") for f in factors}
    return out | {"residual": residual}


def _variances(components: dict[str, float], keys: tuple[str, ...]) -> list[float]:
    """The named components; one of them may be absent (0), but not all while others are there."""
    others = sorted(set(components) - {*keys, "residual"})
    if others and not any(k in components for k in keys):
        raise ValueError(f"components {others} hold none of {keys}: name the factors")
    found = [components.get(k, 0.0) for k in keys]
    if any(not math.isfinite(v) or v < 0 for v in found):
        raise ValueError("components must be finite and not negative")
    return found


def detect_bar(components: dict[str, float], keys: tuple[str, ...] = ("seed", "noise_draw"), include_residual: bool = True) -> float:
    """Difference two standard errors of a difference away from 0."""
    variance = sum(_variances(components, keys))
    if include_residual:
        if "residual" not in components:
            raise ValueError("components have no residual")
        variance += _variances(components, ("residual",))[0]
    return 2 * math.sqrt(2 * variance)


def _factor(alpha: float, power: float, two_sided: bool) -> float:
    normal = NormalDist()
    return normal.inv_cdf(1 - alpha / (2 if two_sided else 1)) + normal.inv_cdf(power)


def seeds_needed(delta: float, var_seed: float, var_noise: float, alpha: float = 0.05, power: float = 0.8, two_sided: bool = True) -> int:
    """Paired seeds to detect ``delta``, two at least."""
    if delta <= 0:
        raise ValueError("delta must be positive")
    return max(2, math.ceil(_factor(alpha, power, two_sided) ** 2 * (var_seed + var_noise) / delta**2))


def achieved_power(delta: float, variance: float, n: int, alpha: float = 0.05, two_sided: bool = True) -> float:
    normal = NormalDist()
    if variance <= 0:
        return 1.0
    return normal.cdf(delta / math.sqrt(variance / n) - normal.inv_cdf(1 - alpha / (2 if two_sided else 1)))


def power_table(spark, deltas: list[float], components: dict[str, float], levels: tuple[int, ...] = (3, 5, 10), alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """(delta, seeds, power_at_<n>...) for each delta."""
    seed, noise = _variances(components, ("seed", "noise_draw"))
    rows = [(float(d), seeds_needed(d, seed, noise, alpha, power), *(achieved_power(d, seed + noise, n, alpha) for n in levels)) for d in deltas]
    return spark.createDataFrame(rows, "delta double, seeds long, " + ", ".join(f"power_at_{n} double" for n in levels))
