"""Scaling fits, extreme-value tails and cost projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinforge.functions.strings import soundex
from kinforge.session import materialize


def t_cdf(t: float, df: int) -> float:
    """Student's t distribution by the regularised incomplete beta function."""
    x = df / (df + t * t)
    half = 0.5 * _beta(df / 2, 0.5, x)
    return 1 - half if t > 0 else half


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_quantile(p: float, df: int) -> float:
    """Inverse of :func:`t_cdf` by bisection."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class ScalingFit:
    """Least squares of log y (powerlaw) or y (loglinear) on log x."""

    form: str
    intercept: float
    slope: float
    sigma: float
    n: int
    mean_x: float
    sxx: float
    r2: float

    def predict(self, x: float, alpha: float = 0.05) -> tuple[float, float, float]:
        """(value, low, high) with a prediction interval."""
        u = math.log(x)
        mid = self.intercept + self.slope * u
        half = t_quantile(1 - alpha / 2, self.n - 2) * self.sigma * math.sqrt(1 + 1 / self.n + (u - self.mean_x) ** 2 / self.sxx) if self.n > 2 else math.inf
        back = math.exp if self.form == "powerlaw" else float
        return back(mid), back(mid - half) if half < math.inf else -math.inf, back(mid + half) if half < math.inf else math.inf


def fit_scaling(df: DataFrame, x: str = "x", y: str = "y", form: str = "powerlaw") -> ScalingFit:
    """Fit from the sums that one aggregate gives."""
    if form not in ("powerlaw", "loglinear"):
        raise ValueError(f"unknown form {form!r}")
    u = F.log(F.col(x).cast("double"))
    v = F.log(F.col(y).cast("double")) if form == "powerlaw" else F.col(y).cast("double")
    r = df.agg(F.regr_slope(v, u).alias("b"), F.regr_intercept(v, u).alias("a"), F.regr_sxx(v, u).alias("sxx"), F.regr_syy(v, u).alias("syy"), F.regr_r2(v, u).alias("r2"), F.avg(u).alias("m"), F.count("*").alias("n")).first()
    rss = max(0.0, r["syy"] - r["b"] ** 2 * r["sxx"])
    return ScalingFit(form, r["a"], r["b"], math.sqrt(rss / max(1, r["n"] - 2)), r["n"], r["m"], r["sxx"], r["r2"])


def validate_extrapolation(fit: ScalingFit, x: float, y: float, alpha: float = 0.05) -> dict[str, float | bool]:
    """Whether a held-out point lies in the prediction interval, and how far off it is."""
    mid, lo, hi = fit.predict(x, alpha)
    log = math.log if fit.form == "powerlaw" else float
    width = (log(hi) - log(mid)) / t_quantile(1 - alpha / 2, fit.n - 2) if fit.n > 2 else math.inf
    return {"inside": lo <= y <= hi, "z": (log(y) - log(mid)) / width if width else 0.0}


# --- tails -------------------------------------------------------------------


def _gpd_grid(top: float, mean: float) -> np.ndarray:
    return np.concatenate([np.linspace(-0.999 / top, -1e-6 / mean, 200), np.geomspace(1e-6 / mean, 50 / mean, 300)])


def _gpd_loss(theta: float, xi: float) -> float:
    """Profile loss, where ``xi`` is the mean of log1p(theta * excess)."""
    scale = xi / theta
    return math.log(scale) + xi + 1 if scale > 0 else math.inf


def gpd_fit(excess: np.ndarray) -> tuple[float, float]:
    """(shape, scale) by profile likelihood over theta = shape / scale."""
    grid = _gpd_grid(excess.max(), excess.mean())

    def loss(theta: float) -> float:
        return _gpd_loss(theta, np.log1p(theta * excess).mean())

    values = [loss(t) for t in grid]
    i = int(np.argmin(values))
    lo, hi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    for _ in range(80):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    theta = (lo + hi) / 2
    xi = float(np.log1p(theta * excess).mean())
    return xi, float(xi / theta)


def gpd_fit_rows(over: DataFrame, n: int, rounds: int = 7) -> tuple[float, float, float]:
    """(shape, scale, qq_r2) of all excesses ``e``, by sums over the executors.

    The grid of ``gpd_fit``, then ever finer ones between the neighbours of the
    best value; ranks are those within a range of values plus the rows before it.
    """
    ranged = over.repartitionByRange("e").withColumn("part", F.spark_partition_id())
    rows = materialize(ranged.select("part", F.col("e").cast("double").alias("e")), "excess")

    def means(thetas: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(thetas))
            for batch in batches:
                e = batch.column(0).to_numpy()
                total += [np.log1p(t * e).sum() for t in thetas]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(thetas)), pa.int32()), pa.array(total)], names=["cell", "v"])

        sums = rows.select("e").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
        return np.array([r["v"] for r in sums]) / n

    ends = rows.agg(F.max("e").alias("top"), F.avg("e").alias("mean")).first()
    grid = _gpd_grid(ends["top"], ends["mean"])
    for _ in range(rounds):
        xis = means(grid)
        i = int(np.argmin([_gpd_loss(t, x) for t, x in zip(grid, xis, strict=True)]))
        theta, xi = float(grid[i]), float(xis[i])
        # a middle between the neighbours, never zero, where shape and theta are both 0
        grid = np.linspace(grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], 40)
        grid = grid[grid != 0]
    scale = xi / theta
    before, starts = 0, []
    for part, many in sorted(rows.groupBy("part").count().collect()):
        starts.append((part, before))
        before += many
    shift = over.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("e")) + F.col("before")
    placed = rows.join(F.broadcast(shift), "part").select("e", ((rank - 0.5) / n).alias("p"))  # one row a partition
    z = F.log1p(F.greatest(F.lit(xi) * F.col("e") / scale, F.lit(-1 + 1e-12))) / xi if abs(xi) > 1e-9 else F.col("e") / scale
    r = placed.agg(F.corr(-F.log1p(-F.col("p")), z)).first()[0]
    return xi, scale, float(r * r)


def gpd_survival(x: float, xi: float, scale: float) -> float:
    if abs(xi) < 1e-9:
        return math.exp(-x / scale)
    base = 1 + xi * x / scale
    return base ** (-1 / xi) if base > 0 else 0.0


def fit_gpd_tail(scores: DataFrame, column: str = "score", quantiles: tuple[float, ...] = (0.95, 0.99, 0.995), local: int = 200_000) -> list[dict[str, float]]:
    """Fit excesses above each quantile; thresholds come from all rows.

    Every fit is of all excesses: up to ``local`` are fitted on the driver, more
    of them by sums over the executors.
    """
    cuts = scores.agg(F.percentile(column, F.array(*map(F.lit, quantiles))).alias("c"), F.count("*").alias("n")).first()
    out = []
    for q, u in zip(quantiles, cuts["c"], strict=True):
        over = scores.where(F.col(column) > u).select((F.col(column) - u).alias("e"))
        n = over.count()
        if n > local:
            xi, scale, r2 = gpd_fit_rows(over, n)
            out.append({"quantile": q, "threshold": u, "n": n, "xi": xi, "scale": scale, "qq_r2": r2, "rate": n / cuts["n"]})
            continue
        excess = np.sort(np.array([r["e"] for r in over.toLocalIterator()], float))
        if len(excess) < 2 or excess.max() <= 0:
            out.append({"quantile": q, "threshold": u, "n": n, "xi": math.nan, "scale": math.nan, "qq_r2": math.nan, "rate": n / cuts["n"]})
            continue
        xi, scale = gpd_fit(excess)
        p = (np.arange(1, len(excess) + 1) - 0.5) / len(excess)
        z = np.log1p(np.maximum(xi * excess / scale, -1 + 1e-12)) / xi if abs(xi) > 1e-9 else excess / scale
        r = np.corrcoef(-np.log1p(-p), z)[0, 1]
        out.append({"quantile": q, "threshold": u, "n": n, "xi": xi, "scale": scale, "qq_r2": float(r * r), "rate": n / cuts["n"]})
    return out


def diagnostics_pass(fits: list[dict[str, float]], least: int = 30, spread: float = 0.35, r2: float = 0.95) -> bool:
    """Enough exceedances, stable shape, straight quantile plot; undefined values fail."""
    xis = [f["xi"] for f in fits]
    if any(math.isnan(x) for x in xis) or any(math.isnan(f["qq_r2"]) for f in fits):
        return False
    return all(f["n"] >= least for f in fits) and max(xis) - min(xis) <= spread and all(f["qq_r2"] >= r2 for f in fits)


def predict_fp_count(fit: dict[str, float], n_comparisons: float, threshold: float) -> float:
    """Expected exceedances of a threshold among so many comparisons."""
    return n_comparisons * fit["rate"] * gpd_survival(max(0.0, threshold - fit["threshold"]), fit["xi"], fit["scale"])


def threshold_for_rate(fit: dict[str, float], rate: float) -> float:
    """Threshold whose exceedance rate is ``rate``."""
    ratio = rate / fit["rate"]
    if ratio >= 1:
        return fit["threshold"]
    xi, s = fit["xi"], fit["scale"]
    return fit["threshold"] + (-s * math.log(ratio) if abs(xi) < 1e-9 else s / xi * (ratio**-xi - 1))


def mean_excess(scores: DataFrame, thresholds: list[float], column: str = "score") -> DataFrame:
    """(threshold, n, mean_excess) in one pass."""
    cuts = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda u: F.col(column) > u)).alias("threshold")
    return scores.select(column, cuts).groupBy("threshold").agg(F.count("*").alias("n"), F.avg(F.col(column) - F.col("threshold")).alias("mean_excess"))


# --- cost --------------------------------------------------------------------


class CeilingError(ValueError):
    """The design does not fit the stated machine."""


NODE_GB, GPU_GB, EDGE_BYTES = 900.0, 4 * 80.0, 24


def cost_breakdown(spark: SparkSession, n_records: int, coefficients: dict[str, float], prices: dict[str, float], dim: int = 384, bytes_per: float = 4.0, edges_per_record: float = 10.0, measured_max: int = 10_000_000, single_node: bool = False) -> DataFrame:
    """(stage, hours, dollars, gigabytes, basis) of serialise, encode, block and cluster.

    ``coefficients`` are records a second of each stage; ``basis`` tells measured
    sizes from extrapolated ones. With ``single_node`` a design beyond the memory
    of one machine raises.
    """
    basis = "MEASURED" if n_records <= measured_max else "EXTRAPOLATED"
    vectors = n_records * dim * bytes_per / 1e9
    edges = n_records * edges_per_record * EDGE_BYTES / 1e9
    if single_node and (vectors + edges > NODE_GB or vectors > GPU_GB):
        raise CeilingError(f"{vectors + edges:.0f} GB exceed one machine")
    rows = []
    for stage, gb, price in (("serialise", 0.0, "core_h"), ("encode", vectors, "gpu_h"), ("block", 0.0, "core_h"), ("cluster", edges, "core_h")):
        if coefficients[stage] <= 0:
            raise ValueError(f"rate of {stage} must be positive")
        hours = n_records / coefficients[stage] / 3600
        rows.append((stage, float(hours), float(hours * prices[price]), float(gb), basis))
    return spark.createDataFrame(rows, "stage string, hours double, dollars double, gigabytes double, basis string")


# --- frequency laws ----------------------------------------------------------


def shares(df: DataFrame, value: Column) -> DataFrame:
    """(value, n, share) of the present values."""
    counts = df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # one-row side


def soundex_shares(df: DataFrame, column: str) -> DataFrame:
    return shares(df, soundex(F.col(column)))


def zipf_slope(table: DataFrame) -> DataFrame:
    """Slope of log10 share on log10 rank.

    Ranks come from the counts of equal shares (values that occur once share a
    run of ranks), so no task orders all values.
    """
    runs = table.groupBy("share").agg(F.count("*").alias("k"))
    down = Window.orderBy(F.desc("share")).rowsBetween(Window.unboundedPreceding, -1)  # distinct shares are few
    runs = runs.withColumn("before", F.coalesce(F.sum("k").over(down), F.lit(0)))
    points = runs.select(F.log10("share").alias("y"), F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("k")), lambda i: F.log10((F.col("before") + i).cast("double")))).alias("x"))
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.count("*").alias("n_values"))


def collision_mass(df: DataFrame, fields: list[str]) -> DataFrame:
    """Probability that two random records agree on the fields but not on the entity."""
    cells = df.dropna(subset=fields).groupBy(*fields, "entity_id").agg(F.count("*").alias("c"))
    groups = cells.groupBy(*fields).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    total = df.dropna(subset=fields).agg(F.count("*").alias("total"))
    return groups.agg(F.sum(F.col("n") * F.col("n") - F.col("same")).alias("cross")).crossJoin(total).select(  # one-row aggregates
        (F.col("cross") / (F.col("total") * (F.col("total") - 1))).alias("mass")
    )


def normal_sf(z: float) -> float:
    return 1 - NormalDist().cdf(z)
