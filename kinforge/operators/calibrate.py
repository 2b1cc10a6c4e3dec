"""Isotonic and Platt calibration, pooled and by stratum; calibration error."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("isotonic", "platt")


def pav(x: list[float], y: list[float], w: list[float]) -> list[tuple[float, float]]:
    """Pool adjacent violators over increasing x: (x, value) at block edges."""
    blocks: list[list[float]] = []  # sum wy, sum w, first x, last x
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([yi * wi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    out = []
    for s, n, first, last in blocks:
        out.append((first, s / n))
        if last > first:
            out.append((last, s / n))
    return out


def platt(x: list[float], y: list[float], w: list[float], ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and intercept of a (practically unpenalised) logistic fit."""
    xs, ys, ws = map(np.asarray, (x, y, w))
    beta = np.zeros(2)
    design = np.stack([xs, np.ones_like(xs)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        grad = design.T @ (ws * (p - ys)) + ridge * np.array([beta[0], 0.0])
        hess = (design * (ws * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + np.diag([ridge, 1e-12])
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Calibrator:
    """Pooled map and one map per stratum that could be fitted."""

    method: str
    pooled: object
    by_stratum: dict[str, object] = field(default_factory=dict)
    fallback: list[str] = field(default_factory=list)

    def _map(self, model: object, score: Column) -> Column:
        if self.method == "platt":
            a, b = model
            return 1 / (1 + F.exp(-(F.lit(a) * score + F.lit(b))))
        points = model
        out = F.lit(points[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
            inside = F.lit(y0) + (score - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)
            out = F.when(score < x1, inside).otherwise(out)
        return F.when(score <= points[0][0], F.lit(points[0][1])).otherwise(out)

    def transform(self, score: Column, stratum: Column | None = None) -> Column:
        """Calibrated probability; unseen and unfittable strata use the pooled map."""
        if self.by_stratum and stratum is None:
            raise ValueError("this calibrator needs strata")
        out = self._map(self.pooled, score)
        for name, model in self.by_stratum.items():
            out = F.when(stratum == name, self._map(model, score)).otherwise(out)
        return out


def _fit(groups: list[tuple[float, float, float]], method: str) -> object | None:
    """Fit on (score, positives, n) groups; None when only one label occurs."""
    pos, total = sum(g[1] for g in groups), sum(g[2] for g in groups)
    if not groups or pos in (0, total):
        return None
    x, y, w = [g[0] for g in groups], [g[1] / g[2] for g in groups], [g[2] for g in groups]
    return platt(x, y, w) if method == "platt" else pav(x, y, w)


def _times(scored: DataFrame) -> Column:
    """Pairs that a row stands for: its ``n`` if it has one."""
    return F.col("n") if "n" in scored.columns else F.lit(1).cast("long")


def fit_calibrator(scored: DataFrame, method: str = "isotonic", stratum: str | None = None, digits: int = 4) -> Calibrator:
    """Fit on (score, label[, stratum]); scores are grouped at ``digits`` places.

    Grouping bounds what reaches the driver by the number of different rounded
    scores and strata, whatever the number of rows.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    keys = [F.round("score", digits).alias("x")] + ([F.col(stratum).alias("s")] if stratum else [])
    rows = scored.groupBy(*keys).agg(F.sum(F.col("label").cast("double") * _times(scored)).alias("pos"), F.sum(_times(scored)).alias("n")).collect()
    table: dict[str | None, dict[float, list[float]]] = {}
    for r in rows:
        for name in {None, r["s"] if stratum else None}:
            cell = table.setdefault(name, {}).setdefault(r["x"], [0.0, 0.0])
            cell[0] += r["pos"]
            cell[1] += r["n"]
    fits = {name: _fit(sorted((x, p, n) for x, (p, n) in cells.items()), method) for name, cells in table.items()}
    if fits.get(None) is None:
        raise ValueError("both labels are needed")
    strata = {k: v for k, v in fits.items() if k is not None}
    return Calibrator(method, fits[None], {k: v for k, v in strata.items() if v is not None}, sorted(k for k, v in strata.items() if v is None))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) over equal-width bins."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    n = _times(scored)
    mean, rate = F.sum(F.col("score") * n) / F.sum(n), F.sum(F.col("label").cast("double") * n) / F.sum(n)
    return scored.groupBy(at.alias("bin")).agg(F.sum(n).alias("n"), mean.alias("mean_score"), rate.alias("rate"))


def expected_calibration_error(scored: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Weighted mean gap between score and rate over the bins."""
    by = by or []
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    n = _times(scored)
    gap = F.abs(F.sum(F.col("score") * n) / F.sum(n) - F.sum(F.col("label").cast("double") * n) / F.sum(n))
    cells = scored.groupBy(*by, at.alias("bin")).agg(F.sum(n).alias("n"), gap.alias("gap"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def logit(p: float) -> float:
    return math.log(p / (1 - p))
