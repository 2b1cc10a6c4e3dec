"""Group-wise noise exposure: rate multipliers fitted from observed prevalence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ExposureModel:
    """Multipliers (group columns, multiplier); None means 1 for every record."""

    groups: tuple[str, ...] = ()
    table: DataFrame | None = None

    @classmethod
    def uniform(cls) -> ExposureModel:
        return cls()

    @classmethod
    def from_table(cls, df: DataFrame) -> ExposureModel:
        """A table of group columns and ``multiplier`` (or ``rate``); groups must be distinct."""
        if "multiplier" not in df.columns:
            return cls.fit(df)
        groups = tuple(c for c in df.columns if c != "multiplier")
        if not groups:
            raise ValueError("group columns are needed")
        if df.where("multiplier IS NULL OR multiplier < 0").limit(1).count():
            raise ValueError("multipliers must not be negative or null")
        if df.groupBy(*groups).count().where("count > 1").limit(1).count():
            raise ValueError("a group occurs twice")
        return cls(groups, df)

    @classmethod
    def fit(cls, prevalence: DataFrame) -> ExposureModel:
        """Rate of each group over the n-weighted overall rate.

        Rows with a null group count in the overall rate only.
        """
        groups = tuple(c for c in prevalence.columns if c not in ("rate", "n"))
        n = F.col("n") if "n" in prevalence.columns else F.lit(1)
        overall = prevalence.agg((F.sum(F.col("rate") * n) / F.sum(n)).alias("overall"))
        known = prevalence.dropna(subset=list(groups)).crossJoin(F.broadcast(overall))  # one-row side
        return cls(groups, known.select(*groups, (F.col("rate") / F.col("overall")).alias("multiplier")))

    def rates(self, df: DataFrame, base_rate: Column | float) -> DataFrame:
        """``df`` with ``rate``: base times multiplier, unknown groups 1, clipped to [0, 1]."""
        base = F.lit(base_rate) if isinstance(base_rate, float | int) else base_rate
        if self.table is None:
            return df.withColumn("rate", F.least(F.lit(1.0), F.greatest(F.lit(0.0), base)))
        joined = df.join(self.table, list(self.groups), "left")
        rate = base * F.coalesce("multiplier", F.lit(1.0))
        return joined.withColumn("rate", F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate))).drop("multiplier")
