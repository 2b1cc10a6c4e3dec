"""Running sums in the order of a value, without one task that orders all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.session import materialize

#: Ranges of the value that are summed apart.
RANGES = 256


def running_sums(df: DataFrame, column: str, sums: list[str], descending: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``run_<c>`` for each of ``sums``: the total up to this row, itself included.

    ``df`` has a row for each value of ``column`` (and of ``by``). Its values are cut
    into ranges at approximate quantiles; sums run within each range and on top of
    the totals of the ranges before, which are few.
    """
    df = materialize(df, "values")
    cuts = df.agg(F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    value = F.col(column)
    held = F.lit(sorted({float(c) for c in cuts})).cast("array<double>") if cuts else F.array().cast("array<double>")
    part = F.size(F.filter(held, lambda c: (c >= value) if descending else (c < value)))
    part = F.when(value.isNull(), RANGES if descending else -1).otherwise(part)  # where such rows sort
    df = df.withColumn("__range", part)
    head = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    starts = totals.select(
        *[F.col(c).alias(f"__b_{c}") for c in by], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__t_{c}").over(head), F.lit(0)).alias(f"__s_{c}") for c in sums]
    )
    within = Window.partitionBy(*by, "__range").orderBy(value.desc() if descending else value.asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"__w_{c}": F.sum(c).over(within) for c in sums})
    same = out["__range"] == starts["__r"]
    for c in by:
        same = same & out[c].eqNullSafe(starts[f"__b_{c}"])
    joined = out.join(starts, same)
    return joined.select(*[c for c in df.columns if c != "__range"], *[(F.col(f"__s_{c}") + F.col(f"__w_{c}")).alias(f"run_{c}") for c in sums])
