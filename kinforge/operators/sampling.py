"""Samples and splits that keep whole units together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.draws import draw, order_key


def _ordered_units(df: DataFrame, unit: str, salt: str) -> DataFrame:
    """(unit, n, before): sizes and running sizes in hashed order.

    The running sum is taken in two levels (hash prefix, then within it), so no
    single task orders all units.
    """
    sizes = df.groupBy(unit).agg(F.count("*").alias("n")).withColumn("h", order_key(unit, salt=salt)).withColumn("part", F.substring("h", 1, 3))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("m"))
    head = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
    parts = parts.select("part", F.coalesce(F.sum("m").over(head), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("h", unit).rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(parts), "part")
    return out.select(unit, "n", (F.col("start") + F.col("inner")).alias("before"))


def entity_complete_subsample(df: DataFrame, n: int, seed: int = 0, unit: str = "entity_id") -> DataFrame:
    """Whole entities in hashed order until about ``n`` records; the last may overrun."""
    return df.join(_ordered_units(df, unit, f"sub{seed}").where(F.col("before") < n).select(unit), unit, "left_semi")


def entity_ladder(df: DataFrame, sizes: list[int], seed: int = 0, unit: str = "entity_id") -> DataFrame:
    """(rung, record_id): nested samples of whole entities, one for each size."""
    units = _ordered_units(df, unit, f"ladder{seed}")
    rungs = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda s: F.col("before") < s)
    return df.join(units.select(unit, F.explode(rungs).alias("rung")), unit).select("rung", "record_id")


def greedy_half(df: DataFrame, unit: str, seed: int = 0) -> DataFrame:
    """``df`` with ``side``: units in hashed order fill train until half the rows are there."""
    half = df.count() / 2
    units = _ordered_units(df, unit, f"half{seed}").select(unit, F.when(F.col("before") < half, "train").otherwise("eval").alias("side"))
    return df.join(units, unit)


def build_splits(df: DataFrame, units: dict[str, str | None], seed: int = 0) -> DataFrame:
    """(record_id, split, side): halves by hash of the named unit (None: the record)."""
    out = None
    for name, unit in units.items():
        side = F.when(draw(F.col(unit or "record_id"), f"split{seed}:{name}") % 2 == 0, "train").otherwise("eval")
        part = df.select("record_id", F.lit(name).alias("split"), side.alias("side"))
        out = part if out is None else out.unionByName(part)
    return out


def split_checks(splits: DataFrame, df: DataFrame, unit: str = "entity_id") -> DataFrame:
    """(split, n_units, n_straddling) for each split."""
    joined = splits.join(df.select("record_id", unit), "record_id")
    per_unit = joined.groupBy("split", unit).agg(F.count_distinct("side").alias("sides"))
    return per_unit.groupBy("split").agg(F.count("*").alias("n_units"), F.count_if(F.col("sides") > 1).alias("n_straddling"))
