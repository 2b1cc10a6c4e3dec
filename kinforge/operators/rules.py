"""Rules over scored pairs: override, guard and floor masks, and their grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.strings import eq, norm
from kinforge.operators.scoring import attach


def birth_year(df: DataFrame, snapshot_year: int | None = None) -> Column:
    """Year of dob, else snapshot year minus age."""
    year = F.regexp_extract(F.col("dob"), r"^(\d{4})", 1).try_cast("int") if "dob" in df.columns else F.lit(None).cast("int")
    if "age" in df.columns and snapshot_year is not None:
        year = F.coalesce(year, F.lit(snapshot_year) - F.col("age").try_cast("int"))
    return year


def fires(pairs: DataFrame, records: DataFrame, gap: int = 2, floor: float = 0.2, snapshot_year: int | None = None) -> DataFrame:
    """Pairs with boolean columns override, guard and under_floor.

    override: same given and family name and birth date, or birth years at most
    one apart; guard: birth years more than ``gap`` apart; under_floor: the score
    is below the floor. A missing value fires nothing.
    """
    rows = records.select("record_id", norm(F.col("given_name")).alias("g"), norm(F.col("family_name")).alias("f"), norm(F.col("dob")).alias("d"), birth_year(records, snapshot_year).alias("y"))
    wide = attach(pairs, rows, ["g", "f", "d", "y"])
    names = eq(F.col("g_a"), F.col("g_b")) & eq(F.col("f_a"), F.col("f_b"))
    apart = F.abs(F.col("y_a") - F.col("y_b"))
    near = F.coalesce(apart <= 1, F.lit(False))
    far = F.coalesce(apart > gap, F.lit(False))
    return wide.select(*pairs.columns, (names & (eq(F.col("d_a"), F.col("d_b")) | near)).alias("override"), far.alias("guard"), (F.col("prob") < floor).alias("under_floor"))


def apply_rules(fired: DataFrame) -> DataFrame:
    """Hybrid probability: 1 on override, else 0 on guard or below the floor, else the score."""
    hybrid = F.when(F.col("override"), 1.0).when(F.col("guard") | F.col("under_floor"), 0.0).otherwise(F.col("prob"))
    return fired.withColumn("prob", hybrid)


def apply_rules_ranked(fired: DataFrame) -> DataFrame:
    """The same as shifts on a cosine scale, so pairs stay ranked within each part."""
    shift = F.when(F.col("override"), 2.0).when(F.col("guard") | F.col("under_floor"), -2.0).otherwise(0.0)
    return fired.withColumn("prob", F.col("prob") + shift)
