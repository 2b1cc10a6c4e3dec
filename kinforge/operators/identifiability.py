"""Which records no method could tell apart on the given fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checked(df: DataFrame, fields: list[str]) -> None:
    absent = sorted({*fields, "record_id", "entity_id"} - set(df.columns))
    if absent:
        raise KeyError(f"columns {absent} are absent")
    bad = df.agg(F.count_if(F.col("entity_id").isNull()).alias("t"), (F.count("*") - F.count_distinct("record_id")).alias("r")).first()
    if bad["t"] or bad["r"]:
        raise ValueError("null truth or repeated record_id")


def unresolvable(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with boolean ``unresolvable``: another entity has the same field values.

    Null equals null here. The tuples are reduced before they meet the rows, so
    a very common tuple is one row of the table that is joined.
    """
    _checked(df, fields)
    shared = df.groupBy(*fields).agg((F.min("entity_id") != F.max("entity_id")).alias("unresolvable"))
    same = None
    right = shared.select(*[F.col(f).alias(f"__{f}") for f in fields], "unresolvable")
    for f in fields:
        one = F.col(f).eqNullSafe(F.col(f"__{f}"))
        same = one if same is None else same & one
    return df.join(right, same).select(*df.columns, "unresolvable")


def report(df: DataFrame, fields: list[str], by: str | None = None) -> DataFrame:
    """(level, n, n_unresolvable, rate): all records, then each value of ``by``."""
    marked = unresolvable(df, fields)
    measures = [F.count("*").alias("n"), F.count_if("unresolvable").alias("n_unresolvable"), F.avg(F.col("unresolvable").cast("double")).alias("rate")]
    out = marked.agg(*measures).select(F.lit("overall").alias("level"), F.lit(None).cast("string").alias("value"), "n", "n_unresolvable", "rate")
    if by:
        groups = marked.groupBy(F.col(by).cast("string").alias("value")).agg(*measures)
        out = out.unionByName(groups.select(F.lit(by).alias("level"), "value", "n", "n_unresolvable", "rate"))
    return out


def conditioned(labels: DataFrame, marked: DataFrame) -> DataFrame:
    """Labels of the resolvable records only; raises when the mask misses a record."""
    if labels.join(marked, "record_id", "left_anti").limit(1).count():
        raise ValueError("the mask does not cover every record")
    return labels.join(marked.where("unresolvable").select("record_id"), "record_id", "left_anti")


def duplicate_profile(df: DataFrame, key: str, changing: list[str]) -> DataFrame:
    """Keys that occur more than once, and how many of them change each column."""
    per_key = df.groupBy(key).agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(c) for c in changing])
    return per_key.agg(
        F.count("*").alias("n_keys"),
        F.sum("rows").alias("n_rows"),
        F.count_if(F.col("rows") > 1).alias("n_multi"),
        F.max("rows").alias("max_rows"),
        *[F.count_if(F.col(c) > 1).alias(f"n_change_{c}") for c in changing],
    )
