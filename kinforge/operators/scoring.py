"""Mean Jaro-Winkler scores and the frequency strata of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.strings import empty_to_null, eq, jaro_winkler, norm


def attach(pairs: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """Pairs with ``<field>_a`` and ``<field>_b`` of both records."""
    left = records.select(F.col("record_id").alias("a"), *[F.col(f).alias(f"{f}_a") for f in fields])
    right = records.select(F.col("record_id").alias("b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    return pairs.join(left, "a").join(right, "b")


def present_mean(parts: list[Column]) -> Column:
    """Mean of the parts that are not null; 0 without any."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return F.when(n > 0, total / n).otherwise(0.0)


def mean_jaro_winkler(pairs: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """(a, b, jw_<field>..., prob): mean over the fields that both records have."""
    wide = attach(pairs, records, fields)
    jw = {f"jw_{f}": jaro_winkler(empty_to_null(F.col(f"{f}_a")), empty_to_null(F.col(f"{f}_b"))) for f in fields}
    return wide.select("a", "b", *[c.alias(n) for n, c in jw.items()]).withColumn("prob", present_mean([F.col(n) for n in jw]))


def agreement(pairs: DataFrame, records: DataFrame, fuzzy: list[str], exact: list[str], min_fields: int = 1) -> DataFrame:
    """(a, b, prob): mean of fuzzy similarities and exact equalities on shared fields.

    Pairs with fewer than ``min_fields`` shared fields score 0.
    """
    wide = attach(pairs, records, [*fuzzy, *exact])
    parts = {f"x_{f}": jaro_winkler(norm(F.col(f"{f}_a")), norm(F.col(f"{f}_b"))) for f in fuzzy}
    both = {f"x_{f}": F.when(norm(F.col(f"{f}_a")).isNotNull() & norm(F.col(f"{f}_b")).isNotNull(), eq(norm(F.col(f"{f}_a")), norm(F.col(f"{f}_b"))).cast("double")) for f in exact}
    cols = parts | both
    scored = wide.select("a", "b", *[c.alias(n) for n, c in cols.items()])
    shared = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in cols), F.lit(0))
    return scored.select("a", "b", F.when(shared >= min_fields, present_mean([F.col(n) for n in cols])).otherwise(0.0).alias("prob"))


def pair_strata(pairs: DataFrame, records: DataFrame, field: str = "family_name") -> DataFrame:
    """(a, b, stratum): tercile of the commoner value's frequency, or 'missing'."""
    value = norm(F.col(field))
    counts = records.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").count()
    wide = attach(pairs, records.select("record_id", value.alias(field)), [field])
    for side in "ab":
        wide = wide.join(counts.select(F.col("v").alias(f"{field}_{side}"), F.col("count").alias(f"n_{side}")), f"{field}_{side}", "left")
    top = wide.select("a", "b", F.when(F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), F.greatest("n_a", "n_b")).alias("n"))
    cut = top.agg(F.percentile("n", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c")).first()["c"] or [0.0, 0.0]
    band = F.when(F.col("n").isNull(), "missing").when(F.col("n") <= cut[0], "rare").when(F.col("n") <= cut[1], "middle").otherwise("common")
    return top.select("a", "b", band.alias("stratum"))
