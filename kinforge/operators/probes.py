"""Probe sets: pairs that a good text encoder must, or must not, hold together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import dates
from kinforge.functions.draws import order_key
from kinforge.operators import channels, operating
from kinforge.session import materialize

DIAL = (0.02, 0.05, 0.1, 0.2)


def _sample(df: DataFrame, n: int, salt: str) -> DataFrame:
    return df.withColumn("__h", order_key("record_id", salt=salt)).orderBy("__h", "record_id").limit(n).drop("__h")


def build_probe_set(records: DataFrame, serialize, seed: int = 0, n_per_slice: int = 200, dial: tuple[float, ...] = DIAL) -> DataFrame:
    """(slice, kind, text_a, text_b): kind is hold or must_not_hold.

    ``serialize(df)`` gives the text column of a record table. Slices: typo dial,
    nickname, format drift and field order (hold); birth year shift, suffix and
    twin (must not hold).
    """

    def texts(base: DataFrame, changed: DataFrame, name: str, kind: str) -> DataFrame:
        a = base.select("record_id", serialize(base).alias("text_a"))
        b = changed.select("record_id", serialize(changed).alias("text_b"))
        return a.join(b, "record_id").where("text_a <> text_b").select(F.lit(name).alias("slice"), F.lit(kind).alias("kind"), "text_a", "text_b")

    base = materialize(_sample(records, n_per_slice, f"{seed}:probe"), "probe")
    out = [texts(base, channels.typo().apply(base, min(1.0, r * 5), seed + i)[0], f"typo@{r:g}", "hold") for i, r in enumerate(dial)]
    out.append(texts(base, channels.nickname().apply(base, 1.0, seed)[0], "nickname", "hold"))
    out.append(texts(base, channels.field_format_drift().apply(base, 1.0, seed)[0], "format_drift", "hold"))
    shifted = base.withColumn("dob", F.coalesce(dates.shift_years(F.col("dob"), 7), F.col("dob")))
    out.append(texts(base, shifted, "birth_year", "must_not_hold"))
    twin = base.withColumn("given_name", F.when(F.col("given_name") == "Felix", "Clara").otherwise("Felix"))
    out.append(texts(base, twin, "twin", "must_not_hold"))
    if "name_suffix" in base.columns:
        out.append(texts(base.withColumn("name_suffix", F.lit("SR")), base.withColumn("name_suffix", F.lit("JR")), "jr_sr", "must_not_hold"))
    probes = out[0]
    for part in out[1:]:
        probes = probes.unionByName(part)
    return probes


def battery_report(probes: DataFrame, encode, positives: DataFrame | None = None) -> DataFrame:
    """(slice, kind, n, mean, p05, p95[, auc]): cosines of each slice, and how far
    true pairs (``positives``: text_a, text_b) rank above a must-not-hold slice.

    ``encode(column)`` gives a unit-vector column.
    """
    from kinforge.operators.ann import dot

    def cosine(df: DataFrame) -> DataFrame:
        return df.withColumn("cosine", dot(encode(F.col("text_a")), encode(F.col("text_b"))))

    scored = materialize(cosine(probes), "battery")
    out = scored.groupBy("slice", "kind").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.percentile("cosine", F.lit(0.05)).alias("p05"), F.percentile("cosine", F.lit(0.95)).alias("p95"))
    if positives is None:
        return out
    good = cosine(positives).select(F.col("cosine").alias("score"), F.lit(1).alias("label"))
    slices = scored.select("slice").distinct()
    rows = scored.select("slice", F.col("cosine").alias("score"), F.lit(0).alias("label")).unionByName(slices.join(good).select("slice", "score", "label"))  # few slices
    return out.join(operating.auc(rows, ["slice"]).select("slice", "auc"), "slice", "left")


def mask_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Personal values with every visible character replaced."""
    masked: dict[str, Column] = {c: F.regexp_replace(F.col(c), r"\S", "x") for c in columns}
    return df.withColumns(masked)
