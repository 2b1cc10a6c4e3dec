"""Labelling queues, label histories and agreement between annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("match", "nonmatch", "unsure")
HISTORY = "pair_id string, label string, annotator string, at string"


def pair_queue(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct canonical pairs (pair_id, a, b) in order; raises on loops and unknown ids."""
    queue = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if queue.where("a = b OR a IS NULL OR b IS NULL").limit(1).count():
        raise ValueError("a pair needs two records")
    if queue.select(F.explode(F.array("a", "b")).alias("record_id")).join(records, "record_id", "left_anti").limit(1).count():
        raise ValueError("unknown record_id")
    if records.groupBy("record_id").count().where("count > 1").limit(1).count():
        raise ValueError("repeated record_id")
    return queue.select(F.concat_ws("||", "a", "b").alias("pair_id"), "a", "b").orderBy("a", "b")


def items(queue: DataFrame, records: DataFrame) -> DataFrame:
    """Each pair with both records as structs."""
    whole = F.struct(*records.columns)
    left = records.select(F.col("record_id").alias("a"), whole.alias("record_a"))
    right = records.select(F.col("record_id").alias("b"), whole.alias("record_b"))
    return queue.join(left, "a").join(right, "b").select("pair_id", "a", "b", "record_a", "record_b")


def append_labels(labels: DataFrame, path: str) -> None:
    """Add to a JSON-lines history; raises on an unknown label."""
    if labels.where(~F.col("label").isin(*LABELS)).limit(1).count():
        raise ValueError(f"labels are {LABELS}")
    labels.select("pair_id", "label", "annotator", "at").write.mode("append").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def latest_labels(labels: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last label of each (pair, annotator); later in ``order`` wins."""
    order = order or ["at", "label"]
    last = Window.partitionBy("pair_id", "annotator").orderBy(*[F.desc(c) for c in order])
    return labels.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def pending(queue: DataFrame, labels: DataFrame, annotator: str) -> DataFrame:
    """Pairs the annotator has not labelled."""
    return queue.join(labels.where(F.col("annotator") == annotator), "pair_id", "left_anti")


def cohens_kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, observed, expected, kappa) on the pairs both label; 1 when chance alone explains all."""
    both = a.select("pair_id", F.col("label").alias("la")).join(b.select("pair_id", F.col("label").alias("lb")), "pair_id")
    cells = both.groupBy("la", "lb").count()
    total = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("count")).otherwise(0)).alias("same"))
    ma, mb = cells.groupBy("la").agg(F.sum("count").alias("x")), cells.groupBy("lb").agg(F.sum("count").alias("y"))
    chance = ma.join(mb, F.col("la") == F.col("lb")).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("chance"))
    row = total.crossJoin(chance)  # one-row aggregates
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return row.select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))
