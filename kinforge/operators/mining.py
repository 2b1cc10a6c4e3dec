"""Training pairs and hard negatives, with contamination checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.draws import order_key
from kinforge.operators import ann, sparse
from kinforge.operators.metrics import true_pairs


def entity_pairs(corpus: DataFrame, n_pairs: int, seed: int = 0) -> DataFrame:
    """The first ``n_pairs`` same-entity pairs in hashed order."""
    pairs = true_pairs(corpus.where("entity_id IS NOT NULL")).withColumn("__h", order_key("a", "b", salt=str(seed)))
    return pairs.orderBy("__h", "a", "b").limit(n_pairs).select("a", "b")


def bm25_hard_negatives(texts: DataFrame, k: int, **options: object) -> DataFrame:
    """(anchor_id, neg_id, rank): best other texts by BM25, zero scores kept."""
    top = sparse.neighbours(texts, k, drop_zero=False, **options)
    return top.select(F.col("q").alias("anchor_id"), F.col("d").alias("neg_id"), "rank")


def ann_hard_negatives(vectors: DataFrame, k: int, **options: object) -> DataFrame:
    """(anchor_id, neg_id, rank): nearest other vectors."""
    top = ann.neighbours(vectors, k, **options)
    return top.select(F.col("q").alias("anchor_id"), F.col("d").alias("neg_id"), "rank")


def same_entity(mined: DataFrame, truth: DataFrame) -> DataFrame:
    """``mined`` with boolean ``same``: both sides have one known entity."""
    a = truth.select(F.col("record_id").alias("anchor_id"), F.col("entity_id").alias("ea"))
    b = truth.select(F.col("record_id").alias("neg_id"), F.col("entity_id").alias("eb"))
    joined = mined.join(a, "anchor_id", "left").join(b, "neg_id", "left")
    return joined.select(*mined.columns, F.coalesce(F.col("ea") == F.col("eb"), F.lit(False)).alias("same"))


def fn_contamination(mined: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of negatives that are really matches; null without negatives."""
    return same_entity(mined, truth).agg(F.avg(F.col("same").cast("double")).alias("contamination"), F.count("*").alias("n"))


def cluster_aware_filter(mined: DataFrame, proxy: DataFrame) -> DataFrame:
    """Drop negatives of the anchor's own proxy cluster; unknown ones stay."""
    return same_entity(mined, proxy).where(~F.col("same")).drop("same")


def cap_per_entity(df: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` records of each entity, in hashed order."""
    rn = F.row_number().over(Window.partitionBy("entity_id").orderBy(order_key("record_id", salt=str(seed)), "record_id"))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= cap).drop("__rn")


def rerank(candidates: DataFrame, keep: int, score: str = "score", by: tuple[str, ...] = ("q",), tie: str = "d") -> DataFrame:
    """The ``keep`` best candidates of each query by another score, with their new rank.

    A missing score comes last; equal ones go by ``tie``.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), tie))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= keep)
