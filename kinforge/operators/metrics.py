"""Partition and blocking metrics as aggregates over the sparse contingency table.

Predictions are (record_id, cluster), truth is (record_id, entity_id). Results
are one-row tables; a ratio without a defined value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aligned(pred: DataFrame, truth: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(record_id, p, t, w); raises unless both sides label the same records once."""
    p = pred.select("record_id", F.col("cluster").alias("p"), F.lit(1).alias("in_p"))
    t = truth.select("record_id", F.col("entity_id").alias("t"), F.lit(1).alias("in_t"))
    both = p.join(t, "record_id", "full")
    bad = both.agg(
        F.count_if(F.col("in_p").isNull() | F.col("in_t").isNull()).alias("unmatched"),
        F.count_if(F.col("p").isNull() | F.col("t").isNull()).alias("null"),
        (F.count("*") - F.count_distinct("record_id")).alias("repeated"),
    ).first()
    for what, n in bad.asDict().items():
        if n:
            raise ValueError(f"{n} {what} records between prediction and truth")
    if weights is None:
        return both.select("record_id", "p", "t", F.lit(1).cast("long").alias("w"))
    joined = both.join(weights, "record_id", "left").select("record_id", "p", "t", F.col("w").cast("double").alias("w"))
    if joined.where("w IS NULL OR w < 0 OR w <> floor(w)").limit(1).count():
        raise ValueError("weights must be whole and not negative for every record")
    return joined.where("w > 0").select("record_id", "p", "t", F.col("w").cast("long").alias("w"))


def contingency(rows: DataFrame) -> DataFrame:
    """Occupied cells (p, t, n) with their margins np and nt."""
    cells = rows.groupBy("p", "t").agg(F.sum("w").alias("n"))
    by_p = cells.groupBy("p").agg(F.sum("n").alias("np"))
    by_t = cells.groupBy("t").agg(F.sum("n").alias("nt"))
    return cells.join(by_p, "p").join(by_t, "t")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def harmonic(p: Column, r: Column) -> Column:
    """F1; null if a side is null, 0 if both are 0."""
    return F.when(p + r == 0, 0.0).otherwise(2.0 * p * r / (p + r))


def bcubed(cells: DataFrame) -> DataFrame:
    """B-cubed precision, recall and F1."""
    n = F.col("n").cast("double")
    sums = cells.agg(F.sum(n * n / F.col("np")).alias("p"), F.sum(n * n / F.col("nt")).alias("r"), F.sum("n").alias("total"))
    sums = sums.select((F.col("p") / F.col("total")).alias("precision"), (F.col("r") / F.col("total")).alias("recall"))
    return sums.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def _choose2(x: Column) -> Column:
    return (x * (x - 1) / 2).cast("long")


def pairwise(cells: DataFrame) -> DataFrame:
    """Pair counts and ratios; with no predicted pair precision is null, never 1."""
    tp = cells.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).alias("tp"))
    pred = cells.groupBy("p").agg(F.sum("n").alias("x")).agg(F.coalesce(F.sum(_choose2(F.col("x"))), F.lit(0)).alias("pp"))
    true = cells.groupBy("t").agg(F.sum("n").alias("x")).agg(F.coalesce(F.sum(_choose2(F.col("x"))), F.lit(0)).alias("tt"))
    row = tp.crossJoin(pred).crossJoin(true)  # three one-row aggregates
    row = row.select("tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("tt") - F.col("tp")).alias("fn"))
    row = row.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return row.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def variation_of_information(cells: DataFrame) -> DataFrame:
    """Variation of information in bits, never below 0."""
    part = cells.groupBy("n", "np", "nt").agg(F.count("*").alias("k"))  # few rows: equal cells together
    share = F.col("n") / F.col("total")
    bits = F.log2(F.col("np") / F.col("total")) + F.log2(F.col("nt") / F.col("total")) - 2 * F.log2(share)
    total = part.agg(F.sum(F.col("n") * F.col("k")).alias("total"))
    part = part.crossJoin(F.broadcast(total))  # one-row side
    return part.agg(F.greatest(F.sum(F.col("k") * share * bits), F.lit(0.0)).alias("vi"))


def merge_distance(cells: DataFrame, split_cost: float = 1.0, merge_cost: float = 1.0) -> DataFrame:
    """Cost of splitting predicted clusters into cells and merging cells into entities."""
    row = cells.agg(F.count("*").alias("cells"), F.count_distinct("p").alias("ps"), F.count_distinct("t").alias("ts"))
    return row.select((split_cost * (F.col("cells") - F.col("ps")) + merge_cost * (F.col("cells") - F.col("ts"))).cast("double").alias("distance"))


def cluster_f(cells: DataFrame) -> DataFrame:
    """Best F1 of each entity over clusters: size-weighted and plain mean."""
    best = cells.groupBy("t", "nt").agg(F.max(2.0 * F.col("n") / (F.col("nt") + F.col("np"))).alias("f"))
    return best.agg((F.sum(F.col("f") * F.col("nt")) / F.sum("nt")).alias("weighted"), F.avg("f").alias("macro"))


def true_pairs(truth: DataFrame) -> DataFrame:
    """(a, b, entity_id): all pairs of records of one entity."""
    left = truth.select(F.col("record_id").alias("a"), "entity_id")
    right = truth.select(F.col("record_id").alias("b"), "entity_id")
    return left.join(right, "entity_id").where("a < b").select("a", "b", "entity_id")


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct a < b without loops; null ends raise."""
    if pairs.where("a IS NULL OR b IS NULL").limit(1).count():
        raise ValueError("pairs with a null end")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def blocking_metrics(pairs: DataFrame, truth: DataFrame, n_records: int | None = None) -> DataFrame:
    """Candidate and true pair counts, pair completeness, reduction ratio."""
    pairs = canonical_pairs(pairs)
    n = n_records if n_records is not None else truth.count()
    truths = true_pairs(truth).withColumn("true", F.lit(1))
    row = pairs.withColumn("cand", F.lit(1)).join(truths, ["a", "b"], "full").agg(
        F.count("cand").alias("n_candidates"), F.count("true").alias("n_true"), F.count_if(F.col("cand").isNotNull() & F.col("true").isNotNull()).alias("n_found")
    )
    total = F.lit(n * (n - 1) // 2)
    return row.select(
        "n_candidates",
        "n_true",
        "n_found",
        ratio(F.col("n_found"), F.col("n_true")).alias("pair_completeness"),
        F.when(total > 0, 1.0 - F.col("n_candidates") / total).alias("reduction_ratio"),
    )


def budget_metrics(ranked: DataFrame, truth: DataFrame, budgets: list[int]) -> DataFrame:
    """``blocking_metrics`` of the pairs (q, d) up to each rank of ``budgets``, with that rank as ``k``: pairs and true pairs meet once for all."""
    pairs = ranked.where((F.col("q") != F.col("d")) & (F.col("rank") <= max(budgets)))
    pairs = pairs.select(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b"), "rank", F.lit(0).alias("true"))
    truths = true_pairs(truth).select("a", "b", F.lit(None).cast(ranked.schema["rank"].dataType).alias("rank"), F.lit(1).alias("true"))
    met = pairs.unionByName(truths).groupBy("a", "b").agg(F.min("rank").alias("rank"), F.max("true").alias("true"))
    found = F.col("true") == 1
    counts = met.agg(F.sum("true").alias("n_true"), *[f(F.col("rank") <= k).alias(f"{c}{k}") for k in budgets for c, f in (("c", F.count_if), ("f", lambda x: F.count_if(x & found)))])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("n_candidates"), F.col(f"f{k}").alias("n_found")) for k in budgets])
    rows = counts.select(F.coalesce("n_true", F.lit(0).cast("long")).alias("n_true"), F.explode(rows).alias("e")).select("e.n_candidates", "n_true", "e.n_found", "e.k")
    n = truth.count()
    total = F.lit(n * (n - 1) // 2)
    reduction = F.when(total > 0, 1.0 - F.col("n_candidates") / total)
    return rows.select("n_candidates", "n_true", "n_found", ratio(F.col("n_found"), F.col("n_true")).alias("pair_completeness"), reduction.alias("reduction_ratio"), "k")


def pair_completeness_bounds(pairs: DataFrame, truth: DataFrame, coverage: float) -> DataFrame:
    """Completeness if unlabelled true pairs are all missed, or all found.

    ``coverage`` is the share of all true pairs that the labels hold.
    """
    if not 0 < coverage <= 1:
        raise ValueError("coverage must be in (0, 1]")
    row = blocking_metrics(pairs, truth)
    pc = F.col("pair_completeness")
    return row.select((pc * coverage).alias("pessimistic"), pc.alias("observed"), (pc * coverage + (1 - coverage)).alias("optimistic"))
