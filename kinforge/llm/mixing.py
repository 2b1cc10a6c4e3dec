"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are put in a random (hashed) order and cut into blocks. Block
i of a source with weight w may run from slot floor((i-1)/w) on and must run
before slot ceil(i/w); earliest deadline first then gives an order in which every
source, while it lasts, is less than one block away from its share at every
slot. Weights are held as parts of a whole number of slots (the period), so the
schedule repeats: one period is laid out on the driver (its length depends on
the number of sources only) and every row finds its slot by arithmetic.

No row is dropped or repeated: when a source ends, its later slots stay empty
and the others go on in order. Defined results: null sources form a source of
their own; rows with a null key are spread by all their other columns; equal rows
are interchangeable; an empty table gives no rows; columns of the input called
mix_block, mix_slot or mix_pos are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
PERIOD = 4096
BUCKET_ROWS = 1000
BROADCAST_SOURCES = 100_000


def shares(weights: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole parts of the period for each source, by largest remainder, at least 1."""
    if not weights:
        return {}
    order = sorted(weights, key=lambda s: (s is not None, s or ""))
    period = max(period, 8 * len(order))
    total = sum(weights.values())
    exact = {s: weights[s] / total * period for s in order}
    out = {s: max(1, int(exact[s])) for s in order}
    spare = period - sum(out.values())
    ranked = sorted(order, key=lambda s: -(exact[s] - int(exact[s])))
    for s in ranked[: max(0, spare)]:
        out[s] += 1
    while spare < 0:  # sources raised to one part take from the largest
        out[max(order, key=lambda s: out[s])] -= 1
        spare += 1
    return out


def edf_period(parts: list[int]) -> list[list[int]]:
    """Slots of each source's blocks within one period, earliest deadline first.

    ``parts`` sum to the period Q. Block i (from 1) of a source with p parts is
    released at floor((i-1)Q/p) and due by ceil(iQ/p). One block runs in a slot;
    since the parts fill the period exactly, no deadline is missed.
    """
    q = sum(parts)
    slots: list[list[int]] = [[] for _ in parts]
    waiting = [(0, s) for s, p in enumerate(parts) if p]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            i = len(slots[s]) + 1
            heapq.heappush(ready, (-(-i * q // parts[s]), s))
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("deadline missed")
        slots[s].append(t)
        if (done := len(slots[s])) < parts[s]:
            heapq.heappush(waiting, (done * q // parts[s], s))
    return slots


def mix_sources(
    df: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    weights: dict[str | None, float] | None = None,
    power: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = 17,
) -> DataFrame:
    """Add mix_block, mix_slot and mix_pos; ordering by mix_pos gives the mix.

    Without ``weights`` a source's weight is its row count to the given power.
    Ranks within a source come from hashed buckets of about ``bucket_rows``
    rows, so a source with a third of all rows is dealt over many tasks.
    """
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(source).count().collect()}
    used = {s: (weights.get(s, 0.0) if weights else n**power) for s, n in counts.items()}
    floor = min((w for w in used.values() if w > 0), default=1.0) / max(1, len(used))
    parts = shares({s: w if w > 0 else floor for s, w in used.items()}, period)
    order = list(parts)
    slots = edf_period([parts[s] for s in order]) if order else []
    q = sum(parts.values())

    side = spark.createDataFrame(
        [(s, i, parts[s], max(1, -(-counts[s] // bucket_rows))) for i, s in enumerate(order)],
        "__source string, __sid int, __parts long, __buckets long",
    )
    plan = spark.createDataFrame([(i, k, t) for i, ts in enumerate(slots) for k, t in enumerate(ts)], "__sid int, __k long, __t long")
    if len(order) <= BROADCAST_SOURCES:  # both tables are bounded by the number of sources
        side, plan = F.broadcast(side), F.broadcast(plan)

    keep = [c for c in df.columns if c not in ("mix_block", "mix_slot", "mix_pos")]
    rest = [F.col(c) for c, kind in df.dtypes if c in keep and c not in (key, source) and "map<" not in kind]
    spread = F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed), *rest)).otherwise(F.xxhash64(F.lit(seed), F.col(key)))
    unit = F.shiftrightunsigned(spread, 33)  # 31 bits
    rows = (
        df.select(*keep)
        .join(side, F.col(source).cast("string").eqNullSafe(F.col("__source")))
        .withColumn("__h", spread)
        .withColumn("__u", unit)
        .withColumn("__bucket", F.shiftright(F.col("__u") * F.col("__buckets"), 31))
    )
    # The counting pass reads the key and source columns only.
    sizes = rows.groupBy("__sid", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__sid").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__sid", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__sid", "__bucket").orderBy("__u", key, "__h")
    rank = F.col("__before") + F.col("__rn") - 1
    out = (
        rows.withColumn("__rn", F.row_number().over(within))
        .join(sizes.hint("merge"), ["__sid", "__bucket"])
        .withColumn("__rank", rank)
        .withColumn("mix_block", F.expr(f"__rank div {block_rows}"))
        .withColumn("__k", F.col("mix_block") % F.col("__parts"))
        .join(plan, ["__sid", "__k"])
        .withColumn("mix_slot", F.expr(f"(mix_block div __parts) * {q}L + __t"))
        .withColumn("mix_pos", F.expr(f"mix_slot * {block_rows}L + __rank % {block_rows}"))
    )
    return out.select(*keep, "mix_block", "mix_slot", "mix_pos")
