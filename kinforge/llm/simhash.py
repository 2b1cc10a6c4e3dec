"""SimHash near-duplicates linked through the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into m groups of correlated bits. If two differ
in at most r bits and the groups' thresholds t_i (each -1 or more) sum to
r - m + 1, then some group differs in at most t_i bits. Thresholds are unequal:
a dynamic programme takes those with the least estimated cost, from candidate
counts measured on all fingerprints. A group with threshold t is probed through
its values with every choice of t bits blanked; fingerprints that share a probe
value are verified exactly.

Only distinct fingerprints are linked, a probe value's group gives a spanning
tree instead of all pairs, and a group larger than ``GROUP_LIMIT`` is linked by
an exact route whose work is linear in it (all values with r bits blanked, whose
groups hold 2**r members at most).

Defined results: null and empty texts have fingerprint zero and link like any
other; a null key keeps its fingerprint and its group's id; equal rows stay
separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import map_batches, slices
from kinforge.operators.graph import connected_components
from kinforge.session import materialize

BITS = 64
FULL = (1 << BITS) - 1
GROUP_LIMIT = 32_768
#: Relative cost of moving one probe value and of verifying one candidate pair.
PROBE_COST, PAIR_COST = 20.0, 1.0


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``width`` words of the A-Z lower-cased text."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hashed(line, seed)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return [hashed(line[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes[0])
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., fp long) for each row; fp is the unsigned value's bit pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw = batch.column(text).cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(shingle_hashes(x or b"", width)) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *keep)), pa.array(fps)], names=[key, *keep, "fp"])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return map_batches(df.select(key, *keep, text), run, head + ", fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 counts of bits set together, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 1 << 16):
                part = fps[i : i + (1 << 16)].astype(">i8").view(np.uint8).reshape(-1, 8)
                x = np.unpackbits(part, axis=1).astype(np.float32)
                total += x.T @ x
                n += len(x)
        cells = [n, *total.reshape(-1).astype(np.int64).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.int64())], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(1 + BITS * BITS)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[0]), cells[1:].reshape(BITS, BITS)


def correlated_groups(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into m even groups, each grown by the strongest mean correlation."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    strength = np.abs(cov / np.outer(sd, sd))
    free, out = list(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        mean = strength[np.ix_(free, free)].sum(axis=1)
        group = [free.pop(int(mean.argmax()))]
        while len(group) < size:
            near = strength[np.ix_(free, group)].mean(axis=1)
            group.append(free.pop(int(near.argmax())))
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """Bit 0 is the most significant one, as in the statistics."""
    return sum(1 << (BITS - 1 - b) for b in bits)


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a group, that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, extra in cost.items():
                if s + t not in step or c + extra < step[s + t][0]:
                    step[s + t] = (c + extra, [*ts, t])
        best = step
    return best.get(total, (math.inf, []))


def probes(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Masks of the bits that a probe value keeps."""
    return [mask_of([b for b in group if b not in blank]) for group, t in zip(groups, thresholds, strict=True) if t >= 0 for blank in itertools.combinations(group, t)]


def plan_probes(distinct: DataFrame, radius: int) -> list[int]:
    """Probe masks with the least estimated cost for links of up to ``radius`` bits."""
    n, together = bit_statistics(distinct)
    layouts = {m: correlated_groups(n, together, m) for m in range(max(1, radius), radius + 2)} | {1: [list(range(BITS))]}
    parts = [(m, i, mask_of(group)) for m, groups in layouts.items() for i, group in enumerate(groups)]
    keyed = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(mask))) for _, _, mask in parts])).alias("part", "v"))
    sizes = keyed.groupBy("part", "v").agg(F.count("*").alias("c")).groupBy("part").agg(F.sum(F.expr("double(c) * (c - 1) / 2")).alias("pairs"))
    pairs = {r["part"]: r["pairs"] for r in sizes.collect()}
    one = np.diag(together) / max(n, 1)
    odds = 2 * one * (1 - one) / np.maximum(one**2 + (1 - one) ** 2, 1e-9)  # differing against agreeing
    best: tuple[float, list[int]] = (math.inf, [])
    for m, groups in layouts.items():
        costs = []
        for i, group in enumerate(groups):
            equal = pairs.get(next(k for k, x in enumerate(parts) if x[:2] == (m, i)), 0.0)
            spread, cost = [1.0], {-1: 0.0}
            for t in range(radius + 1):
                if t:  # elementary symmetric sums of the odds: pairs t bits apart
                    spread = [1.0] + [0.0] * t
                    for b in group:
                        for k in range(t, 0, -1):
                            spread[k] += spread[k - 1] * odds[b]
                # a pair d bits apart shares comb(w - d, t - d) of the probe values
                shared = sum(spread[d] * math.comb(len(group) - d, t - d) for d in range(t + 1))
                cost[t] = PAIR_COST * equal * shared + PROBE_COST * n * math.comb(len(group), t)
            costs.append(cost)
        found = allocate(costs, radius - m + 1)
        if found[0] < best[0]:
            best = (found[0], probes(groups, found[1]))
    return best[1]


def link_group(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within one probe group."""
    fps = np.unique(fps)
    bits = fps.view(np.uint64)  # bitwise_count takes a signed number's absolute value
    left = np.arange(len(fps))
    a, b = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(bits[left] ^ bits[front.pop()]) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                front.extend(found.tolist())
                a.append(np.full(len(found), fps[root]))
                b.append(fps[found])
    none = np.empty(0, fps.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(distinct: DataFrame, radius: int = 2, limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all links of up to ``radius`` bits."""
    masks = plan_probes(distinct, radius)
    fp = F.col("fp")
    keyed = distinct.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(signed(m))) for m in masks])).alias("probe", "v"))
    hot = keyed.groupBy("probe", "v").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("probe", "v")
    hot = materialize(hot, "hot")
    extra = None
    if not hot.isEmpty():
        crowd = keyed.join(hot, ["probe", "v"], "left_semi").select("fp").distinct()
        blanks = [signed(FULL ^ mask_of(list(c))) for c in itertools.combinations(range(BITS), radius)]
        near = crowd.select("fp", F.posexplode(F.transform(F.lit(blanks), lambda m: fp.bitwiseAND(m))).alias("probe", "v"))
        extra = (
            near.groupBy("probe", "v").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
        )
        keyed = keyed.join(hot, ["probe", "v"], "left_anti")
    grouped = keyed.groupBy("probe", "v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            a, b = [], []
            for i in range(len(column)):
                x, y = link_group(flat[at[i] : at[i + 1]], radius)
                if len(x):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    found = grouped.mapInArrow(run, "a long, b long")
    return found.unionByName(extra) if extra is not None else found


def components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component_id): component_id is the least key reachable by links."""
    fps = materialize(fingerprints(df, key, text, width), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    joined = connected_components(links(distinct, radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    members = materialize(distinct.join(joined, "fp"), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "root").select("fp", "component_id")
    classes = materialize(
        distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes"
    )
    return fps.join(classes, "fp").select(key, "fp", "component_id")
