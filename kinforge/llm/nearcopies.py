"""Near copies: texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two searches and every link is then decided exactly.

* SimHash: fingerprints of the sets are probed by the generalised pigeonhole of
  ``simhash.links``. That finds close copies whatever their number, but a pair
  at 0.8 differs in about ten bits of 64, beyond any radius that can be probed.
* Prefixes: under one order of all shingles, rare ones first, two sets that
  similar share a shingle of their first fifth. Texts that share one are filed
  under their least member. Within such a set a pair stays a candidate unless
  parity sketches (two to four bits a shingle) prove it too far apart: differing
  bits never exceed differing shingles. This search misses no pair.

The candidates' components hold all links, and each text is in one of them. Its
shingles go there once, and only links of exact similarity join texts.

A set too large for one task is dealt into tiles. Every tile first meets a few
pivots of the whole set, which settles dense families; the members that are not
in the largest group after that meet all others, tile by tile. Nothing is
narrowed or dropped there.

Defined results: null, empty and white texts have the empty set and link with
each other; texts of fewer words than a shingle are one shingle; a repeated key
has each of its rows; rows with a null key are left out; an empty table gives no
rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm import simhash
from kinforge.llm.common import map_batches, slices
from kinforge.operators.graph import connected_components
from kinforge.session import discard, materialize

#: Differing bits of fingerprints that are probed for.
RADIUS = 3
#: Members and 64-bit words of one set that a task compares, and pivots of a larger one.
SET_MEMBERS, SET_WORDS, PIVOTS = 32_768, 2_000_000, 64
#: Rows that tell common shingles from rare ones, and how many of them are kept.
ORDER_DOCS, ORDER_SHINGLES = 20_000, 400_000

#: Sets with a candidate, of 32 bytes and a key each, that are broadcast to the texts; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

Edges = tuple[np.ndarray, np.ndarray]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the ``width``-word shingles, ascending."""
    return np.unique(np.array(simhash.shingle_hashes(text, width), np.uint64).view(np.int64))


def signature(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set of shingles."""
    return simhash.signed(xxhash.xxh3_64_intdigest(shingles.tobytes()))


def parity_sketch(shingles: np.ndarray) -> bytes:
    """One bit a slot, the parity of the shingles in it; slots are a power of two, 2 to 4 a shingle."""
    slots = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount(shingles.view(np.uint64) & np.uint64(slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_apart(a: np.ndarray, b: np.ndarray | int, similarity: float) -> np.ndarray:
    """Shingles in one set only that sets of those sizes may have at that similarity."""
    return (a + b) * ((1 - similarity) / (1 + similarity)) + 1e-9


def common_shingles(df: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``ORDER_DOCS`` hashed rows hold, ascending, with their counts.

    They come last in the order of the prefixes. Any order finds the same links, so
    the sample decides on the work only.
    """
    n = df.count()
    rows = df.select(text)
    if n > ORDER_DOCS:
        rows = rows.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(ORDER_DOCS / n * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [np.empty(0, np.int64)]
        for batch in slices(batches, text):
            sets += [shingle_set(x or b"", width) for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
        found, counts = np.unique(np.concatenate(sets), return_counts=True)
        top = np.lexsort((found, -counts))[:ORDER_SHINGLES]
        top = np.sort(top[counts[top] > 1])
        yield pa.RecordBatch.from_arrays([pa.array(found[top]), pa.array(counts[top])], names=["s", "c"])

    kept = map_batches(rows.repartition(1), run, "s long, c long").toArrow()  # a bounded sample
    return kept["s"].to_numpy(), kept["c"].to_numpy()


def prefix_size(n: int, similarity: float) -> int:
    """Shingles of which two sets of that similarity share one, whatever the common order."""
    return n - int(np.ceil(n * similarity - 1e-9)) + 1 if n else 0


def mark(df: DataFrame, key: str, text: str, width: int, similarity: float) -> DataFrame:
    """(key, sig, fp, n, sketch, prefix) for each row."""
    common, counts = common_shingles(df, text, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sigs, fps, sizes, sketches, prefixes = [], [], [], [], []
            for raw in batch.column(text).cast(pa.large_binary()).to_pylist():
                found = shingle_set(raw or b"", width)
                sigs.append(signature(found))
                fps.append(simhash.signed(simhash.fingerprint(found.view(np.uint64))))
                sizes.append(len(found))
                sketches.append(parity_sketch(found))
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    found = found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]
                prefixes.append(found[: prefix_size(len(found), similarity)])
            at = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            columns = [pa.array(sigs, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "sig", "fp", "n", "sketch", "prefix"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, run, f"`{key}` {kind}, sig long, fp long, n long, sketch binary, prefix array<bigint>")


def grow_forest(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Edges:
    """Positions of a spanning forest's edges; ``near(one, left)`` marks the members of left that link to one."""
    left = np.arange(count)
    a, b = [left[:0]], [left[:0]]
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            one = front.pop()
            linked = near(one, left)
            if linked.any():
                found = left[linked]
                left = left[~linked]
                front.extend(found.tolist())
                a.append(np.full(len(found), one))
                b.append(found)
    return np.concatenate(a), np.concatenate(b)


def possible_edges(sizes: np.ndarray, sketches: list[bytes], similarity: float) -> Edges:
    """Forest of the pairs that their parity sketches don't rule out."""
    words = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
    rows = np.zeros(len(sketches), np.int64)
    full, half = {}, {}
    for w in np.unique(words).tolist():
        mine = np.flatnonzero(words == w)
        rows[mine] = np.arange(len(mine))
        full[w] = np.frombuffer(b"".join(sketches[i] for i in mine), np.uint64).reshape(-1, w)
        half[w] = full[w][:, : w // 2] ^ full[w][:, w // 2 :]  # the sketch of half as many slots

    def near(one: int, left: np.ndarray) -> np.ndarray:
        w, out = int(words[one]), np.zeros(len(left), bool)
        most = most_apart(sizes[left], sizes[one], similarity)
        fits = np.abs(sizes[left] - sizes[one]) <= most
        for other, table, mine in ((w // 2, full, half), (w, full, full), (2 * w, half, full)):
            at = np.flatnonzero(fits & (words[left] == other)) if other in full else ()
            if len(at):
                apart = np.bitwise_count(table[other][rows[left[at]]] ^ mine[w][rows[one]]).sum(axis=1)
                out[at] = apart <= most[at]
        return out

    return grow_forest(len(sizes), near)


def similar_edges(flat: np.ndarray, at: np.ndarray, similarity: float) -> Edges:
    """Forest of the pairs of exact Jaccard similarity; ``flat`` cut by ``at`` holds the distinct shingles."""
    numbers, codes = np.unique(flat, return_inverse=True)
    sizes = np.diff(at)
    mark = np.zeros(len(numbers) + 1, bool)

    def near(one: int, left: np.ndarray) -> np.ndarray:
        out = np.abs(sizes[left] - sizes[one]) <= most_apart(sizes[left], sizes[one], similarity)
        some = left[out]
        if len(some):
            n = sizes[some]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            pool = codes[np.repeat(at[some] - starts, n) + np.arange(n.sum())]
            mine = codes[at[one] : at[one + 1]]
            mark[mine] = True
            total = np.concatenate([[0], np.cumsum(mark[pool])])
            both = total[starts + n] - total[starts]
            mark[mine] = False
            out[out] = both >= similarity * (n + sizes[one] - both) - 1e-9
        return out

    return grow_forest(len(sizes), near)


def edges_of_sets(dealt: DataFrame, names: tuple[str, ...], forest: Callable[[pa.RecordBatch | pa.Table], Edges]) -> DataFrame:
    """(a, b) of the forests of all sets; a set's rows share ``names`` and meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a set that may go on in the next batch

        def edges() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["sig"].to_numpy()
            a, b = forest(rows)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        def name(batch: pa.RecordBatch, i: int) -> tuple:
            return tuple(batch.column(c)[i].as_py() for c in names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows - 1, bool)
            for c in names:
                new |= pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False)
            for s, e in itertools.pairwise([0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]):
                if held and name(held[-1], 0) != name(batch, s):
                    yield edges()
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield edges()

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def _tile(salt: int, tiles: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "sig"), F.coalesce(F.col(tiles), F.lit(1)))


def forests(members: DataFrame, forest: Callable[[pa.Table], Edges], tag: str) -> DataFrame:
    """Edges (a, b) that connect what ``forest`` would connect within each set.

    ``members`` is a stored table with (root, sig, words, payload...); root names
    the set and words is the size of the payload.
    """
    weights = members.groupBy("root").agg(F.count("*").alias("c"), F.sum("words").alias("w"))
    tiles = F.greatest(F.ceil(F.col("c") / SET_MEMBERS), F.ceil(F.col("w") / SET_WORDS))
    hot = materialize(weights.where((F.col("c") > SET_MEMBERS) | (F.col("w") > SET_WORDS)).select("root", "c", tiles.alias("tiles")), f"{tag}-hot")
    if hot.isEmpty():
        return materialize(edges_of_sets(members, ("root",), forest), tag)
    spread = members.join(hot, "root", "left").withColumn("tile", _tile(1, "tiles"))
    pivot = F.pmod(F.xxhash64(F.lit(2), "sig"), F.lit(1 << 30)) < F.lit(PIVOTS << 30) / F.col("c")
    guests = spread.where(pivot).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    guests = guests.where("at <> tile").withColumn("tile", F.col("at")).drop("at")
    first = materialize(edges_of_sets(spread.unionByName(guests).drop("c", "tiles"), ("root", "tile"), forest), tag)
    # Members of a large set that are not in its largest group yet meet all others.
    groups = connected_components(first)
    crowd = members.select("root", "sig").join(hot.select("root", "tiles"), "root")
    crowd = crowd.join(groups, F.col("sig") == F.col("node"), "left").select("root", "tiles", "sig", F.coalesce("component", "sig").alias("label"))
    crowd = materialize(crowd, f"{tag}-crowd")
    shares = crowd.groupBy("root", "label").agg(F.count("*").alias("n"))
    main = shares.groupBy("root").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    main = main.select("root", F.col("top.label").alias("main"), (F.col("n") - F.col("top.n")).alias("strays"))
    plan = materialize(main.join(hot, "root").where("strays > 0").select("root", "tiles", "main", F.ceil(F.col("strays") * F.col("tiles") / F.col("c")).alias("deals")), f"{tag}-plan")
    if plan.isEmpty():
        return first
    every = members.join(plan, "root").withColumn("tile", _tile(1, "tiles"))
    stray = crowd.join(plan, "root").where("label <> main").select("root", "sig")
    strays = every.join(stray, ["root", "sig"], "left_semi").withColumn("deal", _tile(3, "deals"))
    wide = every.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    long = strays.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    both = wide.unionByName(long).dropDuplicates(["root", "tile", "deal", "sig"]).drop("tiles", "deals", "main")
    second = materialize(edges_of_sets(both, ("root", "tile", "deal"), forest), tag)
    return first.unionByName(second)


def prefix_edges(marked: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) whose components hold all pairs of sets at that similarity."""
    tokens = marked.select("sig", F.explode("prefix").alias("token"))
    roots = tokens.groupBy("token").agg(F.min("sig").alias("root"), F.max("sig").alias("last")).where("root <> last").select("token", "root")
    roots = materialize(roots, "roots")
    stars = materialize(tokens.join(roots, "token").select("root", "sig").distinct(), "stars")
    wanted = materialize(stars.select("sig").distinct(), "starred")
    once = marked.select("sig", "n", "sketch").join(wanted, "sig", "left_semi").dropDuplicates(["sig"])
    members = materialize(stars.join(once, "sig").withColumn("words", F.octet_length("sketch") / 8), "members")

    def forest(rows: pa.Table) -> Edges:
        return possible_edges(rows["n"].to_numpy(), rows["sketch"].to_pylist(), similarity)

    found = forests(members, forest, "possible")
    discard(roots, stars, wanted, members)
    return found


def fingerprint_edges(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between sets whose fingerprints link."""
    classes = materialize(marked.groupBy("fp").agg(F.min("sig").alias("head"), F.max("sig").alias("last")), "classes")
    equal = marked.select("fp", "sig").join(classes.where("head <> last"), "fp").where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b")).distinct()
    linked = simhash.links(classes.select("fp"), radius)
    heads = classes.select("fp", "head")
    linked = linked.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return materialize(equal.unionByName(linked), "close")


def near_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id): component_id is the least key reachable by links."""
    kind = df.schema[key].dataType.simpleString()
    df = df.select(key, text).where(F.col(key).isNotNull())
    marked = materialize(mark(df, key, text, width, similarity), "marked")
    candidates = connected_components(fingerprint_edges(marked).unionByName(prefix_edges(marked, similarity)))
    # One row carries each set that has a candidate.
    carriers = marked.select(key, "sig", "n").join(candidates, F.col("sig") == F.col("node"))
    carriers = carriers.groupBy("sig", F.col("component").alias("root"), F.col("n").alias("words")).agg(F.min(key).alias("__key"))
    carriers = materialize(carriers, "carriers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [shingle_set(x or b"", width) for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "sig", "words")), lists], names=["root", "sig", "words", "shingles"])
            yield out.filter(pc.equal(batch.column("sig"), pa.array([signature(x) for x in sets], pa.int64())))  # a key may be repeated

    few = F.broadcast(carriers) if carriers.count() <= BROADCAST_ROWS else carriers
    texts = df.join(few, F.col(key) == F.col("__key")).select("root", "sig", "words", text)
    members = map_batches(texts, run, "root long, sig long, words long, shingles array<bigint>").dropDuplicates(["sig"])
    members = materialize(members, "sets")

    def forest(rows: pa.Table) -> Edges:
        lists = rows["shingles"].chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        return similar_edges(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), similarity)

    groups = connected_components(forests(members, forest, "similar"))
    labelled = marked.select(key, "sig").join(groups, F.col("sig") == F.col("node"), "left").select(key, F.coalesce("component", "sig").alias("component"))
    labelled = materialize(labelled, "labelled")
    discard(marked, carriers, members)
    least = materialize(labelled.groupBy("component").agg(F.min(key).alias("component_id")), "least")  # so that a hot component can be split
    return labelled.join(least, "component").select(F.col(key).cast(kind), "component_id")
