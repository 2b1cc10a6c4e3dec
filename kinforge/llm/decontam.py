"""Benchmark decontamination by template canonicalisation.

Numbers (with separators), names and units become typed placeholders, and runs of
``WIDTH`` words are joined by hash with those of the benchmark. A word with a
capital inside a sentence is a name; one that opens a sentence may be, so windows
with such a word exist in both readings. A document that holds at least ``SHARE``
of an item's windows is contaminated: by an exact copy when the plain words'
windows say so, and by a re-parameterised one when the templates' do and the
slots are consistent, that is each value of the item maps to one value of the
document and back. A text of fewer than ``WIDTH`` words is one window, so a short
item is found where it is a document of its own.

The benchmark's windows are a table, joined with the documents' by Spark, and may
have any size. A bit map of fixed size lets the one pass over the documents skip
windows that no item has; what passes it is joined in full.

Defined results: null and empty texts hold nothing and null and empty items are
nowhere; windows with fewer than ``LITERALS`` words outside placeholders are no
template; items with equal id and text count once; item ids may be null or of any
type; repeated rows are reported one by one; a null key is reported as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm import tokens
from kinforge.llm.common import byte_blocks, map_batches, utf8_column
from kinforge.session import materialize

WIDTH, SHARE, LITERALS, CLASHES = 5, 0.8, 2, 0.1
#: Bits of the map of the benchmark's window hashes, as a power of two.
MAP_BITS = 24
#: Contaminated documents, of 16 bytes and a key each, that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
UNITS = (
    "mm cm m km g kg mg t l ml s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "inch inches ft foot feet yard yards mile miles lb lbs pound pounds oz ounce ounces euro euros dollar dollars cent cents usd eur gbp "
    "percent degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules hz mph kmh"
).split()
NUM, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
EXACT, LITERAL, OPENED = 0, 1, 2
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord("."), ord(",")]] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(tokens.words(data, np.array([0, len(data)])).hash)


_UNIT_HASHES = _unit_hashes()


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Windows:
    """Windows of the texts of a block: row, place (in words of the row) and, for each reading, hash and slots."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = tokens.words(data, offsets, split=True)
        value, row, n = w.hash, w.row, len(w.hash)
        number, name, opens = w.number, w.name, w.opens
        if n > 1:  # 3.5 and 1,200 are one number
            joins = np.zeros(n, bool)
            joins[1:] = number[1:] & number[:-1] & (w.start[1:] == w.end[:-1] + 1) & (row[1:] == row[:-1]) & _SEPARATOR[data[np.minimum(w.end[:-1], len(data) - 1)]]
            if joins.any():
                head = np.flatnonzero(~joins)
                part = np.arange(n) - head[np.cumsum(~joins) - 1]
                value = np.add.reduceat(tokens.mix(value + part.astype(np.uint64)) * joins + value * ~joins, head)
                row, number, name, opens = row[head], number[head], name[head], opens[head]
                n = len(head)
        unit = _member(value, _UNIT_HASHES) & ~number
        slots = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8)
        maybe = opens & (slots == 0)
        shape = value.copy()
        for t, held in ((1, NUM), (2, NAME), (3, UNIT)):
            shape[slots == t] = held
        self.value, self.slots, self.maybe = value, slots, maybe
        # a row of fewer words is one window; missing words are zeros at the end
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.empty(0, np.int64)
        size = np.diff(np.append(first, n))
        begin = np.repeat(first, size)
        place = np.arange(n) - begin
        at = np.flatnonzero((place + WIDTH <= np.repeat(size, size)) | (place == 0))
        self.at, self.row, self.place = at, row[at] if n else at, place[at]
        cells = at[:, None] + np.arange(WIDTH)
        self.inside = cells < (begin + np.repeat(size, size))[at][:, None]
        self.cells = np.minimum(cells, max(n - 1, 0))
        self.opened = (maybe[self.cells] & self.inside).any(axis=1) if n else np.empty(0, bool)
        every, some = np.arange(len(at)), np.flatnonzero(self.opened)
        self.hashes = [self._hash(value, every), self._hash(shape, every)]
        self.hashes.append(self.hashes[LITERAL].copy())
        self.hashes[OPENED][some] = self._hash(np.where(maybe, NAME, shape), some)

    def _hash(self, words: np.ndarray, which: np.ndarray) -> np.ndarray:
        total = np.zeros(len(which), np.uint64)
        for k in range(WIDTH if len(which) else 0):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[self.cells[which, k]] * self.inside[which, k]
        return tokens.mix(total)

    def slot_values(self, side: int, which: np.ndarray) -> np.ndarray:
        """(windows, WIDTH) value of each slot of those windows, 0 for a literal."""
        cells = self.cells[which]
        slot = self.slots[cells] > 0
        if side == OPENED:
            slot |= self.maybe[cells]
        return np.where(slot & self.inside[which], self.value[cells] | np.uint64(1), np.uint64(0)).view(np.int64)

    def literals(self, side: int) -> np.ndarray:
        slot = self.slots[self.cells] > 0
        if side == OPENED:
            slot |= self.maybe[self.cells]
        return (self.inside & ~slot).sum(axis=1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * WIDTH, pa.int32()), pa.array(values.reshape(-1), pa.int64()))


def benchmark_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(side, hash, item, ih, ipos, counts, theirs, total, shapes): windows of the benchmark, one for each place and reading.

    ``counts`` marks the places that stand for a template of their own; total and
    shapes are the item's numbers of different windows and of such places.
    """
    rows = benchmark.select(F.col(item).alias("item"), F.xxhash64(text).alias("ih"), F.col(text).alias("__text")).where(F.col("__text").isNotNull()).dropDuplicates(["item", "ih"])
    kind = rows.schema["item"].dataType.simpleString()
    names = ["side", "hash", "item", "ih", "ipos", "counts", "theirs", "total", "shapes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, at = utf8_column(batch.column("__text").slice(i, 1))
                w = Windows(data[at[0] : at[1]], at - at[0])
                _, once = np.unique(w.hashes[EXACT], return_index=True)
                enough = np.maximum(w.literals(LITERAL), 0) >= LITERALS
                _, shape = np.unique(w.hashes[LITERAL], return_index=True)
                counts = np.zeros(len(w.at), bool)
                counts[shape] = True
                counts &= enough
                counts[np.setdiff1d(np.arange(len(w.at)), once)] = False
                shapes = int(counts.sum())
                for side in (EXACT, LITERAL, OPENED):
                    keep = once if side == EXACT else np.flatnonzero(counts & ((side == LITERAL) | w.opened & (w.literals(OPENED) >= LITERALS)))
                    n = len(keep)
                    if n:
                        columns = [pa.array([side] * n, pa.int32()), pa.array(w.hashes[side][keep].view(np.int64))]
                        columns += [batch.column(c).take(pa.array([i] * n)) for c in ("item", "ih")]
                        columns += [pa.array(w.place[keep], pa.int64()), pa.array(counts[keep]), _lists(w.slot_values(side, keep))]
                        columns += [pa.array([x] * n, pa.int64()) for x in (len(once), shapes)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = f"side int, hash long, item {kind}, ih long, ipos long, counts boolean, theirs array<bigint>, total long, shapes long"
    return materialize(rows.mapInArrow(run, ddl), "windows")


def window_map(windows: DataFrame) -> np.ndarray:
    """Bit map of the window hashes, of ``2 ** MAP_BITS`` bits whatever the benchmark's size."""
    slot = f"shiftrightunsigned(hash, {64 - MAP_BITS})"
    words = windows.select(F.expr(f"shiftright({slot}, 6) AS word"), F.expr(f"shiftleft(1L, CAST({slot} % 64 AS INT)) AS bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # 2 ** (MAP_BITS - 6) at most
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for word, bits in rows:
        out[word] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def document_windows(docs: DataFrame, key: str, text: str, windows: DataFrame) -> DataFrame:
    """(__key, th, place, side, hash, mine) for the windows that the benchmark may have."""
    wanted = np.packbits(window_map(windows))
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("th"), F.col(text).alias("__text"))
    names = ["__key", "th", "place", "side", "hash", "mine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(wanted).astype(bool)
        for batch in batches:
            for i, _, data, at in byte_blocks(batch.column("__text")):
                w = Windows(data, at)
                for side in (EXACT, LITERAL, OPENED):
                    hit = known[w.hashes[side] >> np.uint64(64 - MAP_BITS)]
                    if side == OPENED:
                        hit &= w.opened
                    hit = np.flatnonzero(hit)
                    if len(hit):
                        rows = pa.array(i + w.row[hit])
                        mine = w.slot_values(side, hit)
                        columns = [batch.column("__key").take(rows), batch.column("th").take(rows), pa.array(w.place[hit], pa.int64())]
                        columns += [pa.array(np.full(len(hit), side, np.int32)), pa.array(w.hashes[side][hit].view(np.int64)), _lists(mine)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["__key"].dataType.simpleString()
    return map_batches(rows, run, f"__key {kind}, th long, place long, side int, hash long, mine array<bigint>")


def _distinct(column: Column) -> Column:
    return F.size(F.array_distinct(column))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row (key, th, item_id, share, how) for each item that a document holds; th is xxhash64 of its text."""
    windows = benchmark_windows(benchmark, item, item_text)
    hits = document_windows(docs, key, text, windows).join(windows, ["side", "hash"])
    what = ["__key", "th", "item", "ih"]
    # Once for each place of the document and of the item; repeated rows are counted.
    met = hits.groupBy(*what, "ipos", "place").agg(
        F.max(F.when(F.col("side") == EXACT, 1).otherwise(0)).alias("same"), F.max("counts").alias("counts"), F.max("total").alias("total"), F.max("shapes").alias("shapes"),
        F.min(F.struct("side", "mine", "theirs")).alias("w"), F.expr(f"count_if(side = {EXACT})").alias("c0"), F.expr(f"count_if(side = {LITERAL})").alias("c1"), F.expr(f"count_if(side = {OPENED})").alias("c2"),
    )
    # A text's repeats of a window count once: the first stands for the slots.
    met = met.withColumn("rows", F.greatest("c0", "c1", "c2"))
    met = met.groupBy(*what, "ipos").agg(
        F.max("same").alias("same"), F.max("counts").alias("counts"), F.max("total").alias("total"), F.max("shapes").alias("shapes"),
        F.min(F.struct("place", "w")).alias("w"), F.min("rows").alias("rows"),
    )
    # An equal window's slots hold equal values.
    side, theirs = F.col("w.w.side"), F.col("w.w.theirs")
    mine = F.when(side == EXACT, theirs).otherwise(F.col("w.w.mine"))
    pairs = F.filter(F.arrays_zip(mine.alias("m"), theirs.alias("t")), lambda x: (x["m"] != 0) & (x["t"] != 0))
    met = met.groupBy(*what).agg(
        (F.sum("same") / F.max("total")).alias("exact"), F.try_divide(F.sum(F.col("counts").cast("int")), F.max("shapes")).alias("shape"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("counts"), pairs)))).alias("maps"), F.min("rows").alias("rows"),
    )
    clash = F.size("maps") - F.least(_distinct(F.transform("maps", lambda x: x["m"])), _distinct(F.transform("maps", lambda x: x["t"])))
    copied = F.col("exact") >= SHARE
    found = met.where(copied | (F.col("shape") >= SHARE) & (clash <= CLASHES * F.size("maps")))
    return found.select(
        F.col("__key").alias(key), "th", F.col("item").alias("item_id"), F.when(copied, F.col("exact")).otherwise(F.col("shape")).alias("share"),
        F.when(copied, F.lit("exact")).otherwise(F.lit("template")).alias("how"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("__n"),
    ).drop("__n")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    found = find_leaks(docs, benchmark, key, text, item, item_text).select(F.col(key).alias("__key"), F.col("th").alias("__th")).distinct()
    found = materialize(found, "leaks")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return docs.join(found, docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(docs[text]) == F.col("__th")), "left_anti")
