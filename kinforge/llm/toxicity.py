"""Toxicity by a classifier chain over hashed words.

The chain's categories are predicted one after another; each linear model reads
the hashed words and word beginnings of the text and the probabilities of the
categories before it. For training, those earlier probabilities are out-of-fold
predictions, so a later model sees them as unsure as they will be. Features are
the buckets that tell the classes apart (by z score) on the training rows.

The fit takes a bounded sample of labelled documents, ``PER_CLASS`` of either
class of each category at most (about); scoring is a map over whole texts.

Defined results: null and empty texts have no words and get the models' base
probability; with fewer than ``FOLDS`` rows of a class a category's model is the
constant base rate; rows labelled more than once count once for each label;
equal texts get equal probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm import tokens
from kinforge.llm.common import byte_blocks, map_batches

BITS = 20
PREFIX = 4
PER_CLASS = 1200
FOLDS, FEATURES, Z = 3, 256, 4.0
RIDGE = 0.3

#: The chain of the ``labels`` table: the order is part of the model.
CHAIN: tuple[tuple[str, str], ...] = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) once for each different bucket of each text, sorted.

    The upper half of the buckets holds word beginnings.
    """
    w = tokens.words(data, offsets, PREFIX)
    shift = np.uint64(64 - BITS)
    long = w.end - w.start > PREFIX
    row = np.concatenate([w.row, w.row[long]])
    bucket = np.concatenate([w.hash >> shift, (w.prefix[long] >> shift) + np.uint64(1 << BITS)]).astype(np.int64)
    code = np.unique(row << (BITS + 1) | bucket)
    return code >> (BITS + 1), code & ((1 << (BITS + 1)) - 1)


@dataclass
class Linear:
    """A sparse logistic model over buckets and earlier categories."""

    chosen: np.ndarray  # sorted buckets
    weights: np.ndarray  # theirs
    earlier: np.ndarray  # of the earlier categories' log odds
    bias: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(row: np.ndarray, bucket: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Choose buckets by z score, then Newton steps with a ridge."""
    n1 = y.sum()
    n0 = n - n1
    none = np.empty(0)
    if n1 < FOLDS or n0 < FOLDS:
        return Linear(none.astype(np.int64), none, np.zeros(earlier.shape[1]), float(_odds((n1 + 1) / (n + 2))))
    size = 1 << (BITS + 1)
    c1 = np.bincount(bucket, y[row], minlength=size)
    c = np.bincount(bucket, minlength=size)
    seen = np.flatnonzero(c >= 3)
    p1, p0, p = c1[seen] / n1, (c[seen] - c1[seen]) / n0, c[seen] / n
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    pick = np.lexsort((seen, -z))[:FEATURES]
    chosen = np.sort(seen[pick[z[pick] >= Z]])
    x = np.zeros((n, len(chosen) + earlier.shape[1] + 1))
    if len(chosen):
        at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
        hit = chosen[at] == bucket
        x[row[hit], at[hit]] = 1.0
    x[:, len(chosen) : -1] = earlier
    x[:, -1] = 1.0
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(8):
        q = _sigmoid(x @ w)
        grad = x.T @ (q - y) + ridge * w
        hess = (x * np.maximum(q * (1 - q), 1e-4)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


def _apply(model: Linear, row: np.ndarray, bucket: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    z = np.full(n, model.bias) + earlier @ model.earlier
    if len(model.chosen):
        at = np.minimum(np.searchsorted(model.chosen, bucket), len(model.chosen) - 1)
        hit = model.chosen[at] == bucket
        z += np.bincount(row[hit], model.weights[at[hit]], minlength=n)
    return _sigmoid(z)


@dataclass
class Chain:
    """Models in chain order, with the threshold of each category."""

    names: list[str]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.names)))
        for k, model in enumerate(self.models):
            out[:, k] = _apply(model, row, bucket, n, _odds(out[:, :k]))
        return out


def fit_chain(names: list[str], row: np.ndarray, bucket: np.ndarray, labels: np.ndarray) -> Chain:
    """Fit on texts 0..n-1 with 0/1 ``labels`` (n, categories)."""
    n = len(labels)
    fold = np.arange(n) % FOLDS
    held = np.zeros((n, 0))  # out-of-fold log odds of the categories so far
    models, thresholds = [], []
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        out = np.zeros(n)
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            place = np.full(n, -1)
            place[train] = np.arange(len(train))
            mine = place[row] >= 0
            model = _fit(place[row[mine]], bucket[mine], len(train), held[train], y[train])
            place[:] = -1
            place[test] = np.arange(len(test))
            mine = place[row] >= 0
            out[test] = _apply(model, place[row[mine]], bucket[mine], len(test), held[test])
        models.append(_fit(row, bucket, n, held, y))
        thresholds.append(_threshold(out, y))
        held = np.concatenate([held, _odds(out)[:, None]], axis=1)
    return Chain(names, models, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold predictions, 0.5 at least.

    A category without enough rows of both classes is never reported.
    """
    if min(y.sum(), len(y) - y.sum()) < FOLDS:
        return float("inf")
    best, cut = -1.0, 0.5
    for t in np.arange(0.5, 0.96, 0.05):
        hit = p >= t
        f1 = 2 * (hit & (y > 0)).sum() / max(1, hit.sum() + y.sum())
        if f1 > best + 1e-9:
            best, cut = f1, float(t)
    return cut


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", chain: tuple[tuple[str, str], ...] = CHAIN, per_class: int = PER_CLASS) -> Chain:
    """Fit on at most about ``per_class`` rows of either class of each category."""
    marked = labels.select(F.col(key).alias("__key"), *[F.coalesce(F.expr(rule), F.lit(False)).cast("int").alias(name) for name, rule in chain])
    names = [name for name, _ in chain]
    marked = marked.where(F.col("__key").isNotNull())
    sizes = marked.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    span = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("__key")), F.lit(span))
    keep = F.lit(False)
    for c in names:
        for value, n in ((1, sizes[c]), (0, sizes["n"] - sizes[c])):
            keep = keep | ((F.col(c) == value) & (draw < int(span * min(1.0, per_class / max(1, n)))))
    picked = marked.where(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in byte_blocks(batch.column(text)):
                row, bucket = buckets(data, at)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__key").slice(i, j - i), *(batch.column(c).slice(i, j - i) for c in names), lists], names=["__key", *names, "buckets"]
                )

    rows = docs.select(F.col(key).alias("__key"), text).join(F.broadcast(picked), "__key")  # bounded by per_class
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"__key {kind}, " + ", ".join(f"{c} int" for c in names) + ", buckets array<int>"
    got = sorted(rows.select("__key", *names, text).mapInArrow(run, ddl).toLocalIterator(), key=lambda r: (r["__key"], r["buckets"]))
    y = np.array([[r[c] for c in names] for r in got]).reshape(len(got), len(names))
    lists = [r["buckets"] for r in got]
    row = np.repeat(np.arange(len(got)), [len(x) for x in lists]).astype(np.int64)
    bucket = np.array([b for x in lists for b in x], np.int64)
    return fit_chain(names, row, bucket, y)


def predict(df: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, p_<category>..., <category>...) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in byte_blocks(batch.column(text)):
                p = chain.probabilities(*buckets(data, at), j - i)
                cols = [pa.array(p[:, k]) for k in range(len(chain.names))]
                flags = [pa.array(p[:, k] >= t) for k, t in enumerate(chain.thresholds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(i, j - i), *cols, *flags], names=[key, *(f"p_{c}" for c in chain.names), *chain.names]
                )

    kind = df.schema[key].dataType.simpleString()
    ddl = ", ".join([f"`{key}` {kind}", *(f"p_{c} double" for c in chain.names), *(f"{c} boolean" for c in chain.names)])
    return map_batches(df.select(key, text), run, ddl)
