"""String comparison functions: Jaro-Winkler, guarded soundex, missing values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_WEIGHT, MAX_PREFIX, BOOST_FROM = 0.1, 4, 0.7
#: Characters of one side that are compared at once.
BLOCK_CELLS = 1 << 18


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    m = len(first)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro similarity raised by a common prefix of up to four characters."""
    score = jaro(a, b)
    if score > BOOST_FROM:
        same = 0
        for x, y in zip(a[:MAX_PREFIX], b[:MAX_PREFIX], strict=False):
            if x != y:
                break
            same += 1
        score += same * PREFIX_WEIGHT * (1.0 - score)
    return score


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, longest) code points, 0 beyond a text's end, and the lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(sizes.max(initial=1))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def _block_scores(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler_value`` of each pair of a block, character by character for all pairs at once."""
    (x, nx), (y, ny) = _code_points(a), _code_points(b)
    rows, place = np.arange(len(a)), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)
    hit, free = np.zeros(x.shape, bool), place < ny[:, None]
    for i in range(x.shape[1]):
        near = free & (y == x[:, i, None]) & (np.abs(place - i) <= reach[:, None]) & (i < nx)[:, None]
        first = near.argmax(axis=1)
        found = near[rows, first]
        hit[:, i] = found
        free[rows[found], first[found]] = False
    used = (place < ny[:, None]) & ~free
    m = hit.sum(axis=1)
    width = int(m.max(initial=0))
    p, q = (np.take_along_axis(t, np.argsort(~k, axis=1, kind="stable")[:, :width], axis=1) for t, k in ((x, hit), (y, used)))
    swaps = ((p != q) & (np.arange(width) < m[:, None])).sum(axis=1) // 2
    some = np.maximum(m, 1)
    score = np.where(m > 0, (m / np.maximum(nx, 1) + m / np.maximum(ny, 1) + (m - swaps) / some) / 3.0, 0.0)
    both = min(MAX_PREFIX, x.shape[1], y.shape[1])
    same = (x[:, :both] == y[:, :both]) & (np.arange(both) < np.minimum(nx, ny)[:, None])
    same = np.cumprod(same, axis=1).sum(axis=1)
    score = np.where(score > BOOST_FROM, score + same * PREFIX_WEIGHT * (1.0 - score), score)
    return np.where([u == v for u, v in zip(a, b, strict=True)], 1.0, score)


def jaro_winkler_values(a: list[str], b: list[str]) -> np.ndarray:
    """Scores of many pairs, in blocks of pairs of like length."""
    out = np.empty(len(a))
    order = sorted(range(len(a)), key=lambda i: max(len(a[i]), len(b[i])))
    at = 0
    while at < len(order):
        size = max(1, min(len(order) - at, BLOCK_CELLS // max(1, len(a[order[at]]), len(b[order[at]]))))
        while size > 1 and size * max(1, len(a[order[at + size - 1]]), len(b[order[at + size - 1]])) > 2 * BLOCK_CELLS:
            size //= 2
        part = order[at : at + size]
        out[part] = _block_scores([a[i] for i in part], [b[i] for i in part])
        at += size
    return out


def code_table(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of different values as small numbers (from 2; 0 beyond a value's end), and the lengths."""
    points, sizes = _code_points(values)
    letters, at = np.unique(points, return_inverse=True)
    kind = np.uint8 if len(letters) < 250 else np.uint32
    out = (at.reshape(points.shape) + 2).astype(kind)
    out[np.arange(points.shape[1]) >= sizes[:, None]] = 0
    return out, sizes


def jaro_winkler_codes(table: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``jaro_winkler_value`` of the values numbered ``a`` and ``b`` of a table: letters lie in rows, pairs in columns."""
    letters, sizes = table
    out = np.empty(len(a))
    step = max(256, (1 << 18) // max(1, letters.shape[1]))
    for at in range(0, len(a), step):
        out[at : at + step] = _column_scores(letters, sizes, a[at : at + step], b[at : at + step])
    return out


def _column_scores(letters: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    nx, ny = sizes[a], sizes[b]
    wx, wy = int(nx.max(initial=0)), int(ny.max(initial=0))
    x, y = np.ascontiguousarray(letters[a, :wx].T), np.ascontiguousarray(letters[b, :wy].T)
    y[y == 0] = 1  # an end matches no end
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)
    far, near = int(reach.max(initial=0)), int(reach.min(initial=0))
    within = [None if d <= near else reach >= d for d in range(far + 1)]
    hit, free = np.zeros((wx, len(a)), bool), np.ones((wy, len(a)), bool)
    for i in range(wx):
        found = hit[i]
        for j in range(max(0, i - far), min(wy, i + far + 1)):
            new = x[i] == y[j]
            new &= free[j]
            np.greater(new, found, out=new)
            if within[abs(i - j)] is not None:
                new &= within[abs(i - j)]
            found |= new
            free[j] ^= new
    kind = np.uint8 if max(wx, wy) < 250 else np.uint32
    first, second = np.zeros(x.shape, kind), np.full(y.shape, np.iinfo(kind).max, kind)
    m, n = np.zeros(len(a), kind), np.zeros(len(a), kind)
    for i in range(wx):
        m += hit[i]
        np.copyto(first[i], m, where=hit[i])
    for j in range(wy):
        used = ~free[j]
        n += used
        np.copyto(second[j], n, where=used)
    # the k-th matched letters of both sides lie within reach of each other, too
    m = m.astype(np.int64)
    apart = np.zeros(len(a), kind)
    for i in range(wx):
        for j in range(max(0, i - far), min(wy, i + far + 1)):
            wrong = first[i] == second[j]
            wrong &= x[i] != y[j]
            apart += wrong
    swaps = (apart // 2).astype(np.int64)
    some = np.maximum(m, 1)
    score = np.where(m > 0, (m / np.maximum(nx, 1) + m / np.maximum(ny, 1) + (m - swaps) / some) / 3.0, 0.0)
    same, still = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for i in range(min(MAX_PREFIX, wx, wy)):
        still &= x[i] == y[i]
        same += still
    score = np.where(score > BOOST_FROM, score + same * PREFIX_WEIGHT * (1.0 - score), score)
    return np.where(a == b, 1.0, score)


def edits_within(table: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of the values numbered ``a`` and ``b`` of a table, or ``most`` + 1 where it is larger."""
    letters, sizes = table
    # an edit changes at most two of the bits that count each letter's occurrences
    bits = np.zeros(len(sizes), np.uint64)
    for k in range(16):
        n = np.minimum(((letters % 16 == k) & (letters > 0)).sum(axis=1), 4)
        bits |= ((1 << n) - 1).astype(np.uint64) << np.uint64(4 * k)
    out = np.full(len(a), most + 1, np.int8)
    step = 1 << 16
    for at in range(0, len(a), step):
        p, q = a[at : at + step], b[at : at + step]
        near = np.flatnonzero((np.bitwise_count(bits[p] ^ bits[q]) <= 2 * most) & (np.abs(sizes[p] - sizes[q]) <= most))
        if len(near):
            out[at + near] = _band(letters, sizes, p[near], q[near], most)
    return out


def _band(letters: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distances up to ``most``, from the diagonals that such a distance can use."""
    nx, ny = sizes[a], sizes[b]
    wx, wy = int(nx.max()), int(ny.max())
    x, y = np.ascontiguousarray(letters[a, :wx].T), np.ascontiguousarray(letters[b, :wy].T)
    over = most + 1
    row = [np.full(len(a), min(abs(o), over) if o >= 0 else over, np.uint8) for o in range(-most, most + 1)]
    out = np.full(len(a), over, np.uint8)

    def note(i: int) -> None:
        for o, d in enumerate(row):
            np.copyto(out, d, where=(nx == i) & (ny == i + o - most))

    note(0)
    for i in range(1, wx + 1):
        new: list[np.ndarray] = []
        for o in range(2 * most + 1):
            j = i + o - most
            if j < 0 or j > wy:
                d = np.full(len(a), over, np.uint8)
            elif j == 0:
                d = np.full(len(a), min(i, over), np.uint8)
            else:
                d = row[o] + (x[i - 1] != y[j - 1])
                if o + 1 < len(row):
                    np.minimum(d, row[o + 1] + np.uint8(1), out=d)
                if o:
                    np.minimum(d, new[o - 1] + np.uint8(1), out=d)
                np.minimum(d, np.uint8(over), out=d)
            new.append(d)
        row = new
        if i >= int(nx.min()):
            note(i)
    return out


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    # Blocked pairs repeat values: each different pair of a batch is scored once.
    pairs: dict[tuple[str, str], int] = {}
    which = [-1 if x is None or y is None else pairs.setdefault((x, y), len(pairs)) for x, y in zip(a, b, strict=True)]
    scores = jaro_winkler_values([x for x, _ in pairs], [y for _, y in pairs])
    return pd.Series(np.append(scores, np.nan)[which], dtype="float64").astype(object).where(pd.Series(which) >= 0, None)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity; null if either is null."""
    return _jaro_winkler(a, b)


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and white-space-only values (blocking and audit)."""
    return F.when(F.trim(c) != "", c)


def empty_to_null(c: Column) -> Column:
    """Null for null and empty values; white space is content (schema, serialiser)."""
    return F.nullif(c, F.lit(""))


def norm(c: Column) -> Column:
    """Lower-cased trimmed value, null when nothing is left (rules)."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def eq(a: Column, b: Column) -> Column:
    """Equality that is false, not null, when a side is missing."""
    return F.coalesce(a == b, F.lit(False))


def soundex(c: Column) -> Column:
    """Soundex of the trimmed value; null unless it starts with a letter A-Z."""
    value = F.trim(c)
    return F.when(value.rlike("^[A-Za-z]"), F.soundex(value))


def initial(c: Column) -> Column:
    """First character that is no space, in upper case."""
    return F.nullif(F.upper(F.substring(F.trim(c), 1, 1)), F.lit(""))


def year(c: Column) -> Column:
    """First run of four digits."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit(""))


def skeleton(c: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")


def mask(c: Column) -> Column:
    """Every visible character replaced, for display of personal values."""
    return F.regexp_replace(c, r"\S", "x")
