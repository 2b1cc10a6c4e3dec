"""Vectorised word hashing over a block of UTF-8 texts.

Words are runs of ASCII letters and digits and of bytes of non-ASCII characters
other than general punctuation and Latin-1 signs. ASCII and Latin-1 capitals are
lowered. Every word gets a 64-bit hash of its bytes without a Python object
being made for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\r\"|"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"n": np.empty(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["n"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("n", _BASE), ("inv", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["n"][:n], _powers["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a block: byte span, text number, hash and what they look like."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray  # hash of the first bytes, as asked for
    number: np.ndarray  # digits only
    name: np.ndarray  # capital letter inside a sentence
    opens: np.ndarray  # capital letter at the start of a sentence


def words(data: np.ndarray, offsets: np.ndarray, prefix: int = 0, split: bool = False) -> Words:
    """Words of the texts that ``offsets`` cut ``data`` into; ``split`` cuts words after leading digits."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none.astype(bool), none.astype(bool))
    low = _LOWER[data]
    inside = _WORD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(lead):
        second = data[lead]
        up = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        low[up] += 0x20
    lead = np.flatnonzero(data[:-1] == 0xC2)
    if len(lead):
        inside[lead] = inside[lead + 1] = False
    lead = np.flatnonzero(data[:-2] == 0xE2)
    if len(lead):
        lead = lead[(data[lead + 1] == 0x80) | (data[lead + 1] == 0x81)]
        inside[lead] = inside[lead + 1] = inside[lead + 2] = False
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    if split and len(start):
        other = np.flatnonzero(~_DIGIT[data])
        cut = np.append(other, n)[np.searchsorted(other, start)]
        cut = cut[(cut > start) & (cut < end)]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    power, inverse = _power_tables(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    short = hashed
    if prefix:
        cut = np.minimum(end, start + prefix)
        short = mix((total[cut] - total[start]) * inverse[start] + np.uint64(0xABCDEF))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[end] - digits[start] == end - start
    row = np.searchsorted(offsets, start, "right") - 1
    # A capital opens a sentence when a stop, or nothing, stands between it and the word before.
    capital = (data[start] >= 65) & (data[start] <= 90)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(start), bool)
    opens[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    return Words(start, end, row, hashed, short, number, capital & ~opens, capital & opens)


def windows(hashed: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words of one text, and where it starts."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(_BASE) + hashed[k : k + n]
    same = row[:n] == row[width - 1 :]
    return mix(total[same]), np.flatnonzero(same)
