"""Media columns: PNG images held in binary columns, and their hashes.

A payload is stored as 8-bit RGB samples, 64 pixels (192 bytes) a row, in a PNG
file: zlib stream over filtered rows, split over IDAT chunks, each chunk with
its CRC. Reading checks every chunk and undoes the row filters with numpy. The
feature is a perceptual hash: grey image, 32 x 32 area means, the 8 x 8 lowest
cosine coefficients, one bit each against their median.

Defined results: a null or empty text is one row of spaces; equal texts give
equal files and features. Memory follows the longest text of a batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinforge.llm.common import map_batches, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROW = 192
CHUNK = 1 << 16
GRID, LOW = 32, 8


def pad(raw: bytes, row: int = ROW) -> bytes:
    """``raw`` with spaces up to a positive multiple of ``row``."""
    return raw + b" " * (max(row, -(-len(raw) // row) * row) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, channels: int = 3, width: int = ROW // 3, level: int = 3) -> bytes:
    """Lossless PNG of ``payload``, whose length is a multiple of width x channels.

    Each row takes the filter (none, sub or up) with the least sum of absolute
    signed differences, the lowest number on a tie.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width * channels)
    left = np.zeros_like(rows)
    left[:, channels:] = rows[:, :-channels]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    kinds = np.stack([rows, rows - left, rows - above])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
    pick = cost.argmin(axis=0)
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    lines[:, 0] = pick
    lines[:, 1:] = kinds[pick, np.arange(len(rows))]
    body = zlib.compress(lines.tobytes(), level)
    color = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, color, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """Samples of filtered rows; ``lines`` has the filter number in column 0."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown PNG row filter")
    for y in np.flatnonzero(kinds):
        row, kind = rows[y], kinds[y]
        above = rows[y - 1] if y else np.zeros_like(row)
        if kind == 1:
            rows[y] = np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            rows[y] = row + above
        else:
            a = np.zeros(channels, np.int32)
            up, out = above.reshape(-1, channels).astype(np.int32), row.reshape(-1, channels).astype(np.int32)
            c = np.zeros(channels, np.int32)
            for x in range(len(out)):
                b = up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                a = out[x] = (out[x] + guess) & 255
                c = b
            rows[y] = out.reshape(-1).astype(np.uint8)
    return rows


def read_png(data: bytes) -> np.ndarray:
    """Samples (rows, width, channels) of an 8-bit PNG without interlacing.

    Raises ValueError when the signature, a chunk's CRC or the size is wrong,
    and zlib.error when the stream's own checksum is.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(chunk) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + chunk):
            raise ValueError(f"damaged PNG chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("PNG without end")
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("unsupported PNG header")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != height * (width * channels + 1):
        raise ValueError("PNG data does not fill the image")
    return unfilter(raw.reshape(height, -1), channels).reshape(height, width, channels)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


_DCT = _cosines(GRID, LOW)


def _shrink(grey: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` even spans of rows (spans shorter than a row repeat it)."""
    size = len(grey)
    lo = np.arange(n) * size // n
    hi = np.maximum(lo + 1, (np.arange(n) + 1) * size // n)
    total = np.concatenate([np.zeros((1, grey.shape[1])), np.cumsum(grey, axis=0)])
    return (total[hi] - total[lo]) / (hi - lo)[:, None]


def cosine_hash(image: np.ndarray) -> bytes:
    """64-bit hash of the lowest cosine frequencies, as 8 bytes."""
    grey = image.mean(axis=2)
    low = _DCT @ _shrink(_shrink(grey, GRID).T, GRID).T @ _DCT.T
    flat = np.round(low.reshape(-1), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, png binary) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raws = [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([len(x) for x in raws], pa.int64()), pa.array([write_png(pad(x)) for x in raws], pa.binary())],
                names=[key, "n_bytes", "png"],
            )

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), run, f"`{key}` {kind}, n_bytes long, png binary")


def read_media(df: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """Decode the png column: payload size and digests, file digests, 8-byte hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for data in batch.column("png").to_pylist():
                image = read_png(data)
                payload = image.tobytes()
                for c, v in zip(
                    cols,
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)),
                    strict=True,
                ):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (key, *keep)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[key, *keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"],
            )

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return df.select(key, *keep, "png").mapInArrow(
        run, head + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"
    )
