"""Partition-independent random draws.

``rand(seed)`` depends on how rows are dealt to tasks; every random choice of
the engine is instead a hash of (key, salt), so a rerun, a lost executor or
another partitioning gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def draw(key: Column | str, salt: str) -> Column:
    """Whole number in [0, 2**32) from the first 8 hex digits of md5(key|salt)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + salt)).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(key: Column | str, salt: str) -> Column:
    """The draw as a double in [0, 1)."""
    return draw(key, salt) / F.lit(float(SPAN))


def order_key(*keys: Column | str, salt: str) -> Column:
    """md5 text by which rows are put in random order."""
    parts = [F.lit(salt)] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def pick(pool: list[str], n: Column) -> Column:
    """Element of a literal pool by a draw."""
    return F.element_at(F.array(*map(F.lit, pool)), (n % len(pool) + 1).cast("int"))


def sql_draw(key: str, salt: str) -> str:
    """DuckDB text of :func:`draw`."""
    return f"('0x' || substr(md5({key} || '|{salt}'), 1, 8))::BIGINT"
