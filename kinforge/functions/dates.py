"""Dates held as text in one of five fixed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (pattern to parse, pattern to print), tried in this order.
FORMATS: tuple[tuple[str, str], ...] = (
    ("yyyy-M-d", "yyyy-MM-dd"),
    ("M/d/yyyy", "MM/dd/yyyy"),
    ("yyyyMMdd", "yyyyMMdd"),
    ("M-d-yyyy", "MM-dd-yyyy"),
    ("d MMM yyyy", "dd MMM yyyy"),
)


def parse(c: Column) -> Column:
    """Date of the first format that fits, null if none does."""
    return F.coalesce(*[F.try_to_date(F.trim(c), p) for p, _ in FORMATS])


def format_of(c: Column) -> Column:
    """Number of the first format that fits, null if none does."""
    return F.coalesce(*[F.when(F.try_to_date(F.trim(c), p).isNotNull(), F.lit(i)) for i, (p, _) in enumerate(FORMATS)])


def render(day: Column, number: Column) -> Column:
    """A date in the format of the given number."""
    out = F.lit(None).cast("string")
    for i, (_, p) in enumerate(FORMATS):
        out = F.when(number == i, F.date_format(day, p)).otherwise(out)
    return out


def shift_years(c: Column, years: Column | int) -> Column:
    """The same format some years later; 29 February falls to the 28th."""
    months = (F.lit(years) if isinstance(years, int) else years) * 12
    return render(F.add_months(parse(c), months), format_of(c))
