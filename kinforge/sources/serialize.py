"""Records as text, in four schemes and two ways to treat missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.strings import empty_to_null

SCHEMES, MISSING = ("colval", "template", "json", "bare"), ("token", "drop")
TOKEN = "[MISSING]"


def _quoted(c: Column) -> Column:
    """A JSON string; escaping is left to Spark's own writer."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def serialize(df: DataFrame, roles: list[str], scheme: str = "colval", missing: str = "token", field_order: list[str] | None = None) -> Column:
    """Text of each row of ``df``; a role without a column counts as missing.

    colval: ``[COL] role [VAL] value``; template: ``role: value``; json: an
    object; bare: the values. Values stand verbatim; only null and empty ones
    are missing.
    """
    if scheme not in SCHEMES or missing not in MISSING:
        raise ValueError(f"unknown scheme {scheme!r} or missing mode {missing!r}")
    order = field_order or roles
    if sorted(order) != sorted(roles):
        raise ValueError("field_order must be a permutation of the roles")
    pieces = []
    for role in order:
        value = empty_to_null(F.col(role).cast("string")) if role in df.columns else F.lit(None).cast("string")
        if missing == "token":
            value = F.coalesce(value, F.lit(TOKEN))
        pieces.append(
            {
                "colval": F.concat(F.lit(f"[COL] {role} [VAL] "), value),
                "template": F.concat(F.lit(f"{role}: "), value),
                "json": F.when(value.isNotNull(), F.concat(F.lit(f'"{role}":'), _quoted(value))),
                "bare": value,
            }[scheme]
        )
    present = F.filter(F.array(*pieces), lambda x: x.isNotNull())
    joined = F.array_join(present, {"colval": " ", "template": " | ", "json": ",", "bare": " "}[scheme])
    return F.concat(F.lit("{"), joined, F.lit("}")) if scheme == "json" else joined
