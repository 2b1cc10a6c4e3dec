"""Candidate pairs by multi-pass match keys.

A pass is a list of key specs, compiled to columns so that every pass is an
equality join. Pairs are canonical (a < b by code points) and distinct.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import strings
from kinforge.session import materialize

SPEC = re.compile(r"(?:(soundex|initial|year)\()?(\w+)\)?$")


def key_column(spec: str) -> Column:
    """Column of ``role``, ``soundex(role)``, ``initial(role)`` or ``year(role)``.

    Null and blank values give null: the record sits the pass out.
    """
    m = SPEC.fullmatch(spec.strip())
    if not m:
        raise ValueError(f"bad key spec {spec!r}")
    value = strings.blank_to_null(F.col(m[2]))
    return {None: lambda c: c, "soundex": strings.soundex, "initial": strings.initial, "year": strings.year}[m[1]](value)


def default_passes(columns: list[str]) -> list[list[str]]:
    """Passes for the roles at hand: family sound and birth, zip and initial, phone."""
    have = set(columns)
    passes = []
    family = next((r for r in ("family_name", "full_name") if r in have), None)
    if family:
        birth = next((spec for role, spec in (("dob", "year(dob)"), ("birth_year", "birth_year"), ("age", "age"), ("given_name", "initial(given_name)")) if role in have), None)
        passes.append([f"soundex({family})", *([birth] if birth else [])])
    if {"zip", "given_name"} <= have:
        passes.append(["zip", "initial(given_name)"])
    if "phone" in have:
        passes.append(["phone"])
    if not passes:
        raise ValueError("no usable blocking columns; give passes")
    return passes


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [key_column(k).alias(f"k{i}") for i, k in enumerate(keys)]
    return df.select(F.col("record_id").alias("rid"), *cols).dropna()


def pass_pairs(df: DataFrame, passes: list[list[str]], window: int | None = None) -> DataFrame:
    """(pass, k, a, b): every pair of every pass, with its block key.

    With ``window`` a record meets its next so many neighbours in id order only,
    so a block of s records gives at most s x window pairs.
    """
    out = None
    for p, keys in enumerate(passes):
        names = [f"k{i}" for i in range(len(keys))]
        rows = _keyed(df, keys)
        if window:
            rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*names).orderBy("rid")))
        left = rows.select(*names, F.col("rid").alias("a"), *([F.col("rn").alias("ra")] if window else []))
        right = rows.select(*names, F.col("rid").alias("b"), *([F.col("rn").alias("rb")] if window else []))
        if window:
            # neighbours are reached by an equality on the position too
            left = left.withColumn("rb", F.explode(F.sequence(F.col("ra") + 1, F.col("ra") + window)))
            joined = left.join(right, [*names, "rb"])
        else:
            joined = left.join(right, names).where("a < b")
        part = joined.select(F.lit(p).alias("pass"), F.array(*names).alias("k"), "a", "b")
        out = part if out is None else out.unionByName(part)
    return out


def candidates(df: DataFrame, passes: list[list[str]] | None = None, window: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of the union of all passes."""
    return pass_pairs(df, passes or default_passes(df.columns), window).select("a", "b").distinct()


def pass_stats(df: DataFrame, passes: list[list[str]] | None = None) -> DataFrame:
    """Blocks, largest block, pairs generated and pairs new in each pass.

    Counted from block sizes; only the new pairs need the pairs themselves.
    """
    passes = passes or default_passes(df.columns)
    sizes = None
    for p, keys in enumerate(passes):
        part = _keyed(df, keys).groupBy(*[f"k{i}" for i in range(len(keys))]).count().where("count > 1").select(F.lit(p).alias("pass"), "count")
        sizes = part if sizes is None else sizes.unionByName(part)
    blocks = sizes.groupBy("pass").agg(
        F.count("*").alias("n_blocks"), F.max("count").alias("max_block"), F.sum(F.expr("count * (count - 1) div 2")).alias("pairs_generated")
    )
    first = pass_pairs(df, passes).groupBy("a", "b").agg(F.min("pass").alias("pass")).groupBy("pass").agg(F.count("*").alias("pairs_new"))
    return blocks.join(first, "pass", "left").select("pass", "n_blocks", "max_block", "pairs_generated", F.coalesce("pairs_new", F.lit(0)).alias("pairs_new"))


def budgeted(df: DataFrame, k: int, passes: list[list[str]] | None = None) -> DataFrame:
    """Pairs kept when each record may take part in at most ``k`` of them.

    Pairs are offered in generation order (pass, block key, a, b) and kept while
    both records have room. That sequential rule is followed exactly and in
    parallel: in each round a pair is kept when it is among the first free
    places of both its records, and dropped when a record is full.
    """
    passes = passes or default_passes(df.columns)
    offer = F.struct("pass", "k", "a", "b")
    rest = materialize(pass_pairs(df, passes, window=k).groupBy("a", "b").agg(F.min(offer).alias("place")), "offers")
    kept = None
    while not rest.isEmpty():
        used = None
        if kept is not None:
            used = kept.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count("*").alias("used"))
        ends = rest.select("a", "b", "place", F.explode(F.array("a", "b")).alias("r"))
        if used is not None:
            ends = ends.join(used, "r", "left").fillna(0, ["used"])
        else:
            ends = ends.withColumn("used", F.lit(0).cast("long"))
        ranked = ends.withColumn("rn", F.row_number().over(Window.partitionBy("r").orderBy("place")))
        state = materialize(
            ranked.groupBy("a", "b").agg(
                F.first("place").alias("place"), F.max(F.col("rn") + F.col("used")).alias("need"), F.max("used").alias("used")
            ),
            "state",
        )
        taken = state.where(F.col("need") <= k).select("a", "b")
        kept = materialize(taken if kept is None else kept.unionByName(taken), "kept")
        after = kept.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").count().where(F.col("count") >= k).select("r")
        open_ = state.where(F.col("need") > k)
        open_ = open_.join(after, open_["a"] == after["r"], "left_anti").join(after, open_["b"] == after["r"], "left_anti")
        rest = materialize(open_.select("a", "b", "place"), "offers")
    return kept if kept is not None else df.sparkSession.createDataFrame([], "a string, b string")
