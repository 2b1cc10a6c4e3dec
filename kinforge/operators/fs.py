"""Fellegi-Sunter scoring: comparison levels, term frequencies, EM, match weights.

Comparison vectors are columns; the corpus enters the fit only as counts of
agreement patterns, so EM runs on a table whose size is the number of patterns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.draws import SPAN, draw, order_key
from kinforge.functions.strings import empty_to_null, jaro_winkler
from kinforge.operators import blockpairs
from kinforge.operators.scoring import attach

#: Levels of each role, best first; what is left is level 0.
NAME = (("exact", 0), ("jw", 0.92), ("jw", 0.88), ("jw", 0.70))
COMPARISONS: dict[str, tuple[tuple[str, float], ...]] = {
    "given_name": NAME,
    "family_name": NAME,
    "full_name": NAME,
    "middle_name": (("exact", 0), ("jw", 0.92), ("jw", 0.88)),
    "dob": (("exact", 0), ("lev", 1), ("lev", 2)),
    "birth_year": (("exact", 0),),
    "age": (("exact", 0),),
    "sex": (("exact", 0),),
    "city": (("exact", 0), ("jw", 0.92)),
    "state": (("exact", 0),),
    "zip": (("exact", 0), ("lev", 1)),
    "phone": (("exact", 0), ("lev", 1)),
    "email": (("exact", 0), ("lev", 2)),
    "street": (("exact", 0), ("jw", 0.92), ("jw", 0.88)),
    "street_address": (("exact", 0), ("jw", 0.92)),
    "house_number": (("exact", 0),),
    "name_suffix": (("exact", 0),),
}
TF_ROLES = ("given_name", "family_name", "full_name")
PRIOR_RECALL, U_SALT = 0.9, "17"


def usable_roles(df: DataFrame, roles: list[str]) -> list[str]:
    """Roles with a comparison and at least two different values."""
    have = [r for r in roles if r in COMPARISONS and r in df.columns]
    if {"given_name", "family_name"} <= set(have):
        have = [r for r in have if r != "full_name"]
    counts = df.agg(*[F.count_distinct(empty_to_null(F.col(r))).alias(r) for r in have]).first()
    return [r for r in have if counts[r] >= 2]


def rule_roles(roles: list[str]) -> tuple[list[str], list[str], str | None]:
    """(roles to block on, name-side EM keys, other-side EM key)."""
    have = set(roles)
    names = [r for r in ("given_name", "family_name") if r in have] if "family_name" in have else ["full_name"] if "full_name" in have else []
    other = next((r for r in ("dob", "zip", "phone", "birth_year") if r in have), None)
    return [r for r in ("family_name", "full_name", "dob", "zip", "phone") if r in have], names, other


def gamma(role: str, a: Column, b: Column, jw: Column | None = None) -> Column:
    """Level of a pair: -1 if a side is missing, 0 for no agreement, up to the best."""
    levels = COMPARISONS[role]
    out = F.lit(0)
    for rank, (kind, bound) in enumerate(reversed(levels), 1):
        test = {"exact": a == b, "lev": F.levenshtein(a, b) <= int(bound), "jw": (jw if jw is not None else F.lit(0.0)) >= bound}[kind]
        out = F.when(test, rank).otherwise(out)
    return F.when(a.isNull() | b.isNull(), -1).otherwise(out)


def gammas(pairs: DataFrame, records: DataFrame, roles: list[str]) -> DataFrame:
    """(a, b, g_<role>..., and for names the value both share)."""
    wide = attach(pairs, records.select("record_id", *[empty_to_null(F.col(r)).alias(r) for r in roles]), roles)
    fuzzy = [r for r in roles if any(k == "jw" for k, _ in COMPARISONS[r])]
    wide = wide.withColumns({f"jw_{r}": jaro_winkler(F.col(f"{r}_a"), F.col(f"{r}_b")) for r in fuzzy}) if fuzzy else wide
    levels = [gamma(r, F.col(f"{r}_a"), F.col(f"{r}_b"), F.col(f"jw_{r}") if r in fuzzy else None).alias(f"g_{r}") for r in roles]
    shared = [F.when(F.col(f"{r}_a") == F.col(f"{r}_b"), F.col(f"{r}_a")).alias(f"v_{r}") for r in roles if r in TF_ROLES]
    return wide.select("a", "b", *levels, *shared)


def term_frequencies(records: DataFrame, role: str) -> DataFrame:
    """(value, tf): share of each value among the present ones."""
    counts = records.select(empty_to_null(F.col(role)).alias("value")).where("value IS NOT NULL").groupBy("value").count()
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", (F.col("count") / F.col("total")).alias("tf"))  # one-row side


def patterns(levels: DataFrame, roles: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """Counts of agreement patterns (of pairs, or of rows with a ``count``); at most the product of the level numbers."""
    cols = [f"g_{r}" for r in roles]
    n = F.sum("count") if "count" in levels.columns else F.count("*")
    return [(tuple(r[c] for c in cols), r["count"]) for r in levels.groupBy(*cols).agg(n.alias("count")).orderBy(*cols).collect()]


def random_pairs(records: DataFrame, n_pairs: int, salt: str = U_SALT) -> DataFrame:
    """Pairs of neighbours in several hashed orders: about ``n_pairs`` unrelated pairs."""
    n = records.count()
    rounds = max(1, -(-n_pairs // max(1, n)))
    share = min(1.0, n_pairs / max(1, n * rounds))
    ids = records.select("record_id", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    ids = ids.withColumn("h", order_key("record_id", F.col("round"), salt=salt))
    # buckets of the hashed order hold a few records each; ranks pair them up
    buckets = max(1, n // 64)
    ids = ids.withColumn("bucket", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets)
    ids = ids.withColumn("rn", F.row_number().over(Window.partitionBy("round", "bucket").orderBy("h")))
    right = ids.select("round", "bucket", (F.col("rn") - 1).alias("rn"), F.col("record_id").alias("other"))
    joined = ids.join(right, ["round", "bucket", "rn"])
    if share < 1.0:
        joined = joined.where(draw(F.col("h"), salt) < int(share * SPAN))
    return joined.select(F.least("record_id", "other").alias("a"), F.greatest("record_id", "other").alias("b")).distinct()


@dataclass
class Model:
    """m and u probabilities of each role's levels, the prior, and the EM record."""

    roles: list[str]
    m: dict[str, list[float]]
    u: dict[str, list[float]]
    prior: float
    sessions: list[dict] = field(default_factory=list)
    tf: bool = True


def _levels(role: str) -> int:
    return len(COMPARISONS[role]) + 1


def u_probabilities(counts: list[tuple[tuple[int, ...], int]], roles: list[str]) -> dict[str, list[float]]:
    """Level shares among unrelated pairs, missing ones left out, lightly smoothed."""
    out = {}
    for k, role in enumerate(roles):
        n = [0.5 / _levels(role)] * _levels(role)
        for pattern, c in counts:
            if pattern[k] >= 0:
                n[pattern[k]] += c
        out[role] = [x / sum(n) for x in n]
    return out


def em(counts: list[tuple[tuple[int, ...], int]], roles: list[str], u: dict[str, list[float]], free: list[str], prior: float = 0.1, rounds: int = 100, tolerance: float = 1e-6) -> tuple[dict[str, list[float]], float, dict]:
    """m probabilities of the ``free`` roles from pattern counts with u fixed."""
    m = {r: [(1 + 9 * (k == _levels(r) - 1)) / (_levels(r) + 9) for k in range(_levels(r))] for r in free}
    share, delta, it = prior, 1.0, 0
    for it in range(1, rounds + 1):
        sums = {r: [1e-6] * _levels(r) for r in free}
        got = total = 0.0
        for pattern, c in counts:
            odds = share / max(1e-12, 1 - share)
            for k, r in enumerate(roles):
                if r in m and pattern[k] >= 0:
                    odds *= m[r][pattern[k]] / max(1e-12, u[r][pattern[k]])
            p = odds / (1 + odds)
            got += p * c
            total += c
            for k, r in enumerate(roles):
                if r in m and pattern[k] >= 0:
                    sums[r][pattern[k]] += p * c
        new = {r: [x / sum(s) for x in s] for r, s in sums.items()}
        delta = max([abs(x - y) for r in free for x, y in zip(new[r], m[r], strict=True)], default=0.0)
        m, share = new, min(1 - 1e-9, max(1e-9, got / max(1e-12, total)))
        if delta < tolerance:
            break
    return m, share, {"iterations": it, "final_delta": delta, "converged": delta < tolerance}


def _equal_count(records: DataFrame, keys: list[str]) -> int:
    """Number of pairs that agree on all keys, from the sizes of their groups."""
    cols = [empty_to_null(F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    sizes = records.select(*cols).dropna().groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    return int(sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0)


def fit(records: DataFrame, roles: list[str], max_pairs: float = 1e6, tf: bool = True) -> Model:
    """Prior from pairs equal on name and other key, u from random pairs, m from two
    EM sessions whose blocking keys complement each other."""
    roles = usable_roles(records, roles)
    _, names, other = rule_roles(roles)
    n = records.count()
    u = u_probabilities(patterns(gammas(random_pairs(records, int(max_pairs)), records, roles), roles), roles)
    keys = [*names, *([other] if other else [])]
    certain = _equal_count(records, keys) if keys else 0
    prior = min(0.5, max(1e-9, certain / PRIOR_RECALL / max(1.0, n * (n - 1) / 2)))
    m: dict[str, list[float]] = {}
    votes: dict[str, list[list[float]]] = {}
    sessions = []
    for block in (names, [other] if other else []):
        if not block:
            continue
        levels = blockpairs.pattern_counts(records, {r: COMPARISONS[r] for r in roles}, [[empty_to_null(F.col(k)) for k in block]])
        free = [r for r in roles if r not in block]
        found, share, record = em(patterns(levels, roles), roles, u, free)
        sessions.append({"block": block, "share": share, **record})
        for r, v in found.items():
            votes.setdefault(r, []).append(v)
    for r in roles:
        seen = votes.get(r) or [[(1 + 9 * (k == _levels(r) - 1)) / (_levels(r) + 9) for k in range(_levels(r))]]
        m[r] = [sum(v[k] for v in seen) / len(seen) for k in range(_levels(r))]
    return Model(roles, m, u, prior, sessions, tf)


def weights(model: Model) -> dict[str, list[float]]:
    """log2 Bayes factor of each level of each role."""
    return {r: [math.log2(max(1e-12, model.m[r][k]) / max(1e-12, model.u[r][k])) for k in range(_levels(r))] for r in model.roles}


def weight_columns(model: Model) -> dict[str, Column]:
    """log2 Bayes factor of each role's level; 0 when missing."""
    out = {}
    for r, bits in weights(model).items():
        w = F.lit(0.0)
        for k, x in enumerate(bits):
            w = F.when(F.col(f"g_{r}") == k, F.lit(x)).otherwise(w)
        out[r] = w
    return out


def _probability(total: Column) -> Column:
    odds = F.pow(F.lit(2.0), F.greatest(F.lit(-60.0), F.least(F.lit(60.0), total)))
    return odds / (1 + odds)


def score(pairs: DataFrame, records: DataFrame, model: Model) -> DataFrame:
    """(a, b, prob) of exactly the given pairs; raises on loops and unknown ids.

    On exact name agreement the level's u is replaced by the value's frequency.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if pairs.where("a = b").limit(1).count():
        raise ValueError("pairs of a record with itself")
    if pairs.select(F.explode(F.array("a", "b")).alias("record_id")).join(records, "record_id", "left_anti").limit(1).count():
        raise ValueError("pairs with an unknown record_id")
    levels = gammas(pairs, records, model.roles)
    bits = weight_columns(model)
    total = F.lit(math.log2(model.prior / (1 - model.prior)))
    for r in model.roles:
        w = bits[r]
        if model.tf and r in TF_ROLES:
            tf = term_frequencies(records, r).select(F.col("value").alias(f"v_{r}"), F.col("tf").alias(f"tf_{r}"))
            levels = levels.join(tf, f"v_{r}", "left")
            top = _levels(r) - 1
            w = w + F.when(F.col(f"g_{r}") == top, F.coalesce(F.log2(F.lit(model.u[r][top]) / F.col(f"tf_{r}")), F.lit(0.0))).otherwise(0.0)
        total = total + w
    return levels.select("a", "b", _probability(total).alias("prob"))


def score_blocks(records: DataFrame, model: Model) -> DataFrame:
    """``score`` of all match-key pairs, made and scored in the task that writes them."""
    rows, more = records, {}
    for r in [r for r in model.roles if model.tf and r in TF_ROLES]:
        gain = F.coalesce(F.log2(F.lit(model.u[r][_levels(r) - 1]) / F.col("tf")), F.lit(0.0)).cast("string")
        more[r] = f"tf_{r}"
        tf = term_frequencies(records, r).select(F.col("value").alias(f"of_{r}"), gain.alias(more[r]))
        rows = rows.join(tf, F.col(r) == F.col(f"of_{r}"), "left").drop(f"of_{r}")
    start = math.log2(model.prior / (1 - model.prior))
    pairs = blockpairs.weighted_rows(rows, {r: COMPARISONS[r] for r in model.roles}, weights(model), more, start)
    return pairs.select("a", "b", _probability(F.col("bits")).alias("prob"))
