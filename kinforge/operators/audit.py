"""Taxonomy of differences between two snapshots of the same records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions import dates
from kinforge.functions.strings import blank_to_null, skeleton

CATEGORIES = ("identical", "missing_gain", "missing_loss", "swap", "format_drift", "nickname", "typo", "wholesale")
MAX_EDITS = 2
SWAP_FIELDS = ("given_name", "middle_name", "family_name")
Z95 = 1.959963984540054

#: Postal abbreviations, long and short.
ABBREVIATIONS = {
    "STREET": "ST",
    "AVENUE": "AVE",
    "ROAD": "RD",
    "DRIVE": "DR",
    "LANE": "LN",
    "BOULEVARD": "BLVD",
    "COURT": "CT",
    "CIRCLE": "CIR",
    "PLACE": "PL",
    "HIGHWAY": "HWY",
    "TRAIL": "TRL",
    "PARKWAY": "PKWY",
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
    "APARTMENT": "APT",
    "SUITE": "STE",
}


def align(left: DataFrame, right: DataFrame, key: str = "ncid") -> DataFrame:
    """Rows of keys that occur once on each side, columns suffixed _a and _b.

    A key that repeats on a side is left out whole, so the join never fans out;
    null keys meet nothing.
    """

    def once(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        single = df.where(F.col(key).isNotNull()).withColumn("__n", n).where("__n = 1").drop("__n")
        return single.select(key, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c != key])

    return once(left, "a").join(once(right, "b"), key)


def align_stats(left: DataFrame, right: DataFrame, key: str = "ncid") -> DataFrame:
    """(dup_keys_a, dup_keys_b, n_aligned)."""

    def repeated(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias(name))

    joined = align(left, right, key).agg(F.count("*").alias("n_aligned"))
    return repeated(left, "dup_keys_a").crossJoin(repeated(right, "dup_keys_b")).crossJoin(joined)  # one-row aggregates


def _short(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    words = F.transform(F.split(F.upper(F.trim(c)), r"\s+"), lambda w: F.coalesce(F.try_element_at(table, w), w))
    return skeleton(F.array_join(words, " "))


def _classes(c: Column, lexicon: dict[str, list[str]]) -> Column:
    """Numbers of the nickname classes a name belongs to."""
    of: dict[str, list[int]] = {}
    for i, (name, variants) in enumerate(sorted(lexicon.items())):
        for x in {name, *variants}:
            of.setdefault(x.lower(), []).append(i)
    table = F.create_map(*[y for k, v in sorted(of.items()) for y in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.array().cast("array<int>"))


def category(field: str, fields: list[str], lexicon: dict[str, list[str]] | None = None, swap_fields: tuple[str, ...] = SWAP_FIELDS) -> Column:
    """Category of one field's change; the first rule that fits wins."""
    a, b = F.col(f"{field}_a"), F.col(f"{field}_b")
    gone_a, gone_b = blank_to_null(a).isNull(), blank_to_null(b).isNull()

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x == y, F.lit(False))

    swap = F.lit(False)
    if field in swap_fields:
        for other in swap_fields:
            if other != field and other in fields:
                oa, ob = F.col(f"{other}_a"), F.col(f"{other}_b")
                swap = swap | (same(a, ob) & same(oa, b) & blank_to_null(oa).isNotNull() & blank_to_null(ob).isNotNull())
    drift = same(skeleton(a), skeleton(b)) | same(_short(a), _short(b)) | same(dates.parse(a), dates.parse(b))
    nick = F.arrays_overlap(_classes(a, lexicon), _classes(b, lexicon)) if lexicon and field == "given_name" else F.lit(False)
    typo = F.levenshtein(F.lower(a), F.lower(b), MAX_EDITS) >= 0  # -1 beyond the bound
    return (
        F.when((gone_a & gone_b) | (~gone_a & ~gone_b & same(a, b)), "identical")
        .when(gone_a, "missing_gain")
        .when(gone_b, "missing_loss")
        .when(swap, "swap")
        .when(drift, "format_drift")
        .when(nick, "nickname")
        .when(typo, "typo")
        .otherwise("wholesale")
    )


def classify(aligned: DataFrame, fields: list[str], lexicon: dict[str, list[str]] | None = None, key: str = "ncid", keep: list[str] | None = None, swap_fields: tuple[str, ...] = SWAP_FIELDS) -> DataFrame:
    """Long table (key, keep..., field, category)."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), category(f, fields, lexicon, swap_fields).alias("category")) for f in fields])
    return aligned.select(key, *(keep or []), F.explode(cells).alias("x")).select(key, *(keep or []), "x.*")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n, clipped to [0, 1]."""
    p, z2 = k / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    return F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)


def prevalence(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., field, category, n, total, rate, lo, hi) of the observed categories."""
    by = by or []
    counts = long.groupBy(*by, "field", "category").agg(F.count("*").alias("n"))
    full = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*by, "field")))
    lo, hi = wilson(F.col("n"), F.col("total"))
    return full.select(*by, "field", "category", "n", "total", (F.col("n") / F.col("total")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def report(aligned: DataFrame, fields: list[str], lexicon: dict[str, list[str]] | None = None, by: list[str] | None = None, key: str = "ncid") -> DataFrame:
    """Prevalence of each category, by group columns of the aligned table."""
    return prevalence(classify(aligned, fields, lexicon, key, by), by)


def category_mix(long: DataFrame) -> DataFrame:
    """Wide table: a row per field, a share per category."""
    shares = long.groupBy("field").pivot("category", list(CATEGORIES)).count().fillna(0)
    total = sum((F.col(c) for c in CATEGORIES), F.lit(0))
    return shares.select("field", *[(F.col(c) / total).alias(c) for c in CATEGORIES])


def jensen_shannon(p: list[Column], q: list[Column]) -> Column:
    """Divergence of two share vectors, in bits."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    total = F.lit(0.0)
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total = total + half(a, m) / 2 + half(b, m) / 2
    return total


def name_spread(records: DataFrame, name: str = "full_name", unit: str = "entity_id") -> DataFrame:
    """(unit, n_names, spread): the largest token-set Jaccard distance between an entity's different names.

    Names are compared once each; null and blank ones are left out, and an entity
    with one name has spread 0.
    """
    tokens = F.array_distinct(F.filter(F.split(F.trim(F.col(name)), r"\s+"), lambda t: t != ""))
    names = records.select(F.col(unit).alias("unit"), F.array_sort(tokens).alias("t")).where("unit IS NOT NULL AND size(t) > 0").distinct()
    pairs = names.alias("l").join(names.alias("r"), "unit").where("l.t <= r.t")
    apart = 1.0 - F.size(F.array_intersect("l.t", "r.t")) / F.size(F.array_union("l.t", "r.t"))
    spread = pairs.groupBy("unit").agg(F.max(apart).alias("spread"))
    return names.groupBy("unit").agg(F.count("*").alias("n_names")).join(spread, "unit").select(F.col("unit").alias(unit), "n_names", "spread")
