"""Noisy corpora with known truth: duplicates with channel noise, household confusables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import dates
from kinforge.functions.draws import SPAN, draw, uniform
from kinforge.operators.channels import OPS, REGISTRY, Channel
from kinforge.operators.exposure import ExposureModel
from kinforge.session import materialize

#: Fixed values of the duplicate-count law.
ZIPF_A, ZIPF_MAX = 2.5, 20


def zipf_count(key: Column, salt: str, a: float = ZIPF_A, most: int = ZIPF_MAX) -> Column:
    """Cluster size 1..most with weights k**-a, by the inverse of the cumulated weights."""
    weights = [k**-a for k in range(1, most + 1)]
    total, run, out = sum(weights), 0.0, F.lit(most)
    cuts = []
    for w in weights[:-1]:
        run += w
        cuts.append(int(run / total * SPAN))
    for k in range(most - 1, 0, -1):
        out = F.when(draw(key, salt) < cuts[k - 1], k).otherwise(out)
    return out


def generate_corpus(
    base: DataFrame,
    channel_rates: dict[str, float],
    exposure: ExposureModel | None = None,
    channels: dict[str, Channel] | None = None,
    keep_original_rate: float = 1.0,
    seed: int = 0,
    zipf: tuple[float, int] = (ZIPF_A, ZIPF_MAX),
) -> tuple[DataFrame, DataFrame]:
    """(corpus, log): originals plus duplicates ``<id>#dup<i>`` with channel noise.

    Rates are taken from the clean record, channels run in the given order, and
    an original stays with ``keep_original_rate``. Replaying the log on the
    duplicates' clean values gives the corpus.
    """
    unknown = sorted(set(channel_rates) - set(channels or {}) - set(REGISTRY))
    if unknown:
        raise KeyError(f"unknown channels {unknown}")
    exposure = exposure or ExposureModel.uniform()
    entity = F.coalesce("entity_id", "record_id")
    base = base.withColumn("entity_id", entity)
    n = zipf_count(F.col("record_id"), f"{seed}:zipf", *zipf)
    dups = base.withColumn("__i", F.explode(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))))
    dups = exposure.rates(dups, 1.0).withColumnRenamed("rate", "__mult")
    dups = dups.withColumn("record_id", F.concat("record_id", F.lit("#dup"), F.col("__i").cast("string"))).drop("__i")
    log = None
    for name, rate in channel_rates.items():
        channel = (channels or {}).get(name) or REGISTRY[name]()
        dups, ops = channel.apply(dups, F.least(F.lit(1.0), F.col("__mult") * rate), seed)
        log = ops if log is None else log.unionByName(ops)
    kept = base.where(uniform("record_id", f"{seed}:keep") < keep_original_rate)
    corpus = kept.unionByName(dups.drop("__mult").select(*base.columns))
    return corpus, log if log is not None else base.sparkSession.createDataFrame([], OPS)


def household_confusables(base: DataFrame, rate: float, seed: int = 0, pool: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new records, log): siblings, twins and juniors of some records, as new entities.

    A sibling has another given name and a birth date one to ten years away, a
    twin another given name only, a junior the same name, suffix JR, born 20 to
    35 years later. Without a suffix column there are siblings and twins only.
    """
    suffix = "name_suffix" in base.columns
    names = pool or sorted({n.capitalize() for n in ("robert", "alice", "peter", "helen", "thomas", "clara", "simon", "teresa", "victor", "diana", "ingrid", "felix")})
    hit = base.where(uniform("record_id", f"{seed}:house") < rate)
    u = uniform("record_id", f"{seed}:kind")
    kind = F.when(u < 0.5, "sibling").when(u < 0.75, "twin").otherwise("jr_sr") if suffix else F.when(u < 2 / 3, "sibling").otherwise("twin")
    pool_col = F.array(*map(F.lit, names))
    at = (draw("record_id", f"{seed}:name") % len(names)).cast("int")
    drawn, following = F.get(pool_col, at), F.get(pool_col, (at + 1) % len(names))
    other = F.when(F.lower(drawn) == F.lower("given_name"), following).otherwise(drawn)
    years = (draw("record_id", f"{seed}:gap") % 10 + 1).cast("int")
    gap = F.when(draw("record_id", f"{seed}:sign") % 2 == 0, years).otherwise(-years)
    gap = F.when(F.col("__kind") == "jr_sr", (draw("record_id", f"{seed}:age") % 16 + 20).cast("int")).when(F.col("__kind") == "sibling", gap).otherwise(0)
    rows = materialize(hit.withColumn("__kind", kind), "household")
    shifted = F.when(F.col("__kind") == "twin", F.col("dob")).otherwise(F.coalesce(dates.shift_years(F.col("dob"), gap), F.col("dob")))
    new = {
        "record_id": F.concat("record_id", F.lit("#hh1")),
        "entity_id": F.concat(F.coalesce("entity_id", "record_id"), F.lit("#hh1")),
        "given_name": F.when(F.col("__kind") == "jr_sr", F.col("given_name")).otherwise(other),
        "dob": shifted,
    }
    if suffix:
        new["name_suffix"] = F.when(F.col("__kind") == "jr_sr", F.lit("JR")).otherwise(F.col("name_suffix"))
    out = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])
    cells = [F.struct(F.lit("__kind__").alias("field"), F.lit(None).cast("string").alias("before"), F.col("__kind").alias("after"))]
    cells += [F.struct(F.lit(c).alias("field"), F.col(c).alias("before"), new[c].alias("after")) for c in ("given_name", "dob")]
    log = rows.select(F.concat("record_id", F.lit("#hh1")).alias("record_id"), F.explode(F.array(*cells)).alias("x"))
    log = log.where(~F.col("x.before").eqNullSafe(F.col("x.after"))).select("record_id", F.lit("household").alias("channel"), "x.field", "x.before", "x.after")
    return out, log


def originals_with_duplicates(corpus: DataFrame, fields: list[str]) -> DataFrame:
    """Duplicates beside their originals as an aligned table (record_id, <field>_a, <field>_b)."""
    root = F.regexp_replace("record_id", r"#dup\d+$", "")
    dups = corpus.where(F.col("record_id").rlike(r"#dup\d+$")).select("record_id", root.alias("root"), *[F.col(f).alias(f"{f}_b") for f in fields])
    clean = corpus.where(~F.col("record_id").rlike(r"#dup\d+$")).select(F.col("record_id").alias("root"), *[F.col(f).alias(f"{f}_a") for f in fields])
    return dups.join(clean, "root").select("record_id", *[f"{f}_{s}" for f in fields for s in "ab"])
