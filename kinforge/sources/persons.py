"""The ``persons`` relation: person records with known entities.

Derived from ``customer`` and ``nation`` by hashed draws only, once as Spark
columns and once as DuckDB SQL, so that every record-linkage operator has full
truth and an exact oracle. A customer is an entity with one to four records; the
later ones carry one edit each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions.draws import draw, pick, sql_draw
from kinforge.session import table

GIVEN = (
    "Martha Duane Alice Robert Carmen Peter Ingrid Thomas Elena Victor Sophie Walter "
    "Nadia Oscar Judith Marcus Helen Simon Teresa Felix Diana Bruno Clara Henry"
).split()
FAMILY = (
    "Smith Johnson Garcia Miller Davis Lopez Wilson Anderson Taylor Moore Jackson Martin "
    "Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen "
    "Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Gomez Phillips"
).split()
STREETS = "Oak Street|Maple Avenue|Pine Road|Cedar Lane|Elm Drive|Lake Court|Hill Street|Park Avenue|Mill Road|River Lane|Church Drive|Main Street".split("|")
COLUMNS = "record_id entity_id given_name family_name dob sex street city zip phone email source".split()


def _skewed(key, salt: str, n: int):
    """Index with a long tail: the square of a uniform draw."""
    u = draw(key, salt) % 1000
    return F.floor(u * u * n / F.lit(1_000_000)).cast("int")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records; all columns are strings."""
    k = F.col("c_custkey").cast("string")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    n = draw(k, "n") % 8
    copies = F.when(n < 4, 0).when(n < 6, 1).when(n < 7, 2).otherwise(3)
    birth = F.when(draw(k, "h") % 50 == 0, F.lit("1900-01-01")).otherwise(
        F.date_format(F.date_add(F.to_date(F.lit("1940-01-01")), (draw(k, "d") % 25000).cast("int")), "yyyy-MM-dd")
    )
    base = base.select(
        k.alias("k"),
        F.element_at(F.array(*map(F.lit, GIVEN)), _skewed(k, "g", len(GIVEN)) + 1).alias("given"),
        F.element_at(F.array(*map(F.lit, FAMILY)), _skewed(k, "f", len(FAMILY)) + 1).alias("family"),
        birth.alias("birth"),
        F.when(draw(k, "s") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.concat((draw(k, "hn") % 900 + 100).cast("string"), F.lit(" "), pick(STREETS, draw(k, "st"))).alias("street"),
        F.initcap(F.col("n_name")).alias("city"),
        (10000 + draw(k, "z") % 97).cast("string").alias("zip"),
        F.when(draw(k, "pn") % 6 != 0, F.concat(F.lit("555"), F.lpad((draw(k, "p") % 10_000_000).cast("string"), 7, "0"))).alias("phone"),
        F.explode(F.sequence(F.lit(0), copies)).alias("d"),
    )
    rid = F.concat(F.lit("r"), "k", F.lit("-"), F.col("d").cast("string"))
    edit = F.when(F.col("d") > 0, draw(rid, "e") % 8).otherwise(F.lit(-1))
    g, f, b = F.col("given"), F.col("family"), F.col("birth")
    cut = F.concat(F.substring(g, 1, 1), F.expr("substring(given, 3, 100)"))
    swap = F.concat(F.substring(f, 1, 1), F.substring(f, 3, 1), F.substring(f, 2, 1), F.expr("substring(family, 4, 100)"))
    us = F.concat(F.substring(b, 6, 2), F.lit("/"), F.substring(b, 9, 2), F.lit("/"), F.substring(b, 1, 4))
    out = base.withColumns({"record_id": rid, "e": edit})
    e = F.col("e")
    return out.select(
        "record_id",
        F.concat(F.lit("e"), "k").alias("entity_id"),
        F.when(e == 0, cut).when(e == 7, f).otherwise(g).alias("given_name"),
        F.when(e == 1, swap).when(e == 7, g).otherwise(f).alias("family_name"),
        F.when(e == 3, F.lit(None)).when(e == 6, us).otherwise(b).alias("dob"),
        "sex",
        "street",
        "city",
        F.when(e != 4, F.col("zip")).alias("zip"),
        F.when(e != 5, F.col("phone")).alias("phone"),
        F.when(e != 2, F.concat(F.lower(g), F.lit("."), F.lower(f), (draw(F.col("k"), "em") % 100).cast("string"), F.lit("@mail.example.com"))).alias("email"),
        F.concat(F.lit("s"), (draw(F.col("record_id"), "src") % 2).cast("string")).alias("source"),
    )


def _pool(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_skewed(salt: str, n: int) -> str:
    u = f"({sql_draw('k', salt)} % 1000)"
    return f"({u} * {u} * {n} // 1000000)::INTEGER + 1"


#: DuckDB text of the relation, to stand in a WITH clause.
PERSONS_SQL = f"""
person_base AS (
  SELECT *, unnest(range(0, CASE WHEN n < 4 THEN 1 WHEN n < 6 THEN 2 WHEN n < 7 THEN 3 ELSE 4 END)) AS d FROM (
    SELECT k, {sql_draw("k", "n")} % 8 AS n,
      ({_pool(GIVEN)})[{_sql_skewed("g", len(GIVEN))}] AS given,
      ({_pool(FAMILY)})[{_sql_skewed("f", len(FAMILY))}] AS family,
      CASE WHEN {sql_draw("k", "h")} % 50 = 0 THEN '1900-01-01'
           ELSE strftime(DATE '1940-01-01' + ({sql_draw("k", "d")} % 25000)::INTEGER, '%Y-%m-%d') END AS birth,
      CASE WHEN {sql_draw("k", "s")} % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
      ({sql_draw("k", "hn")} % 900 + 100)::VARCHAR || ' ' || ({_pool(STREETS)})[({sql_draw("k", "st")} % {len(STREETS)} + 1)::INTEGER] AS street,
      array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS city,
      (10000 + {sql_draw("k", "z")} % 97)::VARCHAR AS zip,
      CASE WHEN {sql_draw("k", "pn")} % 6 <> 0 THEN '555' || lpad(({sql_draw("k", "p")} % 10000000)::VARCHAR, 7, '0') END AS phone
    FROM (SELECT c_custkey::VARCHAR AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))),
person_edit AS (
  SELECT *, 'r' || k || '-' || d::VARCHAR AS record_id,
    CASE WHEN d > 0 THEN {sql_draw("('r' || k || '-' || d::VARCHAR)", "e")} % 8 ELSE -1 END AS e
  FROM person_base),
persons AS (
  SELECT record_id, 'e' || k AS entity_id,
    CASE e WHEN 0 THEN given[1] || given[3:] WHEN 7 THEN family ELSE given END AS given_name,
    CASE e WHEN 1 THEN family[1] || family[3] || family[2] || family[4:] WHEN 7 THEN given ELSE family END AS family_name,
    CASE e WHEN 3 THEN NULL WHEN 6 THEN birth[6:7] || '/' || birth[9:10] || '/' || birth[1:4] ELSE birth END AS dob,
    sex, street, city,
    CASE WHEN e <> 4 THEN zip END AS zip,
    CASE WHEN e <> 5 THEN phone END AS phone,
    CASE WHEN e <> 2 THEN lower(given) || '.' || lower(family) || ({sql_draw("k", "em")} % 100)::VARCHAR || '@mail.example.com' END AS email,
    's' || ({sql_draw("record_id", "src")} % 2)::VARCHAR AS source
  FROM person_edit)"""
