"""Shared relations of the queries, and their SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators import blockpairs, cluster
from kinforge.session import materialize, stamp, table
from kinforge.sources.persons import PERSONS_SQL, persons

FIELDS = ["given_name", "family_name", "dob"]
THRESHOLD = 0.9


def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


_people: dict[tuple[str, str, tuple], DataFrame] = {}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persons relation, written once a session and state of its inputs: self joins read it, not its long derivation."""
    at = (spark.sparkContext.applicationId, sf_dir, stamp(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")))
    if at not in _people:
        _people[at] = materialize(persons(spark, sf_dir), "persons")
    return _people[at]


def scored_pairs(people_: DataFrame) -> DataFrame:
    """Default match-key pairs with their mean Jaro-Winkler score."""
    return blockpairs.scored_rows(people_, FIELDS, parts=True)


def clustered(people_: DataFrame, *more: float) -> tuple[DataFrame, DataFrame]:
    """(pairs that connect what all scored pairs connect at the default threshold and at ``more``, closure at the default)."""
    scored = materialize(blockpairs.scored_forest(people_, FIELDS, THRESHOLD, *more), "forest")
    return scored, cluster.transitive_closure(scored, THRESHOLD, people_)


def _soundex(v: str) -> str:
    """DuckDB text of soundex for names of the letters A-Z."""
    code = f"translate(upper(trim({v})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"
    seq = f"({code})[1] || replace(({code})[2:], '7', '')"
    for d in "0123456":
        seq = f"regexp_replace({seq}, '{d}+', '{d}', 'g')"
    return f"rpad(upper(trim({v}))[1] || replace(({seq})[2:], '0', ''), 4, '0')[1:4]"


KEYS_SQL = f"""
keys AS (SELECT record_id, {_soundex("family_name")} AS sx, nullif(regexp_extract(dob, '(\\d{{4}})', 1), '') AS yr,
  upper(trim(given_name)[1]) AS gi, zip, phone FROM persons),
pass_pairs AS (
  SELECT 0 AS pass, l.record_id AS a, r.record_id AS b FROM keys l JOIN keys r ON l.sx = r.sx AND l.yr = r.yr AND l.record_id < r.record_id
  UNION ALL SELECT 1, l.record_id, r.record_id FROM keys l JOIN keys r ON l.zip = r.zip AND l.gi = r.gi AND l.record_id < r.record_id
  UNION ALL SELECT 2, l.record_id, r.record_id FROM keys l JOIN keys r ON l.phone = r.phone AND l.record_id < r.record_id),
pairs AS (SELECT DISTINCT a, b FROM pass_pairs)"""

SCORED_SQL = """
parts AS (SELECT a, b,
    jaro_winkler_similarity(l.given_name, r.given_name) AS jw_given_name,
    jaro_winkler_similarity(l.family_name, r.family_name) AS jw_family_name,
    jaro_winkler_similarity(l.dob, r.dob) AS jw_dob
  FROM pairs JOIN persons l ON a = l.record_id JOIN persons r ON b = r.record_id),
scored AS (SELECT *, round(CASE WHEN jw_given_name IS NULL AND jw_family_name IS NULL AND jw_dob IS NULL THEN 0.0 ELSE
    (0.0 + coalesce(jw_given_name, 0.0) + coalesce(jw_family_name, 0.0) + coalesce(jw_dob, 0.0)) /
    (CASE WHEN jw_given_name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN jw_family_name IS NOT NULL THEN 1 ELSE 0 END
     + CASE WHEN jw_dob IS NOT NULL THEN 1 ELSE 0 END) END, 9) AS prob FROM parts)"""


def closure_sql(threshold: float, name: str = "clusters", scored: str = "scored") -> str:
    return f"""
{name}_edges AS (SELECT a AS x, b AS y FROM {scored} WHERE prob >= {threshold} UNION SELECT b, a FROM {scored} WHERE prob >= {threshold}),
{name}_reach AS (SELECT x, y FROM {name}_edges UNION SELECT r.x, e.y FROM {name}_reach r JOIN {name}_edges e ON r.y = e.x),
{name} AS (SELECT p.record_id, coalesce(least(p.record_id, m.low), p.record_id) AS cluster
  FROM persons p LEFT JOIN (SELECT x, min(y) AS low FROM {name}_reach GROUP BY x) m ON p.record_id = m.x)"""


CELLS_SQL = """
cells0 AS (SELECT cluster AS p, entity_id AS t, count(*) AS n FROM clusters JOIN persons USING (record_id) GROUP BY 1, 2),
cells AS (SELECT *, sum(n) OVER (PARTITION BY p)::BIGINT AS np, sum(n) OVER (PARTITION BY t)::BIGINT AS nt FROM cells0)"""


def with_sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


BASE = (PERSONS_SQL,)
PAIRS = (PERSONS_SQL, KEYS_SQL)
SCORES = (PERSONS_SQL, KEYS_SQL, SCORED_SQL)
CLUSTERS = (*SCORES, closure_sql(THRESHOLD))
CELLS = (*CLUSTERS, CELLS_SQL)
