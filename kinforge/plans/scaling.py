"""Samples, splits, ladders, tails, costs, linkage and churn."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.operators import blocking, blockpairs, cluster, linkage, metrics, sampling, scale
from kinforge.plans.common import BASE, CLUSTERS, FIELDS, PAIRS, SCORES, THRESHOLD, _soundex, clustered, closure_sql, people, r6, scored_pairs, with_sql
from kinforge.plans.registry import query
from kinforge.session import materialize, table


def _order_sql(salt: str) -> str:
    return f"""sizes AS (SELECT entity_id, count(*) AS n, md5('{salt}|' || entity_id) AS h FROM persons GROUP BY 1),
units AS (SELECT entity_id, n, coalesce(sum(n) OVER (ORDER BY h, entity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes)"""


@query("entity_subsample", with_sql(*BASE, _order_sql("sub1"), select="SELECT record_id, entity_id FROM persons JOIN units USING (entity_id) WHERE before < 500"))
def entity_subsample(spark, sf_dir):
    return sampling.entity_complete_subsample(people(spark, sf_dir), 500, 1).select("record_id", "entity_id")


@query(
    "entity_ladder",
    with_sql(*BASE, _order_sql("ladder2"), select="SELECT rung, record_id FROM persons JOIN units USING (entity_id), (SELECT unnest([100, 400, 1600]) AS rung) WHERE before < rung"),
)
def entity_ladder(spark, sf_dir):
    return sampling.entity_ladder(people(spark, sf_dir), [100, 400, 1600], 2)


@query(
    "greedy_half",
    with_sql(*BASE, _order_sql("half3"), select="SELECT record_id, CASE WHEN before < (SELECT count(*) FROM persons) / 2 THEN 'train' ELSE 'eval' END AS side FROM persons JOIN units USING (entity_id)"),
)
def greedy_half(spark, sf_dir):
    return sampling.greedy_half(people(spark, sf_dir), "entity_id", 3).select("record_id", "side")


def _split_sql(name: str, unit: str) -> str:
    return f"SELECT record_id, entity_id, '{name}' AS split, CASE WHEN ('0x' || substr(md5({unit} || '|split4:{name}'), 1, 8))::BIGINT % 2 = 0 THEN 'train' ELSE 'eval' END AS side FROM persons"


@query(
    "entity_disjoint_split",
    with_sql(
        *BASE,
        select=f"""SELECT split, count(*) AS n_units, count(*) FILTER (sides > 1) AS n_straddling FROM (
  SELECT split, entity_id, count(DISTINCT side) AS sides FROM ({_split_sql("random", "record_id")} UNION ALL {_split_sql("entity", "entity_id")}) GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def entity_disjoint_split(spark, sf_dir):
    rows = people(spark, sf_dir)
    return sampling.split_checks(sampling.build_splits(rows, {"random": None, "entity": "entity_id"}, 4), rows)


@query(
    "scaling_fit",
    """WITH g AS (SELECT o_custkey, count(*)::DOUBLE AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1)
SELECT round(regr_slope(ln(y), ln(x)), 6) AS slope, round(regr_intercept(ln(y), ln(x)), 6) AS intercept, round(regr_r2(ln(y), ln(x)), 6) AS r2, count(*) AS n FROM g""",
)
def scaling_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("x"), F.sum("o_totalprice").alias("y"))
    fit = scale.fit_scaling(rows)
    return spark.createDataFrame([(round(fit.slope, 6), round(fit.intercept, 6), round(fit.r2, 6), fit.n)], "slope double, intercept double, r2 double, n long")


@query("scaling_prediction")
def scaling_prediction(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("x"), F.sum("o_totalprice").alias("y"))
    fit = scale.fit_scaling(rows)
    return spark.createDataFrame([(float(x), *fit.predict(x)) for x in (10.0, 100.0, 1000.0)], "x double, value double, lo double, hi double")


@query("gpd_tail")
def gpd_tail(spark, sf_dir):
    fits = scale.fit_gpd_tail(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("score")))
    cols = ("quantile", "threshold", "n", "xi", "scale", "qq_r2", "rate")
    return spark.createDataFrame([tuple(f[c] for c in cols) for f in fits], "quantile double, threshold double, n long, xi double, scale double, qq_r2 double, rate double")


@query(
    "mean_excess",
    "SELECT t AS threshold, count(*) AS n, round(avg(o_totalprice - t), 4) AS mean_excess FROM orders, (SELECT unnest([100000.0::DOUBLE, 200000.0::DOUBLE, 300000.0::DOUBLE]) AS t) WHERE o_totalprice > t GROUP BY 1",
)
def mean_excess(spark, sf_dir):
    out = scale.mean_excess(table(spark, sf_dir, "orders"), [100000.0, 200000.0, 300000.0], "o_totalprice")
    return out.select("threshold", "n", r6("mean_excess", 4).alias("mean_excess"))


@query(
    "cost_model",
    """WITH s AS (SELECT * FROM (VALUES ('serialise', 200000.0, 0.05, 0.0), ('encode', 20000.0, 2.5, 1e9 * 384 * 4 / 1e9), ('block', 50000.0, 0.05, 0.0), ('cluster', 100000.0, 0.05, 1e9 * 10 * 24 / 1e9)) v(stage, rate, price, gb))
SELECT stage, round((1e9 / rate / 3600)::DOUBLE, 6) AS hours, round((1e9 / rate / 3600 * price)::DOUBLE, 6) AS dollars, gb::DOUBLE AS gigabytes, 'EXTRAPOLATED' AS basis FROM s""",
)
def cost_model(spark, sf_dir):
    rates = {"serialise": 200_000.0, "encode": 20_000.0, "block": 50_000.0, "cluster": 100_000.0}
    out = scale.cost_breakdown(spark, 1_000_000_000, rates, {"gpu_h": 2.5, "core_h": 0.05})
    return out.select("stage", r6("hours").alias("hours"), r6("dollars").alias("dollars"), "gigabytes", "basis")


@query("name_shares", with_sql(*BASE, select="SELECT family_name AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM persons WHERE family_name IS NOT NULL GROUP BY 1"))
def name_shares(spark, sf_dir):
    return scale.shares(people(spark, sf_dir), F.col("family_name")).select("value", "n", r6("share").alias("share"))


@query(
    "soundex_shares",
    with_sql(*BASE, select=f"SELECT value, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM (SELECT {_soundex('family_name')} AS value FROM persons) GROUP BY 1"),
)
def soundex_shares(spark, sf_dir):
    return scale.soundex_shares(people(spark, sf_dir), "family_name").select("value", "n", r6("share").alias("share"))


@query(
    "zipf_slope",
    with_sql(
        *BASE,
        select="""SELECT round(regr_slope(log10(share), log10(rk)), 6) AS slope, count(*) AS n_values FROM (
  SELECT n / sum(n) OVER ()::DOUBLE AS share, row_number() OVER (ORDER BY n DESC) AS rk FROM (SELECT count(*) AS n FROM persons WHERE family_name IS NOT NULL GROUP BY family_name))""",
    ),
)
def zipf_slope(spark, sf_dir):
    return scale.zipf_slope(scale.shares(people(spark, sf_dir), F.col("family_name"))).select(r6("slope").alias("slope"), "n_values")


@query(
    "collision_mass",
    with_sql(
        *BASE,
        select="""SELECT round(sum(n * n - same) / (t * (t - 1))::DOUBLE, 9) AS mass FROM (
  SELECT given_name, family_name, sum(c) AS n, sum(c * c) AS same FROM (SELECT given_name, family_name, entity_id, count(*) AS c FROM persons GROUP BY ALL) GROUP BY 1, 2),
  (SELECT count(*) AS t FROM persons) GROUP BY t""",
    ),
)
def collision_mass(spark, sf_dir):
    return scale.collision_mass(people(spark, sf_dir), ["given_name", "family_name"]).select(r6("mass", 9).alias("mass"))


CROSS_SQL = """linked AS (SELECT a, b, prob FROM scored JOIN persons l ON a = l.record_id JOIN persons r ON b = r.record_id WHERE l.source <> r.source)"""


@query("linkage_cross_source", with_sql(*SCORES, CROSS_SQL, closure_sql(THRESHOLD, "clusters", "linked"), select="SELECT record_id, cluster FROM clusters"))
def linkage_cross_source(spark, sf_dir):
    rows = people(spark, sf_dir)
    linked = linkage.cross_source(materialize(scored_pairs(rows).select("a", "b", "prob"), "scored"), rows)
    return cluster.transitive_closure(linked, THRESHOLD, rows)


CHURN_SQL = """cells AS (SELECT c.cluster AS c0, d.cluster AS c1, count(*) AS n FROM clusters c JOIN later d USING (record_id) GROUP BY 1, 2),
state AS (SELECT c0, count(*) AS parts, min(c1) AS c1 FROM cells GROUP BY 1), merged AS (SELECT c1, count(*) AS sources FROM cells GROUP BY 1)
SELECT count(*) AS n_clusters_before, count(*) FILTER (parts = 1 AND sources = 1) AS n_intact, count(*) FILTER (parts > 1) AS n_split,
  count(*) FILTER (parts = 1 AND sources > 1) AS n_merged FROM state JOIN merged USING (c1)"""


@query("cluster_churn", with_sql(*CLUSTERS, closure_sql(0.85, "later"), select="").rstrip() + ",\n" + CHURN_SQL)
def cluster_churn(spark, sf_dir):
    rows = people(spark, sf_dir)
    scored, before = clustered(rows, 0.85)
    return linkage.churn(before, cluster.transitive_closure(scored, 0.85, rows))


#: Closure at a lower threshold only merges, so each old cluster overlaps one new cluster and the greedy choice is the largest.
CARRY_SQL = """cells AS (SELECT c.cluster AS c0, d.cluster AS c1, count(*) AS n FROM clusters c JOIN later d USING (record_id) GROUP BY 1, 2)
SELECT c1, c0 FROM (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY n DESC, c0) AS k FROM cells) WHERE k = 1"""


@query("carried_ids", with_sql(*CLUSTERS, closure_sql(0.85, "later"), select="").rstrip() + ",\n" + CARRY_SQL)
def carried_ids(spark, sf_dir):
    rows = people(spark, sf_dir)
    scored, before = clustered(rows, 0.85)
    return linkage.carry_ids(before, cluster.transitive_closure(scored, 0.85, rows))


def _old(c: str) -> str:
    return f"{c} LIKE '%-0'"


ATTACH_SQL = (
    f"known_scored AS (SELECT * FROM scored WHERE {_old('a')} AND {_old('b')})",
    closure_sql(THRESHOLD, "known", "known_scored"),
    f"""links AS (SELECT a, b, prob FROM scored WHERE prob >= {THRESHOLD} UNION ALL SELECT b, a, prob FROM scored WHERE prob >= {THRESHOLD}),
best AS (SELECT record_id, cluster FROM (SELECT a AS record_id, cluster, row_number() OVER (PARTITION BY a ORDER BY prob DESC, cluster DESC) AS k
  FROM links JOIN known ON b = record_id WHERE NOT {_old('a')} AND {_old('b')}) WHERE k = 1),
left_scored AS (SELECT * FROM scored WHERE NOT {_old('a')} AND NOT {_old('b')} AND a NOT IN (SELECT record_id FROM best) AND b NOT IN (SELECT record_id FROM best))""",
    closure_sql(THRESHOLD, "fresh", "left_scored"),
)
ATTACH_SELECT = f"""SELECT record_id, cluster FROM known WHERE {_old('record_id')} UNION ALL SELECT * FROM best
UNION ALL SELECT record_id, cluster FROM fresh WHERE NOT {_old('record_id')} AND record_id NOT IN (SELECT record_id FROM best)"""


@query("incremental_attach", with_sql(*SCORES, *ATTACH_SQL, select=ATTACH_SELECT))
def incremental_attach(spark, sf_dir):
    rows = people(spark, sf_dir)
    arrived = F.col("record_id").endswith("-0") == F.lit(False)
    old, new = rows.where(~arrived), rows.where(arrived)
    links = materialize(blockpairs.best_links(rows, FIELDS, THRESHOLD, arrived), "links")
    clusters = materialize(cluster.transitive_closure(links.where("kind = 0"), THRESHOLD, old), "clusters")
    best = links.where("kind = 1").select("a", "b", "prob")
    # arrivals without an old neighbour link among themselves
    left = new.join(best.select(F.col("a").alias("record_id")), "record_id", "left_anti")
    inner = materialize(blockpairs.scored_forest(left, FIELDS, THRESHOLD), "inner")
    return linkage.attach(clusters, new, best.unionByName(inner), THRESHOLD)


COMPLETENESS_SQL = """truth AS (SELECT l.record_id AS a, r.record_id AS b FROM persons l JOIN persons r ON l.entity_id = r.entity_id AND l.record_id < r.record_id),
total AS (SELECT count(*) AS n FROM persons)
SELECT p.keys, count(*) AS n_candidates, (SELECT count(*) FROM truth) AS n_true, count(t.a) AS n_found, round(count(t.a) / (SELECT count(*) FROM truth)::DOUBLE, 6) AS pair_completeness,
  round(1.0::DOUBLE - count(*) / (any_value(n) * (any_value(n) - 1) // 2)::DOUBLE, 6) AS reduction_ratio
FROM (SELECT DISTINCT a, b, ['soundex(family_name)+year(dob)', 'zip+initial(given_name)', 'phone'][pass + 1] AS keys FROM pass_pairs) p LEFT JOIN truth t USING (a, b), total GROUP BY p.keys"""


@query("pass_completeness", with_sql(*PAIRS, select="").rstrip() + ",\n" + COMPLETENESS_SQL)
def pass_completeness(spark, sf_dir):
    """Completeness of each match-key pass alone."""
    rows = people(spark, sf_dir)
    out = None
    for keys in blocking.default_passes(rows.columns):
        part = metrics.blocking_metrics(blocking.candidates(rows, [keys]), rows).withColumn("keys", F.lit("+".join(keys)))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({c: r6(c) for c in ("pair_completeness", "reduction_ratio")})
