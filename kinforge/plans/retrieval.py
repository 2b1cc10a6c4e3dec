"""Text and vector retrieval, mined negatives, embedding geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinforge.functions.strings import jaro_winkler
from kinforge.operators import ann, geometry, metrics, mining, probes, sparse
from kinforge.plans.common import BASE, people, r6, with_sql
from kinforge.plans.registry import query
from kinforge.session import materialize, table
from kinforge.sources.serialize import serialize

ROLES = ["given_name", "family_name", "street", "city"]


def _texts(spark, sf_dir):
    rows = people(spark, sf_dir)
    return rows, rows.select("record_id", serialize(rows, ROLES, "bare", "drop").alias("text"))


BM25_SQL = f"""texts AS (SELECT record_id AS rid, concat_ws(' ', {", ".join(f"nullif({r}, '')" for r in ROLES)}) AS text FROM persons),
words AS (SELECT rid, regexp_extract_all(lower(text), '\\w\\w+') AS ws FROM texts),
post AS (SELECT rid, token, len(ws) AS dl, count(*) AS tf FROM (SELECT rid, ws, unnest(ws) AS token FROM words) GROUP BY rid, token, len(ws)),
stats AS (SELECT (SELECT count(*) FROM texts)::DOUBLE AS n, (SELECT sum(len(ws)) FROM words) / (SELECT count(*) FROM texts)::DOUBLE AS mean),
dfs AS (SELECT token, count(*)::DOUBLE AS df FROM post GROUP BY 1),
docs AS (SELECT token, rid AS d, ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS w FROM post JOIN dfs USING (token), stats),
hits AS (SELECT p.rid AS q, d, round(sum(w), 9) AS score FROM post p JOIN docs USING (token) WHERE p.rid <> d GROUP BY 1, 2),
top AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INTEGER AS rank FROM hits)"""


@query("bm25_topk", with_sql(*BASE, BM25_SQL, select="SELECT q, d, round(score, 6) AS score, rank FROM top WHERE rank <= 5"))
def bm25_topk(spark, sf_dir):
    _, texts = _texts(spark, sf_dir)
    return sparse.neighbours(texts, 5).select("q", "d", r6("score").alias("score"), "rank")


@query("bm25_candidates", with_sql(*BASE, BM25_SQL, select="SELECT DISTINCT least(q, d) AS a, greatest(q, d) AS b FROM top WHERE rank <= 5"))
def bm25_candidates(spark, sf_dir):
    return sparse.candidates(_texts(spark, sf_dir)[1], 5)


@query("hard_negatives", with_sql(*BASE, BM25_SQL, select="SELECT q AS anchor_id, d AS neg_id, rank FROM top WHERE rank <= 3"))
def hard_negatives(spark, sf_dir):
    return mining.bm25_hard_negatives(_texts(spark, sf_dir)[1], 3)


CONT_SQL = """SELECT round(avg((l.entity_id = r.entity_id)::INTEGER), 6) AS contamination, count(*) AS n
FROM top JOIN persons l ON q = l.record_id JOIN persons r ON d = r.record_id WHERE rank <= 3"""


@query("fn_contamination", with_sql(*BASE, BM25_SQL, select=CONT_SQL))
def fn_contamination(spark, sf_dir):
    rows, texts = _texts(spark, sf_dir)
    out = mining.fn_contamination(mining.bm25_hard_negatives(texts, 3), rows)
    return out.select(r6("contamination").alias("contamination"), "n")


@query(
    "cluster_aware_filter",
    with_sql(*BASE, BM25_SQL, select="SELECT q AS anchor_id, d AS neg_id, rank FROM top JOIN persons l ON q = l.record_id JOIN persons r ON d = r.record_id WHERE rank <= 3 AND l.entity_id <> r.entity_id"),
)
def cluster_aware_filter(spark, sf_dir):
    rows, texts = _texts(spark, sf_dir)
    return mining.cluster_aware_filter(mining.bm25_hard_negatives(texts, 3), rows)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


UNIT_SQL = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sims AS (SELECT l.vec_id AS q, r.vec_id AS d, l.label AS lq, r.label AS ld, round(list_cosine_similarity(l.v, r.v), 9) AS score FROM unit l JOIN unit r ON l.vec_id <> r.vec_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INTEGER AS rank FROM sims)"""


@query("knn_exact_topk", f"WITH {UNIT_SQL} SELECT q, d, round(score, 6) AS score, rank FROM knn WHERE rank <= 10")
def knn_exact_topk(spark, sf_dir):
    return ann.neighbours(_vectors(spark, sf_dir), 10, "vec_id").select("q", "d", r6("score").alias("score"), "rank")


@query("knn_candidates", f"WITH {UNIT_SQL} SELECT DISTINCT least(q::VARCHAR, d::VARCHAR) AS a, greatest(q::VARCHAR, d::VARCHAR) AS b FROM knn WHERE rank <= 5")
def knn_candidates(spark, sf_dir):
    return ann.candidates(_vectors(spark, sf_dir), 5, rid="vec_id")


@query("knn_ivf_topk")
def knn_ivf_topk(spark, sf_dir):
    return ann.ivf_neighbours(_vectors(spark, sf_dir), 10, "vec_id", lists=8, probes=4)


@query(
    "hubness",
    f"""WITH {UNIT_SQL}, occ AS (SELECT vec_id, count(k.q) AS c FROM unit LEFT JOIN (SELECT * FROM knn WHERE rank <= 10) k ON d = vec_id GROUP BY 1),
m AS (SELECT avg(c) AS mu, stddev_pop(c) AS sd FROM occ)
SELECT round(avg(pow((c - mu) / sd, 3)), 6) AS skewness, max(c) AS max_count, count(*) AS n FROM occ, m""",
)
def hubness(spark, sf_dir):
    return geometry.hubness(_vectors(spark, sf_dir), 10, "vec_id").select(r6("skewness").alias("skewness"), "max_count", "n")


def _label_pairs(spark, sf_dir):
    """Neighbouring ids of one label: a linear number of positive pairs."""
    from pyspark.sql import Window

    nxt = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    return _vectors(spark, sf_dir).select(F.col("vec_id").alias("a"), nxt.alias("b")).dropna()


POS_SQL = """pos AS (SELECT vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"""


@query("alignment", f"WITH {UNIT_SQL}, {POS_SQL} SELECT round(avg(2.0::DOUBLE - 2.0::DOUBLE * list_cosine_similarity(x.v, y.v)), 6) AS alignment FROM pos JOIN unit x ON a = x.vec_id JOIN unit y ON b = y.vec_id")
def alignment(spark, sf_dir):
    out = geometry.alignment(geometry.pair_cosines(_label_pairs(spark, sf_dir), _vectors(spark, sf_dir), "vec_id"))
    return out.select(r6("alignment").alias("alignment"))


@query("uniformity", f"WITH {UNIT_SQL}, {POS_SQL} SELECT round(ln(avg(exp(-2.0::DOUBLE * (2.0::DOUBLE - 2.0::DOUBLE * list_cosine_similarity(x.v, y.v))))), 6) AS uniformity FROM pos JOIN unit x ON a = x.vec_id JOIN unit y ON b = y.vec_id")
def uniformity(spark, sf_dir):
    out = geometry.uniformity(geometry.pair_cosines(_label_pairs(spark, sf_dir), _vectors(spark, sf_dir), "vec_id"))
    return out.select(r6("uniformity").alias("uniformity"))


@query("pair_cosines", f"WITH {UNIT_SQL}, {POS_SQL} SELECT a, b, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM pos JOIN unit x ON a = x.vec_id JOIN unit y ON b = y.vec_id")
def pair_cosines(spark, sf_dir):
    out = geometry.pair_cosines(_label_pairs(spark, sf_dir), _vectors(spark, sf_dir), "vec_id")
    return out.select("a", "b", r6("cosine").alias("cosine"))


@query("rankme")
def rankme(spark, sf_dir):
    return spark.createDataFrame([(geometry.rankme(_vectors(spark, sf_dir)),)], "rankme double")


#: Coarser copies of the unit vectors.
KINDS_SQL = """normal AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM unit),
coarse AS (SELECT vec_id, 'fp32' AS kind, list_transform(v, lambda x: x::FLOAT::DOUBLE) AS v FROM normal
  UNION ALL SELECT vec_id, 'int8', list_transform(v, lambda x: round(x / list_max(list_transform(v, lambda y: abs(y))) * 127) * list_max(list_transform(v, lambda y: abs(y))) / 127) FROM normal
  UNION ALL SELECT vec_id, 'binary', list_transform(v, lambda x: CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) FROM normal)"""


@query(
    "quantised_cosines",
    f"WITH {UNIT_SQL}, {POS_SQL}, {KINDS_SQL} SELECT a, b, x.kind, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM pos JOIN coarse x ON a = x.vec_id JOIN coarse y ON b = y.vec_id AND x.kind = y.kind",
)
def quantised_cosines(spark, sf_dir):
    out = None
    for kind in ("fp32", "int8", "binary"):
        part = geometry.pair_cosines(_label_pairs(spark, sf_dir), geometry.quantise(_vectors(spark, sf_dir), kind), "vec_id").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("cosine", r6("cosine"))


@query("probe_battery")
def probe_battery(spark, sf_dir):
    rows = people(spark, sf_dir)
    probe = probes.build_probe_set(rows, lambda df: serialize(df, ["given_name", "family_name", "dob"], "bare", "drop"), n_per_slice=100)
    return probes.battery_report(probe, lambda c: geometry.hashed_ngram_encoder(c, 128))


@query("encoder_candidates")
def encoder_candidates(spark, sf_dir):
    _, texts = _texts(spark, sf_dir)
    return ann.candidates(materialize(geometry.encode(texts, "text", 128), "vectors"), 5)


FRONTIER_SQL = """truth AS (SELECT l.record_id AS a, r.record_id AS b FROM persons l JOIN persons r ON l.entity_id = r.entity_id AND l.record_id < r.record_id),
cut AS (SELECT DISTINCT k, least(q, d) AS a, greatest(q, d) AS b FROM top JOIN (SELECT unnest([1, 2, 5, 10]) AS k) ON rank <= k), total AS (SELECT count(*) AS n FROM persons)
SELECT k, count(*) AS n_candidates, (SELECT count(*) FROM truth) AS n_true, count(t.a) AS n_found, round(count(t.a) / (SELECT count(*) FROM truth)::DOUBLE, 6) AS pair_completeness,
  round(1.0::DOUBLE - count(*) / (any_value(n) * (any_value(n) - 1) // 2)::DOUBLE, 6) AS reduction_ratio FROM cut LEFT JOIN truth t USING (a, b), total GROUP BY k"""


@query("frontier_completeness", with_sql(*BASE, BM25_SQL, select="").rstrip() + ",\n" + FRONTIER_SQL)
def frontier_completeness(spark, sf_dir):
    """Pair completeness of BM25 at matched budgets."""
    rows, texts = _texts(spark, sf_dir)
    out = metrics.budget_metrics(sparse.neighbours(texts, 10), rows, [1, 2, 5, 10])
    return out.withColumns({c: r6(c) for c in ("pair_completeness", "reduction_ratio")})


RERANK_SQL = """rescored AS (SELECT q, d, rank AS old_rank, round(jaro_winkler_similarity(l.family_name, r.family_name), 9) AS jw
  FROM top JOIN persons l ON q = l.record_id JOIN persons r ON d = r.record_id WHERE rank <= 10)
SELECT q, d, old_rank, round(jw, 6) AS jw, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY jw DESC NULLS LAST, d)::INTEGER AS rank FROM rescored) WHERE rank <= 4"""


@query("reranked_topk", with_sql(*BASE, BM25_SQL, select="").rstrip() + ",\n" + RERANK_SQL)
def reranked_topk(spark, sf_dir):
    """The ten BM25 neighbours put in the order of their family names' similarity; four stay."""
    rows, texts = _texts(spark, sf_dir)
    top = sparse.neighbours(texts, 10).select("q", "d", F.col("rank").alias("old_rank"))
    names = [rows.select(F.col("record_id").alias(side), F.col("family_name").alias(f"f_{side}")) for side in ("q", "d")]
    scored = top.join(names[0], "q").join(names[1], "d").withColumn("jw", F.round(jaro_winkler(F.col("f_q"), F.col("f_d")), 9))
    return mining.rerank(scored, 4, "jw").select("q", "d", "old_rank", r6("jw").alias("jw"), "rank")
