"""BM25 neighbours from blocks of rare tokens, against all pairs and against tiles."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinforge.operators import metrics, sparse


def texts_of(spark, seed, n=400):
    """Names, streets, numbers and towns of uneven shares; copies, null texts, texts without words and words of one text."""
    r = random.Random(seed)
    words = [[f"{kind}{min(int(r.paretovariate(1.1)), m)}" for _ in range(n)] for kind, m in (("given", 9), ("family", 20), ("street", 6), ("town", 12))]
    rows = []
    for i in range(n):
        text = " ".join([*(w[i] for w in words), f"n{r.randrange(100, 130)}", *(["given1"] if i % 9 == 0 else []), *([f"only{i}"] if i % 50 == 0 else [])])
        rows.append((f"r{i:04d}", None if i % 97 == 0 else "a ?" if i % 89 == 0 else rows[-1][1] if i % 7 == 0 else text))
    return spark.createDataFrame(rows, "record_id string, text string")


def brute(texts, k):
    rows = {r["record_id"]: Counter(w for w in (r["text"] or "").split() if len(w) > 1) for r in texts.collect()}
    n, mean = len(rows), sum(sum(c.values()) for c in rows.values()) / len(rows)
    df = Counter(t for c in rows.values() for t in c)
    weight = {
        d: {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, tf in c.items()} for d, c in rows.items()
    }
    out = []
    for q, c in rows.items():
        hits = sorted((-round(sum(weight[d][t] for t in c if t in weight[d]), 9), d) for d in rows if d != q and set(c) & set(rows[d]))
        out += [(q, d, rank, round(-s, 6)) for rank, (s, d) in enumerate(hits[:k], 1)]
    return sorted(out)


def found(texts, k, **options):
    return sorted((r["q"], r["d"], r["rank"], round(r["score"], 6)) for r in sparse.neighbours(texts, k, **options).collect())


@pytest.mark.parametrize(("seed", "k", "share", "sizes"), [(1, 5, 1, (1 << 15, 1 << 14, 4096)), (2, 3, 4, (50, 40, 60)), (3, 10, 400, (90, 70, 8))])
def test_blocks_equal_all_pairs(spark, monkeypatch, seed, k, share, sizes):
    texts = texts_of(spark, seed).repartition(3).cache()
    asked, tiles = [], sparse._by_tiles
    monkeypatch.setattr(sparse, "BLOCKS_FROM", 0)
    monkeypatch.setattr(sparse, "TILED_SHARE", share)
    for name, size in zip(("TILE_ROWS", "QUERY_ROWS", "BLOCK_ROWS"), sizes, strict=True):
        monkeypatch.setattr(sparse, name, size)
    monkeypatch.setattr(sparse, "_by_tiles", lambda asks, rows, n_asks, *rest: asked.append(n_asks) or tiles(asks, rows, n_asks, *rest))
    want = brute(texts, k)
    assert found(texts, k) == want
    assert found(texts, k, drop_zero=False) == want
    assert (sum(asked) < 2 * 40) == (share < 400)  # all 400 met all tiles before


def test_blocks_leave_out_frequent_words(spark, monkeypatch):
    texts = texts_of(spark, 4).cache()
    want = found(texts, 4, max_df=60)
    monkeypatch.setattr(sparse, "BLOCKS_FROM", 0)
    assert found(texts, 4, max_df=60) == want and want


def test_blocks_of_no_and_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCKS_FROM", -1)
    none = spark.createDataFrame([], "record_id string, text string")
    assert found(none, 3) == [] and found(spark.createDataFrame([("x", "some words")], "record_id string, text string"), 3) == []


def test_budgets_equal_blocking_metrics_of_each(spark):
    r = random.Random(6)
    ids = [f"r{i:02d}" for i in range(40)]
    truth = spark.createDataFrame([(i, None if n == 5 else f"e{n // 3}") for n, i in enumerate(ids)], "record_id string, entity_id string")
    ranked = spark.createDataFrame([(q, d, rank) for q in ids for rank, d in enumerate(r.sample(ids, 6), 1)], "q string, d string, rank int")
    got = {row["k"]: tuple(row)[:5] for row in metrics.budget_metrics(ranked, truth, [1, 3, 6]).collect()}  # each budget was joined by itself before
    for k in (1, 3, 6):
        pairs = ranked.where(F.col("rank") <= k).select(F.col("q").alias("a"), F.col("d").alias("b"))
        assert got[k] == tuple(metrics.blocking_metrics(pairs, truth).first())
