"""BM25 text retrieval: postings and document lengths by joins, scores and top k within tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.session import materialize

K1, B = 1.5, 0.75
#: Texts and queries of a tile; each pair of tiles is one group.
TILE_ROWS, QUERY_ROWS = 1 << 15, 1 << 14
#: Texts up to which all tiles meet; rows of a block that rare tokens share; part of all rows from which a query meets all tiles; slack of bounds.
BLOCKS_FROM, BLOCK_ROWS, TILED_SHARE, SLACK = 1 << 18, 4096, 4, 4e-9
#: A query's tokens of the longest postings whose sums are kept for the queries after it.
SHARED = 3
WORD = r"(?U)\b\w\w+\b"


def postings(texts: DataFrame, rid: str = "record_id", text: str = "text") -> DataFrame:
    """(rid, token, tf, dl): words of two or more characters, lower case."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(rid).alias("rid"), words.alias("w"), F.size(words).alias("dl"))
    return rows.select("rid", "dl", F.explode("w").alias("token")).groupBy("rid", "token", "dl").agg(F.count("*").alias("tf"))


def neighbours(texts: DataFrame, k: int, rid: str = "record_id", text: str = "text", max_df: int | None = None, drop_zero: bool = True) -> DataFrame:
    """(q, d, score, rank): the k best other records of each record.

    score = sum over shared tokens of idf * tf * (k1+1) / (tf + k1*(1-b+b*dl/avgdl))
    with idf = ln(1 + (n - df + 0.5) / (df + 0.5)); ties by record id. Every text
    is a query; its distinct tokens count once. ``max_df`` leaves out tokens held
    by more records (None: exact); without ``drop_zero`` a non-positive score
    stays, as the miner of hard negatives wants it.
    """
    post = materialize(postings(texts, rid, text), "postings")
    n = texts.count()
    lengths = post.select("rid", "dl").distinct()
    # texts without any word count in the mean length with 0
    mean = (lengths.agg(F.sum("dl")).first()[0] or 0) / max(n, 1)
    tf = F.col("tf").cast("double")
    norm = tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(mean or 1.0))
    words = post.groupBy("token").agg(F.count("*").alias("df"), F.max(tf * (K1 + 1.0) / norm).alias("most"))
    if max_df is not None:
        words = words.where(F.col("df") <= max_df)
    idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = materialize(words.select("token", F.monotonically_increasing_id().alias("id"), "df", idf.alias("idf"), (idf * F.col("most")).alias("most")), "words")
    weight = F.col("idf") * (tf * (K1 + 1.0)) / norm
    entry = F.struct(F.col("id").alias("token"), weight.alias("w"), "df", "most")
    rows = materialize(post.join(words, "token").select("rid", entry.alias("e")).groupBy("rid").agg(F.sort_array(F.collect_list("e")).alias("ws")), "weights")
    found = _by_blocks(rows, n, k, drop_zero) if n > BLOCKS_FROM else _by_tiles(rows, rows, n, n, k, drop_zero)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_tiles(asks: DataFrame, rows: DataFrame, n_asks: int, n: int, k: int, drop_zero: bool) -> DataFrame:
    """(q, d, score): the k best of each tile of all rows for each of ``asks``."""
    tiles = max(1, -(-n // TILE_ROWS))
    q_tiles = max(-(-n_asks // QUERY_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n_asks // 1024)), 1)

    def tile(of: int) -> Column:
        return F.pmod(F.xxhash64("rid"), F.lit(of))

    def every(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))

    left = asks.select("rid", F.col("ws.token").alias("tokens"), tile(q_tiles).alias("qt")).withColumn("dt", every(tiles))
    right = rows.select("rid", F.col("ws.token").alias("tokens"), F.col("ws.w").alias("w"), tile(tiles).alias("dt")).withColumn("qt", every(q_tiles))
    kind = rows.schema["rid"].dataType.simpleString()
    return left.groupBy("qt", "dt").cogroup(right.groupBy("qt", "dt")).applyInArrow(_best_of_tiles(k, drop_zero), f"q {kind}, d {kind}, score double")


def _by_blocks(rows: DataFrame, n: int, k: int, drop_zero: bool) -> DataFrame:
    """(q, d, score) with the k best of all rows for each row.

    A query meets the holders of its rarest token that k others hold. What lacks
    that token has the sum of the other tokens' greatest weights at most: where
    this stays below the k-th score the query is done. Otherwise a better row may
    lack no more than the difference, so it holds each token that weighs more
    (the rarest of them leads to it), or at least one of the heaviest tokens
    whose rest stays below the k-th score. Queries for which these lead to much of
    the table meet all tiles.
    """
    often = F.filter("ws", lambda x: x["df"] > k)
    asks = rows.withColumn("key", F.array_min(F.transform(often, lambda x: F.struct(x["df"].alias("df"), x["token"].alias("token")))))
    first = materialize(_of_blocks(asks.where("key IS NOT NULL"), rows, _best_of_tiles(k, drop_zero)), "found")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    kth = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select(F.col("q").alias("rid"), F.col("score").alias("kth"))
    rest = F.array_sort(F.transform(F.filter("ws", lambda x: F.col("key").isNull() | (x["token"] != F.col("key.token"))), lambda x: F.struct(x["most"].alias("most"), x["df"].alias("df"), x["token"].alias("token"))))
    opened = asks.join(kth, "rid", "left").withColumn("rest", rest).withColumn("sum", F.aggregate("rest", F.lit(0.0), lambda s, x: s + x["most"]))
    opened = opened.where(F.col("kth").isNull() | (F.col("sum") >= F.col("kth") - SLACK))
    keyed = "array<struct<df:bigint,token:bigint>>"
    # the rest's weights upward: from the first token on whose sum with the lighter ones reaches the k-th score
    heavy = F.aggregate(
        "rest",
        F.struct(F.lit(0.0).alias("s"), F.array().cast(keyed).alias("keys")),
        lambda acc, x: F.struct(
            (acc["s"] + x["most"]).alias("s"),
            F.when(acc["s"] + x["most"] >= F.col("kth") - SLACK, F.concat(acc["keys"], F.array(F.struct(x["df"].alias("df"), x["token"].alias("token"))))).otherwise(acc["keys"]).alias("keys"),
        ),
        lambda acc: acc["keys"],
    )
    need = F.transform(F.filter("rest", lambda x: x["most"] > F.col("sum") - F.col("kth") + SLACK), lambda x: F.struct(x["df"].alias("df"), x["token"].alias("token")))
    opened = opened.withColumn("need", need).withColumn("keys", F.when(F.size("need") > 0, F.array(F.array_min("need"))).otherwise(heavy))
    cost = F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    opened = materialize(opened.withColumn("tiled", F.col("kth").isNull() | (cost > n // TILED_SHARE)).select("rid", "ws", "kth", "need", "keys", "tiled"), "open")
    more = opened.where("NOT tiled").withColumn("key", F.explode("keys"))
    found = first.unionByName(_of_blocks(more.withColumn("need", F.array_union(F.col("need.token"), F.array("key.token"))), rows, _better_of_blocks(k), ["need", "kth"]))
    n_tiled = opened.where("tiled").count()
    if n_tiled:
        found = found.unionByName(_by_tiles(opened.where("tiled"), rows, n_tiled, n, k, drop_zero))
    return found.repartition("q").groupBy("q", "d").agg(F.max("score").alias("score"))


def _of_blocks(asks: DataFrame, rows: DataFrame, run: object, more: list[str] | None = None) -> DataFrame:
    """What ``run`` gives for ``asks`` and the rows that hold their ``key``; rare keys share blocks, those of many rows are dealt into slices."""
    keys = asks.select("key.token", "key.df").distinct()
    rare = F.col("df") < BLOCK_ROWS // 4
    blocks = max(1, (keys.where(rare).agg(F.sum("df")).first()[0] or 0) // BLOCK_ROWS)

    def placed(df: DataFrame, size: Column) -> DataFrame:
        few = size < BLOCK_ROWS // 4
        return df.withColumns({
            "block": F.when(few, -1 - F.pmod(F.xxhash64("token"), F.lit(blocks))).otherwise(F.col("token")),
            "nq": F.when(few, 1).otherwise(F.ceil(size / QUERY_ROWS)).cast("long"), "nd": F.when(few, 1).otherwise(F.ceil(size / TILE_ROWS)).cast("long"),
        })

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    def own(of: str) -> Column:
        return F.pmod(F.xxhash64("rid"), F.col(of))

    left = placed(asks.select("rid", F.col("ws.token").alias("tokens"), *(more or []), "key.token", "key.df"), F.col("df"))
    left = left.select("rid", "tokens", *(more or []), "block", own("nq").alias("qs"), every("nd").alias("ds"))
    held = rows.select("rid", F.explode("ws.token").alias("token")).join(keys, "token")
    held = placed(held, F.col("df")).select("rid", "block", "nq", "nd").distinct()
    right = held.join(rows.select("rid", F.col("ws.token").alias("tokens"), F.col("ws.w").alias("w")), "rid")
    right = right.select("rid", "tokens", "w", "block", own("nd").alias("ds"), every("nq").alias("qs"))
    left, right = (side.toDF(*side.columns) for side in (left, right))  # columns of their own: both stem from ``rows``
    kind = rows.schema["rid"].dataType.simpleString()
    by = ["block", "qs", "ds"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"q {kind}, d {kind}, score double")


class _Postings:
    """Rows of a tile in the order of their ids, and its tokens' postings."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("rid").combine_chunks()
        order = pc.sort_indices(ids)  # ties go to the lesser id
        rows, self.ids = rows.take(order), ids.take(order)
        terms = rows.column("tokens").combine_chunks()
        coded = terms.flatten().dictionary_encode()
        token, weight = coded.indices.to_numpy(), rows.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        by = np.argsort(token, kind="stable")
        self.tokens = coded.dictionary
        self.ends = np.searchsorted(token[by], np.arange(len(coded.dictionary) + 1))
        self.doc, self.weight = doc[by], weight[by]

    def asked(self, lists: pa.ChunkedArray) -> list[np.ndarray]:
        """Numbers of each list's tokens, -1 for those that no row holds."""
        lists = lists.combine_chunks()
        which = pc.index_in(lists.flatten(), self.tokens).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.split(which, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1])


def _none(left: pa.Table, right: pa.Table) -> pa.Table:
    none = (left if left.num_rows else right).column("rid").slice(0, 0)
    return pa.table({"q": none, "d": none, "score": pa.array([], pa.float64())})


def _better_of_blocks(k: int):
    """For each query the k best rows that hold all the tokens it needs and reach the score it has."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none(left, right)
        post = _Postings(right)
        doc, weight, ends = post.doc, post.weight, post.ends
        qs = left.column("rid").combine_chunks()
        own = pc.index_in(qs, post.ids).fill_null(-1).to_numpy(zero_copy_only=False)
        asks, needs, floor = post.asked(left.column("tokens")), post.asked(left.column("need")), left.column("kth").to_numpy() - SLACK
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def places(t: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(doc[ends[t] : ends[t + 1]], among) + ends[t]
            return at, doc[np.minimum(at, ends[t + 1] - 1)] == among

        for i, need in enumerate(needs):
            if (need < 0).any():
                continue
            need = need[np.argsort(ends[need + 1] - ends[need], kind="stable")]
            near = doc[ends[need[0]] : ends[need[0] + 1]]
            for t in need[1:]:
                near = near[places(t, near)[1]]
            near = near[near != own[i]]
            if not len(near):
                continue
            score = np.zeros(len(near))
            for t in sorted(asks[i][asks[i] >= 0].tolist(), key=lambda t: ends[t] - ends[t + 1]):
                at, there = places(t, near)
                score[there] += weight[at[there]]
            best = np.rint(score * 1e9) / 1e9
            good = np.flatnonzero(best >= floor[i])
            good = good[np.argsort(-best[good], kind="stable")[:k]]
            out.append((np.full(len(good), i), near[good], best[good]))
        q, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"q": qs.take(pa.array(q)), "d": post.ids.take(pa.array(d)), "score": pa.array(s)})

    return run


def _best_of_tiles(k: int, drop_zero: bool):
    """The k best documents of one tile for each query of another, from postings of the tile."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _none(left, right)
        post = _Postings(right)
        qs, ds, doc, weight, ends = left.column("rid").combine_chunks(), post.ids, post.doc, post.weight, post.ends
        asks = [t[t >= 0] for t in post.asked(left.column("tokens"))]
        own = pc.index_in(qs, ds).fill_null(-1).to_numpy(zero_copy_only=False)
        out_q, out_d, out_s = [], [], []
        # longest postings first; queries that begin with the same ones follow each other and share their sums
        asks = [t[np.argsort(ends[t] - ends[t + 1], kind="stable")].tolist() for t in asks]
        sums, have = [np.zeros(len(ds)) for _ in range(SHARED + 1)], []
        score = np.zeros(len(ds))
        for i in sorted(range(len(qs)), key=lambda i: asks[i][:SHARED]):
            lead = asks[i][:SHARED]
            same = next((j for j, (t, u) in enumerate(zip(have, lead, strict=False)) if t != u), min(len(have), len(lead)))
            for j in range(same, len(lead)):
                sums[j + 1][:] = sums[j]
                _add(sums[j + 1], lead[j], doc, weight, ends)
            have = lead
            score[:] = sums[len(lead)]
            for t in asks[i][SHARED:]:
                _add(score, t, doc, weight, ends)
            rarest = next((t for t in reversed(asks[i]) if ends[t + 1] - ends[t] > k), -1)
            if own[i] >= 0:
                score[own[i]] = -np.inf
            bound = 0.0
            if rarest >= 0:  # k others hold this token, so the k best score no less than they
                some = score[doc[ends[rarest] : ends[rarest + 1]]]
                bound = np.partition(some, len(some) - k)[len(some) - k] - 2e-9
            near = np.flatnonzero(score >= bound) if bound > 0 else np.flatnonzero(score > 0) if drop_zero else _holders(asks[i], doc, ends, own[i])
            if len(near) > k:
                kth = np.partition(score[near], len(near) - k)[len(near) - k]
                near = near[score[near] >= kth - 2e-9]  # what may tie once rounded
            best = np.rint(score[near] * 1e9) / 1e9
            keep = np.argsort(-best, kind="stable")[:k]
            keep = keep[best[keep] > 0] if drop_zero else keep
            out_q.append(np.full(len(keep), i))
            out_d.append(near[keep])
            out_s.append(best[keep])
        q, d, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_d, out_s))
        return pa.table({"q": qs.take(pa.array(q.astype(np.int64))), "d": ds.take(pa.array(d.astype(np.int64))), "score": pa.array(s.astype(float))})

    return run


def _add(score: np.ndarray, token: int, doc: np.ndarray, weight: np.ndarray, ends: np.ndarray) -> None:
    score[doc[ends[token] : ends[token + 1]]] += weight[ends[token] : ends[token + 1]]


def _holders(tokens: list[int], doc: np.ndarray, ends: np.ndarray, own: int) -> np.ndarray:
    """Documents but ``own`` with any of the tokens."""
    found = np.unique(np.concatenate([np.zeros(0, doc.dtype), *[doc[ends[t] : ends[t + 1]] for t in tokens]]))
    return found[found != own]


def candidates(texts: DataFrame, k: int, **options: object) -> DataFrame:
    """Distinct pairs (a, b) of the retrieved neighbours."""
    top = neighbours(texts, k, **options)
    return top.select(F.least("q", "d").alias("a"), F.greatest("q", "d").alias("b")).distinct()
