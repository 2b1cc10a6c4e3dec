"""SimHash, PII, mixing and the pipeline: against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinforge.llm import mixing, nearcopies, pii, simhash

from .conftest import prose


def components_of(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_components(edge_docs, no_docs):
    rows = simhash.components(edge_docs).collect()
    texts = defaultdict(list)
    for r in edge_docs.collect():
        texts[r["doc_id"]].append(slow_fingerprint(r["text"]))
    assert len(rows) == edge_docs.count()
    fps = {r["doc_id"]: r["fp"] % (1 << 64) for r in rows}
    assert all(fps[i] == f[0] for i, f in texts.items())
    known = [i for i in fps if i is not None]
    expected = components_of(known, [(a, b) for a in known for b in known if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert all(r["component_id"] == expected[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert simhash.components(no_docs).count() == 0


@pytest.mark.parametrize("limit", [32_768, 4])
def test_links_keep_every_component(spark, limit):
    """Dense clusters of fingerprints, also by the route for crowded probe groups."""
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(0, 1 << 63, 12):
        for _ in range(25):
            f = int(base)
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                f ^= 1 << int(b)
            fps.add(f - (1 << 64) if f >> 63 else f)
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    got = components_of(fps, [(r["a"], r["b"]) for r in simhash.links(df, 2, limit).collect()])
    u = {f: f % (1 << 64) for f in fps}
    assert got == components_of(fps, [(a, b) for a in fps for b in fps if (u[a] ^ u[b]).bit_count() <= 2])


def test_thresholds_satisfy_the_pigeonhole():
    rng = np.random.default_rng(3)
    groups = [list(range(0, 20)), list(range(20, 42)), list(range(42, 64))]
    for costs in ([{-1: 0, 0: 5, 1: 9, 2: 30}] * 3, [{-1: 0, 0: 90, 1: 91, 2: 92}, {-1: 0, 0: 1, 1: 8, 2: 99}, {-1: 0, 0: 1, 1: 7, 2: 99}]):
        cost, ts = simhash.allocate([{k: float(v) for k, v in c.items()} for c in costs], 2 - 3 + 1)
        assert sum(ts) == 0 and cost < float("inf")
        masks = simhash.probes(groups, ts)
        for _ in range(300):
            a = int(rng.integers(0, 1 << 63))
            b = a
            for bit in rng.choice(64, 2, replace=False):
                b ^= 1 << int(bit)
            assert any(a & m == b & m for m in masks)


def test_near_copies_join_and_others_stay(spark, no_docs):
    base = prose(1, 300).split()
    near = base.copy()
    near[50] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, prose(77, 300)), (5, prose(78, 300)), (None, " ".join(base))]
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert nearcopies.near_components(no_docs).count() == 0


def test_near_copies_join_in_hot_groups_too(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SET_MEMBERS", 1)
    base = prose(1, 300).split()
    near = base.copy()
    near[50] = "changed"
    rows = [(1, " ".join(base), 0), (3, " ".join(near), 0), (4, prose(77, 300), 0), (6, "", 0), (7, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_components(docs).collect()}
    assert got == {1: 1, 3: 1, 4: 4, 6: 6, 7: 6}


def test_parity_sketches_rule_out_no_link():
    """Whatever the sizes, differing sketch bits never exceed differing shingles."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 62, n)) for n in (1, 3, 31, 32, 33, 300)]
    for s in list(sets):
        for cut in (0, 1, len(s) // 10):
            sets.append(np.unique(np.concatenate([s[cut:], rng.integers(0, 1 << 62, cut)])))
    a, b = nearcopies.possible_edges(np.array([len(s) for s in sets]), [nearcopies.parity_sketch(s) for s in sets], 0.8)
    exact = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))]
    possible = components_of(range(len(sets)), zip(a.tolist(), b.tolist(), strict=True))
    assert all(possible[i] == possible[j] for i, j in exact)
    assert len(set(possible.values())) > 4


def five_word_similarity(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def near_groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in nearcopies.near_components(df).collect()}


def exact_groups(texts, at=0.8):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    shared = [x for x, n in Counter(x for s in sets for x in s).items() if n > 1]
    column = {x: c for c, x in enumerate(shared)}
    holds = np.zeros((len(texts), len(shared)), np.float32)
    for i, s in enumerate(sets):
        holds[i, [column[x] for x in s if x in column]] = 1
    both, sizes = holds @ holds.T, np.array([len(s) for s in sets])
    linked = np.argwhere(both >= at * (sizes[:, None] + sizes - both) - 1e-9).tolist()
    return components_of(range(len(texts)), linked)


def test_pairs_are_kept_in_a_family_of_looser_variants(spark):
    """Variants 0.6 to 0.7 alike do not link, whoever opens their group; planted closer pairs do."""
    rng = np.random.default_rng(11)
    base = np.array([f"w{i}" for i in rng.integers(0, 5000, 200)], dtype=object)
    texts = []
    for k in range(2000):
        one = base.copy()
        spots = rng.choice(40, 4, replace=False) * 5
        one[spots] = [f"v{k}x{j}" for j in range(4)]
        texts.append(" ".join(one))
    for k in range(0, 2000, 20):
        one = texts[k].split()
        one[2] = f"twin{k}"
        texts.append(" ".join(one))
    alike = [five_word_similarity(texts[0], t) for t in texts[1:200]]
    assert 0.6 < np.median(alike) < 0.8
    got = near_groups(spark, texts)
    assert got == exact_groups(texts)
    assert all(got[2000 + i] == got[20 * i] for i in range(100))


@pytest.mark.parametrize("limit", [1, 32_768])
def test_hot_sets_give_the_same_links(spark, monkeypatch, limit):
    """Pairs at 0.80 to 0.85 link whether sets of candidates are dealt into tiles or not."""
    monkeypatch.setattr(nearcopies, "SET_MEMBERS", limit)
    monkeypatch.setattr(nearcopies, "PIVOTS", min(limit, 64))
    texts = []
    for k in range(12):
        words = prose(300 + k, 200).split()
        other = words.copy()
        for spot in (20, 70, 120, 170):
            other[spot] = f"other{k}"
        texts += [" ".join(words), " ".join(other)]
    alike = [five_word_similarity(a.lower(), b.lower()) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert all(0.8 <= x < 0.85 for x in alike)
    got = near_groups(spark, texts)
    assert got == exact_groups([t.lower() for t in texts])
    assert all(got[2 * k + 1] == 2 * k for k in range(12))


def test_repeated_lines_and_short_texts_link_by_their_sets(spark):
    texts = []
    for k, times in enumerate((5, 10, 20)):
        words = [f"r{k}x{i}" for i in range(200)]
        texts += [" ".join(words), " ".join(words + words[40:60] * times)]
    for k in range(20):
        words = [f"s{k}x{i}" for i in range(8)]
        texts += [" ".join(words), " ".join([*words, "more"])]
    got = near_groups(spark, texts)
    assert got == exact_groups(texts)
    assert all(got[i] == i - i % 2 for i in range(len(texts)))


def test_links_end_at_the_similarity(spark):
    """At 0.8 exactly a pair links, a shingle less and it does not."""
    texts = []
    for k in range(20):
        words = [f"t{k}x{i}" for i in range(84)]
        texts += [" ".join(words), " ".join([*words, *(f"u{k}x{i}" for i in range(20 + k % 2))])]
    got = near_groups(spark, texts)
    assert got == exact_groups(texts)
    assert all((got[2 * k + 1] == 2 * k) == (k % 2 == 0) for k in range(20))


# --- PII ---------------------------------------------------------------------
def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
]


def brute_pii(text):
    spans = sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(KINDS) for m in re.finditer(p, text or "") if ok(m[0]))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def base_line():
    return F.array_join(F.transform(F.filter("found", lambda x: x["rank"] < 4), lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


HARD = [
    "a@b.c.d.e@f.g h_i@j.k..l@m.n a@b-.c .@.a a@b.c_d@e.f",
    "1.2.3.4.5.6.7.8 300.1.1.1.1 0001.2.3.4 1.2.3.04 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 11111111 41111111111111111111111",
    "+1 (988) 555-2485 +123456789012345678 +1 2 3 4 5 6 7 8 9 ( ) x +4 é😀 +33 1 23 45 67 89",
    None,
    "",
    "x@y.zz " * 700,
    "1.1.1.1 " * 600,
    "a" * 20_000 + "@b.c",
    "4" * 16 + "1 " * 9000,
]


def test_pii_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.detect(df).select("doc_id", base_line()).collect()}
    assert all(got[i] == brute_pii(t) for i, t in enumerate(HARD))


def test_pii_contexts_find_unseen_identifiers(spark, edge_docs, no_docs):
    rows = [(i, f"hello there please mail me at user{i}@example.com today") for i in range(30)]
    rows += [(100 + i, f"hello there please mail me at handle{i}77 today") for i in range(6)] + [(200 + i, f"Licence version number 2.0.{i} of 1999 text") for i in range(20)]
    df = spark.createDataFrame(rows + [rows[-1]], "doc_id long, text string")
    found = {r["doc_id"]: [x["kind"] for x in r["found"]] for r in pii.detect(df).collect()}
    assert all(found[i] == ["email"] for i in range(30))
    assert all(found[100 + i] == ["context"] for i in range(6))
    assert all(found[200 + i] == [] for i in range(20))
    assert pii.detect(edge_docs).count() == edge_docs.count() and pii.detect(no_docs).count() == 0


def slow_patterns(text):
    """(token, context) by a loop over the text's words."""
    out, words, lead, first = [], [], "", True
    for token in text.split():
        if not re.search("[0-9@]", token):
            words.append(token)
            continue
        letters = [w for w in ("".join(c for c in w.lower() if c.isalpha()) for w in words) if w]
        if first or not (letters == [] or letters in (["and"], ["or"])):
            two = ([] if first else ["#"]) + letters
            lead = " ".join(two[-2:]) if len(two) > 1 else ""
        out.append((token, lead))
        words, first = [], False
    return out


def test_contexts_reach_back_whole_gaps_and_along_lists(spark):
    texts = [
        "my account number" + " " * 90 + "44455566",
        "account numbers 11122233, 44455566 and 77788899; then 12345",
        "123456 at start, " + "word " * 50 + "the code: -- 98765 ! , 55555",
        "a" * 300 + " " + "b" * 300 + " 123456",
        "key 1 of 2222 or 3333",
        "see the numbers " + "1234567, " * 700 + "end",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.occurrences(df).select("key", F.col("found.inst").alias("inst"), F.col("found.pattern").alias("pattern")).collect()
    for r in rows:
        expected = [(re.sub(r"^\W+|\W+$", "", t), p) for t, p in slow_patterns(texts[r["key"]]) if p and len(re.sub(r"\D", "", t)) >= 3]
        assert list(zip(r["inst"], r["pattern"], strict=True)) == expected, texts[r["key"]][:60]


def test_list_members_are_found(spark):
    rows = [(i, f"please write to our mail address user{i}@example.com now") for i in range(30)]
    rows += [(100, "please write to our mail address" + " " * 90 + "box4455 and box7788 now")]
    found = {r["doc_id"]: [x["kind"] for x in r["found"]] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == ["context", "context"]


# --- mixing ------------------------------------------------------------------
@pytest.mark.parametrize("parts", [[1, 2, 3, 4, 6], [1] * 9, [50, 30, 20], [97, 1, 1, 1], [7]])
def test_schedule_stays_within_one_block(parts):
    slots = mixing.edf_period(parts)
    q = sum(parts)
    assert sorted(t for s in slots for t in s) == list(range(q))
    for p, s in zip(parts, slots, strict=True):
        for t in range(q + 1):
            assert abs(sum(x < t for x in s) - p * t / q) < 1


def test_mix_keeps_every_row(spark, edge_docs, no_docs):
    out = mixing.mix_sources(edge_docs, block_rows=2, period=64, bucket_rows=7)
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in edge_docs.collect())
    assert len({r["mix_pos"] for r in rows}) == len(rows)
    blocks = Counter((r["source"], r["mix_block"]) for r in rows)
    sizes = Counter(r["source"] for r in rows)
    assert all(n <= 2 for n in blocks.values())
    assert all(sum(s == k for s, _ in blocks) == -(-n // 2) for k, n in sizes.items())
    assert len({(r["mix_slot"]) for r in rows}) == len(blocks)
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_spreads_rows_without_a_key(spark):
    """Rows with a null key differ by their text only and still get a place each, however they are dealt."""
    df = spark.createDataFrame([(None, f"text {i}", "a") for i in range(600)] + [(i, "x", "a") for i in range(50)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df, block_rows=4, period=16, bucket_rows=20).orderBy("mix_pos").collect()
    assert [r["mix_pos"] for r in rows] == list(range(650)) and len({(r["doc_id"], r["text"]) for r in rows}) == 650
    again = mixing.mix_sources(df.repartition(5), block_rows=4, period=16, bucket_rows=20).orderBy("mix_pos").collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(r["doc_id"], r["text"]) for r in again]


def test_mix_follows_weights_while_sources_last(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4000)], "doc_id long, source string")
    rows = mixing.mix_sources(df, weights={"a": 3.0, "b": 1.0}, block_rows=4, period=16, bucket_rows=300).orderBy("mix_pos").collect()
    for n in (400, 1200, 2000):
        assert abs(sum(r["source"] == "a" for r in rows[:n]) - 0.75 * n) <= 4
    again = mixing.mix_sources(df.repartition(7), weights={"a": 3.0, "b": 1.0}, block_rows=4, period=16, bucket_rows=300).orderBy("mix_pos").collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in again]


def test_shares_sum_to_the_period():
    assert mixing.shares({"a": 1, "b": 1, "c": 1}, 100) == {"a": 34, "b": 33, "c": 33}
    many = mixing.shares({str(i): 1e-9 for i in range(50)} | {"big": 1.0}, 64)
    assert sum(many.values()) == 408 and min(many.values()) == 1


# --- pipeline ----------------------------------------------------------------
def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    bench = prose(4000, 40)
    rows = [(i, prose(i, 150), "en", "ab"[i % 2], 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "a", 1), (101, rows[1][1] + " extra", "en", "b", 1), (102, "12 34 !!", "en", "a", 1)]
    rows += [(103, prose(5000, 50) + " " + bench + " " + prose(5001, 50), "en", "a", 1), (104, prose(6000, 100) + " password=hunter2222", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 104}
    assert out[104]["text"].endswith("[SECRET]") and len({r["mix_pos"] for r in out.values()}) == 61
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "mix_sources"]
