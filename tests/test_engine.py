"""Known answers, invariances and error contracts of the record-linkage engine."""

import math
import os
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge import session
from kinforge.functions import dates, prefix, strings
from kinforge.infra.artifacts import ArtifactMissing, ArtifactRegistry, TierMixingError
from kinforge.infra.cards import CardImmutableError, conjecture_card, verdict
from kinforge.infra.config import config_hash, load_config, load_config_from_env
from kinforge.infra.runner import Step, order, parse_argv, run_all
from kinforge.operators import (
    ann,
    audit,
    blocking,
    bootstrap,
    calibrate,
    channels,
    cluster,
    exposure,
    fs,
    generate,
    geometry,
    graph_qa,
    identifiability,
    label,
    linkage,
    metrics,
    mining,
    operating,
    power,
    rules,
    sampling,
    scale,
    sparse,
    truth,
)
from kinforge.sources.loaders import checksum_gate, load_corpus, parse_snapshot, read_csv_verbatim, transcode
from kinforge.sources.schema import DeclaredSchema
from kinforge.sources.serialize import serialize

REC = "record_id string, given_name string, family_name string, dob string, zip string, phone string"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("r0", "Ann", "Smith", "1980-01-02", "11111", "5550001"),
        ("r1", "Anne", "Smyth", "1980-05-06", "11111", "5550002"),
        ("r2", "Bob", "Jones", "1970-01-01", "22222", "5550003"),
        ("r3", "Rob", "Brown", "1971-01-01", "33333", "5550003"),
        ("r4", "Cal", "Green", "1990-01-01", None, None),
        ("r5", "Ada", "Black", "  ", "11111", ""),
        ("r6", "Zed", "White", None, "44444", "5550009"),
    ]
    return spark.createDataFrame(rows, REC)


def part(spark, mapping, name="cluster"):
    return spark.createDataFrame(list(mapping.items()), f"record_id string, {name} string")


PRED = {"a": "1", "b": "1", "c": "2", "d": "2", "e": "2"}
TRUE = {"a": "x", "b": "x", "c": "x", "d": "y", "e": "y"}


def cells_of(spark, pred, true, weights=None):
    w = None if weights is None else spark.createDataFrame(list(weights.items()), "record_id string, w long")
    return metrics.contingency(metrics.aligned(part(spark, pred), part(spark, true, "entity_id"), w))


def test_partition_metrics_known_answers(spark):
    cells = cells_of(spark, PRED, TRUE)
    b = metrics.bcubed(cells).first()
    assert b["precision"] == pytest.approx(11 / 15) and b["recall"] == pytest.approx(11 / 15) and b["f1"] == pytest.approx(11 / 15)
    p = metrics.pairwise(cells).first()
    assert (p["tp"], p["fp"], p["fn"]) == (2, 2, 2)
    assert metrics.merge_distance(cells).first()["distance"] == 2
    assert metrics.variation_of_information(cells).first()["vi"] == pytest.approx(2 * (0.6 * (math.log2(3) - 2 / 3)), abs=1e-9)
    assert metrics.variation_of_information(cells_of(spark, TRUE, TRUE)).first()["vi"] == 0
    single = cells_of(spark, {k: k for k in PRED}, TRUE)
    assert metrics.pairwise(single).first()["precision"] is None


def test_weights_equal_physical_copies(spark):
    w = {"a": 2, "b": 1, "c": 0, "d": 3, "e": 1}
    copies_p = {f"{k}{i}": PRED[k] for k, n in w.items() for i in range(n)}
    copies_t = {f"{k}{i}": TRUE[k] for k, n in w.items() for i in range(n)}
    assert metrics.bcubed(cells_of(spark, PRED, TRUE, w)).first() == metrics.bcubed(cells_of(spark, copies_p, copies_t)).first()


def test_alignment_errors(spark):
    with pytest.raises(ValueError):
        metrics.aligned(part(spark, PRED), part(spark, {**TRUE, "z": "q"}, "entity_id"))
    with pytest.raises(ValueError):
        cells_of(spark, PRED, {**TRUE, "a": None})


def test_blocking_passes(spark, records):
    assert blocking.default_passes(records.columns) == [["soundex(family_name)", "year(dob)"], ["zip", "initial(given_name)"], ["phone"]]
    got = {(r["a"], r["b"]) for r in blocking.candidates(records).collect()}
    assert got == {("r0", "r1"), ("r0", "r5"), ("r1", "r5"), ("r2", "r3")}
    with pytest.raises(ValueError):
        blocking.default_passes(["city"])
    with pytest.raises(ValueError):
        blocking.key_column("soundex(")


def test_budget_matches_the_sequential_rule(spark):
    rows = [(f"r{i:02d}", "Ann", "Smith", "1980-01-01", str(i % 3), "5") for i in range(14)]
    df = spark.createDataFrame(rows, REC)
    passes = [["zip"], ["phone"]]
    seen, used, kept = [], {}, set()
    for keys in (lambda r: r[4], lambda r: r[5]):
        blocks = {}
        for r in rows:
            blocks.setdefault(keys(r), []).append(r[0])
        for k in sorted(blocks):
            ids = sorted(blocks[k])
            seen += [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 : i + 3] if (a, b) not in seen]
    for a, b in seen:
        if used.get(a, 0) < 2 and used.get(b, 0) < 2:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            kept.add((a, b))
    assert {(r["a"], r["b"]) for r in blocking.budgeted(df, 2, passes).collect()} == kept


def test_clustering_schemes(spark):
    recs = spark.createDataFrame([(x,) for x in "abcdefg"], "record_id string")
    chain = spark.createDataFrame([("a", "b", 0.9), ("c", "b", 0.8), ("c", "d", 0.9), ("e", "f", 0.4)], "a string, b string, prob double")
    closed = {r["record_id"]: r["cluster"] for r in cluster.transitive_closure(chain, 0.5, recs).collect()}
    assert closed == {**dict.fromkeys("abcd", "a"), "e": "e", "f": "f", "g": "g"}
    capped = {r["record_id"]: r["cluster"] for r in cluster.capped_agglomerative(chain, 0.5, 2, recs).collect()}
    assert capped["a"] == capped["b"] == "a" and capped["c"] == capped["d"] == "c"
    star = {r["record_id"]: r["cluster"] for r in cluster.star_clustering(chain, 0.5, recs).collect()}
    assert star["a"] == star["b"] == star["c"] == "a" and star["d"] == "d"
    assert cluster.greedy_correlation(chain, recs, 1).count() == 7
    for bad in ([("a", "a", 0.5)], [("a", "zz", 0.5)], [("a", "b", 1.5)], [("a", "b", None)]):
        with pytest.raises(ValueError):
            cluster.check_pairs(spark.createDataFrame(bad, "a string, b string, prob double"), recs)


def test_component_statistics(spark):
    assert graph_qa.bridges_of([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]) == [("c", "d"), ("d", "e")]
    recs = spark.createDataFrame([(x,) for x in "abcdez"], "record_id string")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)], "a string, b string, prob double")
    stats = {r["component"]: r for r in graph_qa.component_stats(pairs, 0.5, recs).collect()}
    assert stats["a"]["size"] == 5 and stats["a"]["n_bridges"] == 4 and stats["a"]["density"] == pytest.approx(0.4) and stats["z"]["density"] == 1.0
    flagged = graph_qa.suspicious_clusters(graph_qa.component_stats(pairs, 0.5, recs), size_p99=10).collect()
    assert [(r["component"], r["reasons"]) for r in flagged] == [("a", "bridges")]


def test_operating_points_known_curve(spark):
    true = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "B"), ("d", "B"), ("e", "C"), ("f", "D")], "record_id string, entity_id string")
    scored = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.8), ("e", "f", 0.6), ("b", "c", 0.4)], "a string, b string, score double")
    curve = {r["threshold"]: (round(r["precision"], 6), round(r["recall"], 6)) for r in operating.threshold_curve(scored, true).collect()}
    assert curve == {0.9: (1.0, round(5 / 6, 6)), 0.8: (1.0, 1.0), 0.6: (round(5 / 6, 6), 1.0), 0.4: (0.5, 1.0)}
    best = operating.precision_point(operating.threshold_curve(scored, true), 0.99).first()
    assert best["threshold"] == 0.8 and best["met"]
    assert operating.cost_point(operating.threshold_curve(scored, true), 1.0, 1.0).first()["threshold"] == 0.8
    assert operating.fp_budget_threshold(scored, 0.5, 4) == 0.8
    ties = spark.createDataFrame([(0.9,), (0.9,), (0.5,)], "score double")
    assert operating.fp_budget_threshold(ties, 0.25, 4) > 0.9


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "score double, label int")
    assert operating.auc(df).first()["auc"] == pytest.approx(0.875)
    assert operating.auc(df.where("label = 1")).first()["auc"] is None


def test_calibration(spark):
    assert calibrate.pav([1, 2, 3, 4], [0, 1, 0, 1], [1, 1, 1, 1]) == [(1, 0.0), (2, 0.5), (3, 0.5), (4, 1.0)]
    rng = np.random.default_rng(0)
    rows = [(float(s), int(rng.random() < s), "a" if i % 2 else "b") for i, s in enumerate(rng.random(600))] + [(0.5, 1, "only")]
    df = spark.createDataFrame(rows, "score double, label int, stratum string")
    for method in calibrate.METHODS:
        model = calibrate.fit_calibrator(df, method, "stratum")
        assert model.fallback == ["only"]
        out = df.select(model.transform(F.col("score"), F.col("stratum")).alias("p")).agg(F.min("p"), F.max("p")).first()
        assert 0 <= out[0] < 0.3 < 0.7 < out[1] <= 1
        with pytest.raises(ValueError):
            model.transform(F.col("score"))
    with pytest.raises(ValueError):
        calibrate.fit_calibrator(df.where("label = 1"))


def test_jaro_winkler_and_soundex(spark):
    assert strings.jaro_winkler_value("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert strings.jaro_winkler_value("DWAYNE", "DUANE") == pytest.approx(0.84, abs=1e-4)
    assert strings.jaro_winkler_value("", "x") == 0 and strings.jaro_winkler_value("", "") == 1
    row = spark.createDataFrame([(" Robert", "123", None)], "a string, b string, c string").select(*[strings.soundex(F.col(c)) for c in "abc"]).first()
    assert tuple(row) == ("R163", None, None)


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-29",), ("3/4/1985",), ("19850304",), ("03-04-1985",), ("04 Mar 1985",), ("junk",)], "d string")
    rows = [tuple(r) for r in df.select(dates.parse(F.col("d")).cast("string"), dates.shift_years(F.col("d"), 1)).collect()]
    assert rows[0] == ("2020-02-29", "2021-02-28") and [r[0] for r in rows[1:]] == ["1985-03-04"] * 4 + [None]
    assert rows[1][1] == "03/04/1986" and rows[5][1] is None


def test_fellegi_sunter_ranks_planted_duplicates(spark):
    given = ["Ann", "Bob", "Cal", "Dee", "Eve", "Fay", "Gus", "Hal", "Ida", "Jon"]
    rows = []
    for i in range(120):
        base = (given[i % 10], f"Fam{i % 23}x", f"19{50 + i % 40}-0{1 + i % 9}-1{i % 9}", f"{10000 + i % 31}", f"555{i:04d}")
        rows.append((f"r{i}a", *base))
        if i % 2 == 0:
            rows.append((f"r{i}b", base[0], base[1], base[2], base[3], f"555{i:03d}9"))
    df = spark.createDataFrame(rows, REC)
    model = fs.fit(df, ["given_name", "family_name", "dob", "zip"], 20_000)
    assert all(s["converged"] for s in model.sessions) and model.m["dob"][-1] > model.u["dob"][-1]
    true = [(f"r{i}a", f"r{i}b") for i in range(0, 120, 2)]
    false = [(f"r{i}a", f"r{(i + 37) % 120}a") for i in range(0, 120, 2)]
    scored = fs.score(spark.createDataFrame(true + false, "a string, b string"), df, model)
    prob = {(r["a"], r["b"]): r["prob"] for r in scored.collect()}
    assert min(prob[tuple(sorted(p))] for p in true) > max(prob[tuple(sorted(p))] for p in false)
    with pytest.raises(ValueError):
        fs.score(spark.createDataFrame([("r0a", "nobody")], "a string, b string"), df, model)


def test_rules(spark, records):
    pairs = spark.createDataFrame([("r0", "r1", 0.5), ("r2", "r3", 0.5), ("r0", "r2", 0.5), ("r4", "r6", 0.1)], "a string, b string, prob double")
    got = {(r["a"], r["b"]): r["prob"] for r in rules.apply_rules(rules.fires(pairs, records)).collect()}
    assert got == {("r0", "r1"): 0.5, ("r2", "r3"): 0.5, ("r0", "r2"): 0.0, ("r4", "r6"): 0.0}


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([("a", "red fox"), ("b", "red dog dog"), ("c", "blue cat"), ("d", None)], "record_id string, text string")
    top = {(r["q"], r["d"]): r["score"] for r in sparse.neighbours(df, 2).collect()}
    mean = 7 / 4
    idf = math.log(1 + (4 - 2 + 0.5) / (2 + 0.5))
    assert set(top) == {("a", "b"), ("b", "a")}
    assert top["a", "b"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / mean)), abs=1e-8)


def test_neighbours_exact_and_filed(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 8)], "record_id string, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    exact = {f"{i:03d}": {f"{j:03d}" for j in np.argsort(-sims[i])[:5]} for i in range(300)}
    got = {}
    for r in ann.neighbours(df, 5, tile_rows=64).collect():
        got.setdefault(r["q"], set()).add(r["d"])
    assert all(got[k] == v for k, v in exact.items())
    near = {}
    for r in ann.ivf_neighbours(df, 5, lists=6, probes=4).collect():
        near.setdefault(r["q"], set()).add(r["d"])
    assert np.mean([len(near[k] & v) / 5 for k, v in exact.items()]) > 0.9


def test_audit_taxonomy(spark):
    cols = "ncid string, given_name_a string, given_name_b string, family_name_a string, family_name_b string, dob_a string, dob_b string"
    rows = [
        ("1", "Ann", "Ann", "Lee", "Lee", "1980-01-02", "01/02/1980"),
        ("2", None, "Ann", "Lee", " ", "x", "x"),
        ("3", "Ann", "Lee", "Lee", "Ann", None, ""),
        ("4", "Robert", "Bob", "O'Neil", "ONEIL", "a", "b"),
        ("5", "Anna", "Annie", "Smith", "Jones", "1", "1"),
    ]
    out = audit.classify(spark.createDataFrame(rows, cols), ["given_name", "family_name", "dob"], channels.NICKNAMES).collect()
    got = {(r["ncid"], r["field"]): r["category"] for r in out}
    assert got["1", "dob"] == "format_drift" and got["1", "given_name"] == "identical"
    assert got["2", "given_name"] == "missing_gain" and got["2", "family_name"] == "missing_loss"
    assert got["3", "given_name"] == got["3", "family_name"] == "swap" and got["3", "dob"] == "identical"
    assert got["4", "given_name"] == "nickname" and got["4", "family_name"] == "format_drift" and got["4", "dob"] == "typo"
    assert got["5", "given_name"] == "typo" and got["5", "family_name"] == "wholesale"
    prev = {r["category"]: r for r in audit.prevalence(spark.createDataFrame(out)).where("field = 'dob'").collect()}
    assert prev["identical"]["n"] == 3 and prev["identical"]["lo"] < 0.6 < prev["identical"]["hi"]


def test_align_drops_repeated_keys(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "z"), (None, "n")], "ncid string, v string")
    b = spark.createDataFrame([("1", "p"), ("2", "q"), (None, "m")], "ncid string, v string")
    assert [tuple(r) for r in audit.align(a, b).collect()] == [("1", "x", "p")]
    assert tuple(audit.align_stats(a, b).first()) == (1, 0, 1)


def test_exposure(spark):
    model = exposure.ExposureModel.fit(spark.createDataFrame([("a", 0.2, 10), ("b", 0.1, 10), (None, 0.3, 20)], "g string, rate double, n int"))
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "g string")
    got = {r["g"]: r["rate"] for r in model.rates(df, 0.9).collect()}
    assert got["a"] == pytest.approx(0.9 * 0.2 / 0.225) and got["c"] == 0.9 and got[None] == 0.9
    with pytest.raises(ValueError):
        exposure.ExposureModel.from_table(spark.createDataFrame([("a", -1.0)], "g string, multiplier double"))


@pytest.fixture(scope="module")
def base(spark):
    rows = [(f"p{i}", f"e{i}", ["Robert", "ALICE", "peter"][i % 3], "Kay", "Tucker", None if i % 2 else "JR", "1984-03-1%d" % (i % 9), f"{i} Oak Street", "Rockton", "12345", "5551234567", "Peter Tucker") for i in range(60)]
    return spark.createDataFrame(rows, "record_id string, entity_id string, given_name string, middle_name string, family_name string, name_suffix string, dob string, street string, city string, zip string, phone string, full_name string")


@pytest.mark.parametrize("name", sorted(channels.REGISTRY))
def test_channels_are_seeded_and_logged(base, name):
    channel = channels.REGISTRY[name]()
    out, log = channel.apply(base, 1.0, 3)
    ops = log.collect()
    assert ops and all(r["before"] != r["after"] for r in ops)
    assert sorted(map(tuple, ops)) == sorted(map(tuple, channel.apply(base.repartition(5), 1.0, 3)[1].collect()))
    before = {r["record_id"]: r.asDict() for r in base.collect()}
    for r in ops:
        assert before[r["record_id"]][r["field"]] == r["before"]
        before[r["record_id"]][r["field"]] = r["after"]
    assert before == {r["record_id"]: r.asDict() for r in out.collect()}
    assert channel.apply(base, 0.0, 3)[1].count() == 0


def test_generated_corpus_replays(base):
    corpus, log = generate.generate_corpus(base, {"typo": 0.5, "field_dropout": 0.3}, seed=4)
    rows = {r["record_id"]: r.asDict() for r in corpus.collect()}
    clean = {r["record_id"]: r.asDict() for r in base.collect()}
    replay = {k: {**clean[k.split("#")[0]], "record_id": k} for k in rows}
    for r in log.collect():
        assert replay[r["record_id"]][r["field"]] == r["before"]
        replay[r["record_id"]][r["field"]] = r["after"]
    assert replay == rows and len(rows) > 60
    new, ops = generate.household_confusables(base, 1.0, 2)
    kinds = {r["after"] for r in ops.where("field = '__kind__'").collect()}
    assert kinds == {"sibling", "twin", "jr_sr"} and new.count() == 60
    with pytest.raises(KeyError):
        generate.generate_corpus(base, {"nope": 0.1})


def test_identifiability(spark):
    df = spark.createDataFrame([("1", "a", "x", None), ("2", "b", "x", None), ("3", "c", "x", "z"), ("4", "d", "y", "z"), ("5", "d", "y", "z")], "record_id string, entity_id string, f string, g string")
    got = {r["record_id"]: r["unresolvable"] for r in identifiability.unresolvable(df, ["f", "g"]).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False}
    with pytest.raises(KeyError):
        identifiability.unresolvable(df, ["nope"])


def test_bootstrap(spark):
    pred = {str(i): str(i // 2) for i in range(200)}
    true = {str(i): f"e{i // 4}" if i % 3 else f"e{i // 2}" for i in range(200)}
    units = bootstrap.bcubed_units(part(spark, pred), part(spark, true, "entity_id"))
    for method in ("percentile", "bca"):
        ci = bootstrap.bootstrap_ci(units, "bcubed_recall", 100, 1, method)
        assert ci["lo"] < ci["point"] < ci["hi"]
    same = bootstrap.paired_delta(units, units, "bcubed_f1", 50, 1).first()
    assert same["delta"] == 0 and same["lo"] == same["hi"] == 0 and not same["sign_stable"]
    base = np.random.default_rng(0).integers(0, 1 << 32, 20_000)
    weights = bootstrap.poisson_weights(base, np.arange(5))
    assert (weights[:, 0] == 1).all() and weights[:, 1:].mean() == pytest.approx(1, abs=0.02) and weights[:, 1:].var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(weights[:, 1:].T) - np.eye(4)).max() < 0.03
    slow = [[1, *(next((k for k, cut in enumerate(bootstrap.CUTS) if mixed(int(u), r) < cut), 7) for r in (1, 2))] for u in base[:300]]
    assert (weights[:300, :3] == np.array(slow)).all()
    sums = spark.createDataFrame([(str(i), float(i % 7), 1.0) for i in range(300)], "unit string, x double, n double")
    ci = {r["metric"]: r for r in bootstrap.intervals(sums, {"mean": F.col("x") / F.col("n"), "ones": F.col("n") / F.col("n")}, 100, 3).collect()}
    assert ci["mean"]["point"] == pytest.approx(np.mean([i % 7 for i in range(300)])) and ci["mean"]["lo"] < ci["mean"]["point"] < ci["mean"]["hi"]
    assert ci["ones"]["lo"] == ci["ones"]["hi"] == 1


def mixed(base, rep):
    h = base ^ rep * bootstrap.MIX[0] % 2**32
    h = (h ^ h >> 16) * bootstrap.MIX[1] % 2**32
    h = (h ^ h >> 13) * bootstrap.MIX[2] % 2**32
    return h ^ h >> 16


def test_block_scores_equal_the_plain_ones():
    rng = np.random.default_rng(1)
    texts = ["", "a", "martha", "marhta", "dixon", "dicksonx", "é😀x", "x" * 90, "ab" * 60] + ["".join(rng.choice(list("abcd"), n)) for n in rng.integers(0, 14, 120)]
    a, b = [list(x) for x in zip(*[(x, y) for x in texts for y in texts], strict=True)]
    assert strings.jaro_winkler_values(a, b).tolist() == pytest.approx([strings.jaro_winkler_value(x, y) for x, y in zip(a, b, strict=True)], abs=1e-15)
    assert len(strings.jaro_winkler_values([], [])) == 0


def test_power_and_truth(spark):
    assert power.detect_bar({"seed": 1e-4, "noise_draw": 0.0, "residual": 0.0}) == pytest.approx(2 * math.sqrt(2e-4))
    assert power.seeds_needed(0.01, 0.0305**2, 0) == 74 or power.seeds_needed(0.01, 0.0305**2, 0) == 73
    with pytest.raises(ValueError, match="residual"):
        power.detect_bar({"seed": 1.0})
    with pytest.raises(ValueError, match="name the factors"):
        power.detect_bar({"split": 1.0, "residual": 0.0})
    assert power.detect_bar({"seed": 2.0}, include_residual=False) == 4.0
    grid = spark.createDataFrame([(s, n, float(s + 10 * n)) for s in range(4) for n in range(3)], "seed int, noise_draw int, value double")
    found = power.variance_components(grid, ["seed", "noise_draw"])
    assert found["seed"] == pytest.approx(5 / 3) and found["noise_draw"] == pytest.approx(100) and found["residual"] == pytest.approx(0, abs=1e-9)
    gaps = spark.createDataFrame([(s, 1, float(s * s)) for s in range(4) for _ in range(2)] + [(9, 1, None)], "seed int, noise_draw int, value double")
    one = power.variance_components(gaps, ["seed", "noise_draw"])
    assert math.isnan(one["noise_draw"]) and one["seed"] > 0 and one["residual"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError, match="not enough"):
        power.variance_components(grid.limit(2), ["seed", "noise_draw"])
    assert truth.corrected_precision_recall(0.9, 0.8, 0.0, 0.0)["precision"] == 0.9
    fixed = truth.corrected_precision_recall(0.9, 0.8, 0.05, 0.02)
    assert fixed["precision"] == pytest.approx(0.88 / 0.93) and fixed["recall"] == pytest.approx(0.8 / 0.98)
    assert fixed["recall_lo"] == pytest.approx(0.95 * 0.78 / 0.98) and fixed["recall_hi"] == pytest.approx(0.95 * 0.8 / 0.98 + 0.05)
    assert fixed["precision"] * 0.95 + (1 - fixed["precision"]) * 0.02 == pytest.approx(0.9)
    with pytest.raises(ValueError, match="less than 1"):
        truth.corrected_precision_recall(0.9, 0.8, 0.6, 0.4)
    assert truth.allocate({"a": 90, "b": 9, None: 1}, 10) == {"a": 8, "b": 1, None: 1}
    a = spark.createDataFrame([("1", "2", "m"), ("3", "4", "n")], "a string, b string, label string")
    b = spark.createDataFrame([("2", "1", "m"), ("5", "6", "m")], "a string, b string, label string")
    assert truth.disagreements(a, b).count() == 2
    sample = truth.disagreement_sample(a, b, 1, 0).collect()
    assert len(sample) == 1 and sample[0]["weight"] == 2.0


def test_labels(spark, records, tmp_path):
    pairs = spark.createDataFrame([("r1", "r0"), ("r0", "r1"), ("r2", "r3")], "a string, b string")
    queue = label.pair_queue(pairs, records)
    assert [r["pair_id"] for r in queue.collect()] == ["r0||r1", "r2||r3"]
    with pytest.raises(ValueError):
        label.pair_queue(spark.createDataFrame([("r0", "r0")], "a string, b string"), records)
    rows = spark.createDataFrame([("r0||r1", "match", "x", "1"), ("r0||r1", "nonmatch", "x", "2")], label.HISTORY)
    label.append_labels(rows, f"{tmp_path}/labels")
    last = label.latest_labels(label.read_labels(spark, f"{tmp_path}/labels"))
    assert [r["label"] for r in last.collect()] == ["nonmatch"]
    assert label.pending(queue, last, "x").count() == 1 and label.items(queue, records).count() == 2
    same = spark.createDataFrame([("p", "match")], "pair_id string, label string")
    assert label.cohens_kappa(same, same).first()["kappa"] == 1.0


def test_schema_and_serialisation(spark):
    df = spark.createDataFrame([(" 1 ", "7", "ANN", "", "N", "Oak", 5), (None, "8", None, "LEE", None, "", 6)], "county string, num string, first string, last string, dir string, st string, keep int")
    schema = DeclaredSchema("toy", ["county", "num"], {"given_name": "first", "family_name": "last", "street": ["dir", "st"]}, None, ["keep"])
    rows = schema.to_canonical(df).collect()
    assert rows[0]["record_id"] == "1:7" and rows[1]["record_id"] is None and rows[0]["street"] == "N Oak" and rows[1]["street"] is None and rows[0]["keep"] == 5
    with pytest.raises(ValueError):
        DeclaredSchema("bad", "x", {"no_such_role": "a"})
    with pytest.raises(KeyError):
        DeclaredSchema("bad", "x", {"city": "a"}).to_canonical(df)
    canon = schema.to_canonical(df)
    text = [r[0] for r in canon.select(serialize(canon, ["given_name", "family_name"], "json", "drop")).collect()]
    assert text == ['{"given_name":"ANN"}', '{"family_name":"LEE"}']
    assert canon.select(serialize(canon, ["given_name", "zip"])).first()[0] == "[COL] given_name [VAL] ANN [COL] zip [VAL] [MISSING]"


def test_loaders(spark, tmp_path):
    (tmp_path / "f.csv").write_text('unique_id,first_name,surname,dob,city,email,cluster\n1,NA,"O""x",,"",NULL,c1\n')
    row = read_csv_verbatim(spark, f"{tmp_path}/f.csv").first()
    assert (row["first_name"], row["surname"], row["dob"], row["city"], row["email"]) == ("NA", 'O"x', "", "", "NULL")
    assert load_corpus(spark, "fake_1000", f"{tmp_path}/f.csv")[0].first()["entity_id"] == "c1"
    checksum_gate(tmp_path / "f.csv")
    (tmp_path / "f.csv").write_text("changed")
    with pytest.raises(ValueError):
        checksum_gate(tmp_path / "f.csv")
    lines = ["county_id\tncid\tname", ' 68 \tA1\t"Bo', "32\tA2", "68\tA3\tx\textra", "99\tA4\ty"]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("s.txt", "\r\n".join(lines).encode("utf-16"))
    rows, quarantine, stats = parse_snapshot(spark, str(transcode(tmp_path / "s.zip", tmp_path / "s.txt")), [68, 32], ["ncid", "name"])
    assert sorted(map(tuple, rows.collect())) == [("A1", '"Bo'), ("A2", "")] and quarantine.count() == 1
    assert tuple(stats.first()) == (4, 1, 1)


def test_splits_and_ladder(spark):
    df = spark.createDataFrame([(f"r{i}", f"e{i // 3}") for i in range(300)], "record_id string, entity_id string")
    checks = {r["split"]: r["n_straddling"] for r in sampling.split_checks(sampling.build_splits(df, {"random": None, "entity": "entity_id"}, 1), df).collect()}
    assert checks["entity"] == 0 < checks["random"]
    ladder = sampling.entity_ladder(df, [30, 90], 1)
    small, large = ({r["record_id"] for r in ladder.where(F.col("rung") == n).collect()} for n in (30, 90))
    assert small < large and len(small) == 30 and len(large) == 90
    assert sampling.entity_complete_subsample(df, 31, 2).count() == 33


def test_scaling_and_tails(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x**1.5) for x in (10, 100, 1000, 10000)], "x double, y double")
    fit = scale.fit_scaling(df)
    assert fit.slope == pytest.approx(1.5) and scale.validate_extrapolation(fit, 1e5, 3e5 * 1e5**0.5)["z"] == pytest.approx(0, abs=1e3)
    assert scale.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    rng = np.random.default_rng(2)
    draws = 0.2 / 0.25 * (rng.random(4000) ** -0.25 - 1)
    xi, sigma = scale.gpd_fit(np.sort(draws))
    assert xi == pytest.approx(0.25, abs=0.08) and sigma == pytest.approx(0.2, abs=0.03)
    one = {"threshold": 0.0, "rate": 1.0, "xi": 0.25, "scale": 0.2}
    assert scale.gpd_survival(scale.threshold_for_rate(one, 0.01), 0.25, 0.2) == pytest.approx(0.01)
    with pytest.raises(scale.CeilingError):
        scale.cost_breakdown(spark, 10**9, dict.fromkeys(("serialise", "encode", "block", "cluster"), 1.0), {"gpu_h": 1, "core_h": 1}, single_node=True)


def test_tail_fits_cover_all_excesses(spark):
    """The fit by sums over the executors is that of the driver, ties and all."""
    rng = np.random.default_rng(4)
    for draws in (0.2 / 0.25 * (rng.random(3000) ** -0.25 - 1), 0.2 / 0.1 * (1 - rng.random(3000) ** 0.1), rng.exponential(2, 3000).round(1)):
        df = spark.createDataFrame([(float(x),) for x in draws], "score double")
        mine, there = (scale.fit_gpd_tail(df, quantiles=(0.5, 0.9), local=n) for n in (10**6, 10))
        for a, b in zip(mine, there, strict=True):
            assert (a["n"], a["threshold"], a["rate"]) == (b["n"], b["threshold"], b["rate"])
            assert b["xi"] == pytest.approx(a["xi"], abs=1e-4) and b["scale"] == pytest.approx(a["scale"], rel=1e-4)
            assert b["qq_r2"] == pytest.approx(a["qq_r2"], abs=1e-4)


def test_hubness_covers_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "neighbours", lambda df, k, rid, vector: df.select(F.col(rid).alias("q"), F.lit(0).cast("long").alias("d")))
    vectors = spark.range(30_000).select(F.col("id").alias("record_id"), F.array(F.lit(1.0)).alias("embedding"))
    found = geometry.hubness(vectors).first()
    assert (found["n"], found["max_count"]) == (30_000, 30_000)


def test_churn_and_attach(spark):
    before = part(spark, {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"})
    after = part(spark, {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"})
    assert tuple(linkage.churn(before, after).first()) == (3, 1, 1, 1)
    assert {(r["c1"], r["c0"]) for r in linkage.carry_ids(before, after).collect()} == {("a", "a"), ("c", "c"), ("e", "d")}
    new = spark.createDataFrame([("x",), ("y",), ("z",)], "record_id string")
    scored = spark.createDataFrame([("x", "b", 0.95), ("y", "z", 0.99), ("z", "y", 0.99)], "a string, b string, prob double")
    got = {r["record_id"]: r["cluster"] for r in linkage.attach(before, new, scored, 0.9).collect()}
    assert got["x"] == "a" and got["y"] == got["z"] == "y" and got["c"] == "c"


def test_streaming_attachment(spark, tmp_path):
    from kinforge.streaming.attach import Attacher, watermarked_arrivals

    schema = "record_id string, given_name string, family_name string, dob string, zip string, phone string"
    old = spark.createDataFrame([("r1", "Ann", "Smith", "1980-01-02", "1", "555")], schema)
    sink = Attacher(spark, f"{tmp_path}/state", old, part(spark, {"r1": "r1"}), ["given_name", "family_name", "dob"])
    spark.createDataFrame([("r2", "Ann", "Smith", "1980-01-02", "1", None), ("r3", "Zed", "Quill", "1950-01-02", "9", None)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["record_id"]: r["cluster"] for r in sink.state()[1].collect()} == {"r1": "r1", "r2": "r1", "r3": "r3"}
    # A restarted driver goes on from the folder; a batch that broke off is written again and reads earlier ones only.
    spark.createDataFrame([("r9", "Half", "Done", "1900-01-02", "9", None)], schema).write.parquet(f"{tmp_path}/state/records/1")
    again = Attacher(spark, f"{tmp_path}/state", old, part(spark, {"r1": "r1"}), ["given_name", "family_name", "dob"])
    assert again.version == 0 and again.state()[0].count() == 3
    again(spark.createDataFrame([("r4", "Zed", "Quill", "1950-01-02", "9", None), ("r1", "Ann", "Smith", "1980-01-02", "1", "555")], schema), 1)
    again(spark.createDataFrame([("r5", "No", "One", "1950-01-02", "9", None)], schema), 0)
    assert {r["record_id"]: r["cluster"] for r in again.state()[1].collect()} == {"r1": "r1", "r2": "r1", "r3": "r3", "r4": "r3"}
    assert spark.read.parquet(f"{tmp_path}/state/clusters/1").count() == 1
    timed = watermarked_arrivals(spark.readStream.schema("ts timestamp, source string").parquet(f"{tmp_path}/in"))
    assert timed.isStreaming and "n" in timed.columns


def test_config_registry_runner_cards(spark, tmp_path, monkeypatch):
    config = load_config(None, ["score.threshold=0.8", "score.fields=[a,b]"])
    assert config.score.threshold == 0.8 and config.score.fields == ["a", "b"] and len(config_hash(config)) == 12
    with pytest.raises(KeyError):
        load_config(None, ["score.nope=1"])
    typed = load_config(None, ["run.seeds=[1,2]", "data.n_records=50", "infra.master=none", "train.lr=0.1"])
    assert typed.run.seeds == [1, 2] and typed.data.n_records == 50 and typed.infra.master is None and typed.train.lr == 0.1
    env = load_config_from_env({"KINFORGE_OVERRIDES": '["model.dim=64"]', "KINFORGE_TIER": "target", "KINFORGE_ARTIFACTS": "/x"})
    assert (env.model.dim, env.run.tier, env.paths.artifacts) == (64, "target", "/x") and config_hash(env) != config_hash(config)
    monkeypatch.setenv("KINFORGE_ARTIFACTS", f"{tmp_path}/artifacts")
    registry = ArtifactRegistry.from_env(spark)
    with pytest.raises(ArtifactMissing):
        registry.load("pairs", "smoke")
    steps = [
        Step("second", lambda r, c: r.register("b", {"n": r.load("a", "smoke").count()}, "smoke"), ("a",), ("b",)),
        Step("first", lambda r, c: r.register("a", spark.range(3), "smoke"), (), ("a",)),
    ]
    assert run_all(steps, registry, config) == ["first", "second"] and registry.load("b", "smoke") == {"n": 3}
    registry.register("b", {"n": 4}, "target")
    with pytest.raises(TierMixingError):
        registry.load("b", "smoke")
    with pytest.raises(ValueError):
        order([Step("x", print, ("b",), ("a",)), Step("y", print, ("a",), ("b",))])
    assert parse_argv(["query=x", "run.seed=3"]) == ({"query": "x"}, ["run.seed=3"])
    conjecture_card(registry, "c1", "smoke", claim="x")
    with pytest.raises(CardImmutableError):
        conjecture_card(registry, "c1", "smoke", claim="y")
    assert verdict(registry, "c1", "smoke", "CONFIRMED", "e")["outcome"] == "CONFIRMED"


def test_entry_without_extras(tmp_path):
    """A copy without the training-data operators imports and registers the other queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "kinforge", tmp_path / "kinforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'bcubed' in o; print(*q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert len(out) > 100 and not [x for x in out if x.startswith("op") and x[2:3].isdigit() or x == "pipeline"]


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)

            class _jsc:
                sc = staticmethod(lambda: Cluster.Scala)

        class Scala:
            getCheckpointDir = staticmethod(lambda: Cluster.Empty)

        class Empty:
            isDefined = staticmethod(lambda: False)

    with pytest.raises(RuntimeError, match=r"spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_suffixes_follow_the_confusion_map(spark):
    rows = [(str(i), ("SMITH", "Jones", "lee", None)[i % 4], (None, "JR", "Sr.", "iii", "ESQ", "")[i % 6]) for i in range(1200)]
    df = spark.createDataFrame(rows, "record_id string, family_name string, name_suffix string")
    fields = channels.suffix_confusion().edit(df, lambda salt: F.pmod(F.xxhash64(F.lit(salt), "record_id"), F.lit(1 << 30)))
    for r, (_, family, was) in zip(df.select(fields["name_suffix"].alias("now"), "record_id").collect(), rows, strict=True):
        now, up = r["now"], (was or "").upper().strip(".")
        if not was:
            assert now in {"SMITH": ("JR", "SR", "II"), "lee": ("jr", "sr", "ii")}.get(family, ("Jr", "Sr", "Ii"))
        else:
            assert now is None or now.upper() in channels.SUFFIXES[up]
    assert df.select(fields["name_suffix"].alias("n")).where("n IS NULL").count() > 300


def test_listing_pages_are_followed():
    from kinforge.sources.loaders import list_snapshots

    def page(keys, token):
        body = "".join(f"<Contents><Key>{k}</Key><Size>{n}</Size></Contents>" for k, n in keys)
        more = f"<IsTruncated>true</IsTruncated><NextContinuationToken>{token}</NextContinuationToken>" if token else "<IsTruncated>false</IsTruncated>"
        return f'<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">{body}{more}</ListBucketResult>'

    pages = {None: page([("d/VR_Snapshot_20200101.zip", 5), ("d/layout.pdf", 1)], "t"), "t": page([("d/VR_Snapshot_20100101.zip", 7), ("d/", 0)], None)}
    got = list_snapshots(lambda q: pages[q.get("continuation-token")], "https://host/")
    assert got == [("20100101", "https://host/d/VR_Snapshot_20100101.zip", 7), ("20200101", "https://host/d/VR_Snapshot_20200101.zip", 5)]


def test_name_spread_rerank_and_groups(spark):
    rows = spark.createDataFrame([("e1", "ann lee"), ("e1", "lee ann"), ("e1", "ann lee fox"), ("e2", "bo"), ("e3", None), ("e3", "  "), (None, "x"), ("e4", "a b"), ("e4", "c d")], "entity_id string, full_name string")
    assert {r[0]: (r[1], round(r[2], 6)) for r in audit.name_spread(rows).collect()} == {"e1": (2, round(1 / 3, 6)), "e2": (1, 0.0), "e4": (2, 1.0)}
    found = spark.createDataFrame([("q", "a", 0.1), ("q", "b", None), ("q", "c", 0.9), ("q", "d", 0.9)], "q string, d string, score double")
    assert [(r["d"], r["rank"]) for r in mining.rerank(found, 3).orderBy("rank").collect()] == [("c", 1), ("d", 2), ("a", 3)]
    units = spark.createDataFrame([(str(i), "ab"[i % 2] if i % 5 else None, float(i % 2), 1.0) for i in range(200)], "unit string, g string, x double, n double")
    got = {r["metric"]: r for r in bootstrap.group_intervals(units, "g", ["a", "b", "none"], "x", "n", 50, 1).collect()}
    assert got["rate:a"]["point"] == 0 and got["rate:b"]["point"] == 1 and got["spread"]["point"] == 1 and got["rate:none"]["point"] is None
    assert got["all"]["point"] == pytest.approx(0.5) and got["all"]["lo"] < 0.5 < got["all"]["hi"]
    delta = {r["metric"]: r for r in bootstrap.paired_rate_delta(units, F.col("x") > 0, F.col("n") > 0, F.col("unit"), 50, 1).collect()}
    assert delta["delta"]["point"] == pytest.approx(-0.5) and delta["rate_b"]["lo"] == 1


def test_running_sums_in_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v), int(n)) for g in ("a", None, "b") for v, n in zip(np.unique(np.round(rng.normal(size=900), 3)), rng.integers(0, 9, 900), strict=False)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for descending in (True, False):
        got = {(r["g"], r["v"]): r["run_n"] for r in prefix.running_sums(df, "v", ["n"], descending, ("g",)).collect()}
        for g in ("a", None, "b"):
            total = 0
            for _, v, n in sorted((x for x in rows if x[0] == g), key=lambda x: -x[1] if descending else x[1]):
                total += n
                assert got[g, v] == total
    assert prefix.running_sums(df.limit(0), "v", ["n"]).count() == 0


def test_stored_tables_are_found_and_deleted(spark, tmp_path):
    kept = session.materialize(spark.range(5), "a table")
    assert kept.count() == 5 and kept.inputFiles()
    session.discard(kept)
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|no such"):
        kept.sparkSession.read.parquet(kept.inputFiles()[0].rsplit("/", 1)[0]).count()
    folder = f"{tmp_path}/with space"
    spark.range(3).write.parquet(folder)
    before = session.stamp(spark.read.parquet(folder))
    assert before == session.stamp(spark.read.parquet(folder)) and len(before) > 0
    spark.range(4).write.mode("overwrite").parquet(folder)
    assert before != session.stamp(spark.read.parquet(folder))
