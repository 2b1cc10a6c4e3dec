"""Agreement patterns and match weights made inside tasks against the joins they replace."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge.functions import strings
from kinforge.operators import blocking, blockpairs, fs

ROLES = ["given_name", "family_name", "dob", "zip", "phone", "email"]


@pytest.fixture(scope="module")
def people(spark):
    r = random.Random(11)
    rows = []
    for i in range(150):
        given, family = r.choice(["Ann", "Anne", "Bob", "", None]), r.choice(["Smith", "Smyth", "Lee", None])
        dob = r.choice(["1980-01-02", "1980-01-12", "1980-05-06", "1981-01-02", "02/03/1980", "", None])
        phone = r.choice(["5550001", "5550002", "555001", None, "", f"555{i:04d}"])
        rows.append((f"r{i:03d}", given, family, dob, r.choice(["10001", "10002", "2000", None]), phone, r.choice([None, f"a{i % 7}@x", "ab@x"])))
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ["record_id", *ROLES])).repartition(3).cache()


def test_bounded_edit_distance_equals_the_full_one():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    r = random.Random(1)
    values = sorted({"".join(r.choice("ab1-é") for _ in range(r.randint(0, 9))) for _ in range(90)})
    i, j = np.divmod(np.arange(len(values) ** 2), len(values))
    for most in (1, 2, 3):
        got = strings.edits_within(strings.code_table(values), i, j, most)
        assert got.tolist() == [min(most + 1, full(values[x], values[y])) for x, y in zip(i, j, strict=True)]


@pytest.mark.parametrize("table", [1024, 0])
def test_pattern_counts_equal_the_join(people, monkeypatch, table):
    monkeypatch.setattr(blockpairs, "TABLE_VALUES", table)
    comparisons = {r: fs.COMPARISONS[r] for r in ROLES}
    for pairs, passes in (
        (blocking.candidates(people), None),
        (people.alias("l").join(people.alias("r"), F.expr("nullif(l.dob, '') = nullif(r.dob, '') AND l.record_id < r.record_id")).select(F.col("l.record_id").alias("a"), F.col("r.record_id").alias("b")), [[strings.empty_to_null(F.col("dob"))]]),
    ):
        got = blockpairs.pattern_counts(people, comparisons, passes)
        assert fs.patterns(got, ROLES) == fs.patterns(fs.gammas(pairs, people, ROLES), ROLES)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("MapInArrow", 1)
        assert "Join" not in plan and "Aggregate" in above and "record_id" not in above  # only counts leave the tasks


def test_certain_pairs_are_counted_from_groups(people):
    want = people.alias("l").join(people.alias("r"), F.expr("nullif(l.given_name, '') = nullif(r.given_name, '') AND nullif(l.dob, '') = nullif(r.dob, '') AND l.record_id < r.record_id")).count()
    assert fs._equal_count(people, ["given_name", "dob"]) == want > 0


def test_block_scores_equal_the_joined_scores(people):
    model = fs.fit(people, ROLES, 2000)
    got = fs.score_blocks(people, model)
    want = fs.score(blocking.candidates(people), people, model)
    rows = lambda df: sorted(map(tuple, df.select("a", "b", "prob").collect()))
    assert rows(got) == rows(want)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "Join" not in above and "Aggregate" not in above and "Repartition" not in above  # pairs are not shuffled
