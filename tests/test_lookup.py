"""Prefix and range lookups against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillgate.functions import noise
from quillgate.operators.lookup import covered_dates, sigma_by_judge
from quillgate.settings import NoiseSettings


def test_dates_meet_by_their_prefixes(spark):
    rng = random.Random(3)

    def date():
        return rng.choice([f"2{rng.randrange(3)}", f"2{rng.randrange(3)}-0{rng.randrange(4)}", f"2{rng.randrange(3)}-0{rng.randrange(4)}-1{rng.randrange(3)}", ""])

    keys = ["hot"] * 5 + ["a", "b", "no pool", None]
    model = [(rng.choice(keys), date()) for _ in range(300)] + [("a", None)]
    pool = [(rng.choice(["hot", "a", "b", "other", None]), date()) for _ in range(6)] + [("hot", "21-01"), ("a", None)]
    schema = "qid string, date string"
    got = covered_dates(spark.createDataFrame(model, schema), spark.createDataFrame(pool, schema), "qid").collect()

    def covered(q, d):
        return any(k == q and q is not None and p is not None and (d.startswith(p) or p.startswith(d)) for k, p in pool)

    assert sorted(map(tuple, got), key=repr) == sorted(((q, d, covered(q, d)) for q, d in set(model) if d is not None), key=repr)
    nothing = spark.createDataFrame([], schema)
    assert covered_dates(nothing, spark.createDataFrame(pool, schema), "qid").count() == 0
    assert not any(r["covered"] for r in covered_dates(spark.createDataFrame(model, schema), nothing, "qid").collect())


@pytest.mark.parametrize("min_rows", [50, 100_000])
def test_sigma_of_a_judge_is_the_ladder_of_its_tiers(spark, min_rows):
    ladders = {
        "hot": NoiseSettings().tiers,
        "one": ((2.0, 0.5),),
        "tied end": ((0.0, 0.1), (5.0, 1.0), (5.0, 2.0)),
        "tie": ((0.0, 0.1), (1.0, 0.2), (1.0, 0.9), (5.0, 1.0)),
        "wide": ((-1e9, 3.0), (0.1, 0.0), (0.1001, 7.0), (1e9, 1.0)),
    }
    xs = [k / 8 for k in range(-8, 70)] + [m for tiers in ladders.values() for m, _ in tiers] + [None, float("nan"), float("inf"), float("-inf"), 0.10005]
    rows = [(i, j, x) for i, (j, x) in enumerate((j, x) for j in [*ladders, "unknown", None] for x in xs)]
    tiers = spark.createDataFrame([(j, m, s) for j, t in ladders.items() for m, s in t], "judge string, mean double, sigma double")
    got = sigma_by_judge(spark.createDataFrame(rows, "id int, judge string, score double"), tiers, min_rows=min_rows)
    assert set(got.columns) == {"id", "judge", "score", "sigma"}
    found = {r["id"]: r["sigma"] for r in got.collect()}
    assert len(found) == len(rows)
    for judge, tier in ladders.items():
        mine = spark.createDataFrame([r for r in rows if r[1] == judge], "id int, judge string, score double")
        want = mine.select("id", noise.sigma_of_score("score", NoiseSettings(tiers=tier)).alias("sigma")).collect()
        for r in want:
            assert found[r["id"]] == (None if r["sigma"] is None else pytest.approx(r["sigma"], abs=1e-9)), (judge, r)
    assert all(found[i] is None for i, j, _ in rows if j in ("unknown", None))
    assert sigma_by_judge(spark.createDataFrame(rows, "id int, judge string, score double").filter(F.lit(False)), tiers).count() == 0
