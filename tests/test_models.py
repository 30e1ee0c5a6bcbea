"""Models on planted data: what a fit must give whatever its numbers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from siftspark.operators import matching, models
from siftspark.operators import recommend as R


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        x = rng.random()
        y = int(rng.random() < (0.9 if x > 0.5 else 0.1))
        rows.append((i, x if i % 20 else None, rng.random(), y, 1 - y, int(x > 0.7)))
    return spark.createDataFrame(rows, "id long, x double, z double, y int, other int, flag int").cache()


def rank_share(rows):
    pos, neg = [p for p, y in rows if y == 1], [p for p, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_targets(planted):
    got = models.one_vs_rest(planted, ["x", "z"], ["y", "other"]).select("p_y", "p_other", "y").collect()
    assert rank_share([(r.p_y, r.y) for r in got]) > 0.85
    assert rank_share([(r.p_other, 1 - r.y) for r in got]) > 0.85


def test_cross_validation_and_platt(planted):
    got = models.cross_validated(planted, "id", ["x", "z"], "y").select("id", "probability", "y").collect()
    assert sorted(r.id for r in got) == list(range(600))
    assert rank_share([(r.probability, r.y) for r in got]) > 0.85
    own = models.platt(planted, "id", ["x", "z"], "y").select("probability", "y").collect()
    # a logistic regression with an intercept keeps the mean
    assert sum(r.probability for r in own) / 600 == pytest.approx(sum(r.y for r in own) / 600, abs=0.01)


def test_recalibration_is_monotone_and_keeps_the_mean(planted):
    got = models.recalibrated(planted.filter("x IS NOT NULL"), "x", "y").select("x", "calibrated", "y").orderBy("x").collect()
    values = [r.calibrated for r in got]
    assert values == sorted(values)
    assert sum(values) / len(values) == pytest.approx(sum(r.y for r in got) / len(got), abs=1e-3)


def test_odds_ratio_of_one_indicator(planted):
    n = {(r.flag, r.y): r["count"] for r in planted.groupBy("flag", "y").count().collect()}
    assert models.odds_ratios(planted, ["flag"], "y")["flag"] == pytest.approx(n[1, 1] * n[0, 0] / (n[1, 0] * n[0, 1]), rel=0.01)


def test_external_validation(planted):
    model = models.fit_target(planted.filter("id < 300"), ["x", "z"], "y")
    got = models.external_validation(model, planted.filter("id >= 300"), ["x", "z"], "y").first()
    rows = [(r.probability, r.y) for r in models.predict(model, planted.filter("id >= 300"), ["x", "z"]).collect()]
    tp, fn = sum(p >= 0.5 and y == 1 for p, y in rows), sum(p < 0.5 and y == 1 for p, y in rows)
    assert (got.tp, got.fn) == (tp, fn)
    assert got.auc == pytest.approx(rank_share(rows), abs=1e-5)
    assert got.brier == pytest.approx(sum((p - y) ** 2 for p, y in rows) / len(rows), abs=1e-5)


def test_target_risks(planted):
    fitted = {y: models.fit_target(planted, ["x", "z"], y) for y in ("y", "other")}
    got = models.target_risks(planted.filter("id < 3"), "id", fitted, ["x", "z"], "v1", "v1", excluded=("other",)).collect()
    assert [(r.id, r.target) for r in got] == [(0, "y"), (1, "y"), (2, "y")]
    with pytest.raises(ValueError, match="contract"):
        models.target_risks(planted, "id", fitted, ["x"], "v1", "v2")


def test_mapped_features(spark):
    df = spark.createDataFrame([(1, "3", None), (2, "x", "4")], "id long, a string, b string")
    got = [tuple(r) for r in models.mapped_features(df, "id", {"f": "a", "g": "b", "h": "none"}, {"g": 2.0}).orderBy("id").collect()]
    assert got[0][1] == 3.0
    assert got[1][2] == 8.0
    assert all(math.isnan(v) for v in (got[0][2], got[0][3], got[1][1], got[1][3]))


def test_generated_rows_are_the_same_in_every_run(spark):
    a, b = (models.generated(spark, 4000, seed, {"q": 0.3, "r": 0.7}) for seed in (1, 1))
    assert a.exceptAll(b).count() == 0
    assert a.agg(F.avg("q"), F.avg("r")).first()[0] == pytest.approx(0.3, abs=0.03)
    assert a.join(models.generated(spark, 4000, 2, {"q": 0.3, "r": 0.7}).withColumnRenamed("q", "q2"), "id").filter("q != q2").count() > 1000


def test_names(spark):
    cases = [
        ("magnesio", "MAGNESIO", 1.0), ("pantene pro v", "PRO", 0.0), ("vitamina c acme 500", "Vitamina C Acme", 1.0), ("calcio citrato", "calcio citrato con magnesio", 1.0), ("calcio citrato forte", "calcio magnesio citrato", None), ("calcio forte", "hierro forte", 0.0), ("", "calcio forte", 0.0), ("calcio forte", "", 0.0),
    ]
    df = spark.createDataFrame([(i, q, n) for i, (q, n, _) in enumerate(cases)], "i int, q string, n string")
    got = {r.i: r.s for r in df.select("i", matching.name_score(F.col("q"), F.col("n")).alias("s")).collect()}
    for i, (q, n, want) in enumerate(cases):
        assert got[i] == want if want is not None else 0 < got[i] < 1, (q, n)
    pairs = spark.createDataFrame([("abcd", "bcde", 0.75), ("aa", "aa", 1.0), ("ab", "cd", 0.0), (None, "x", None)], "a string, b string, want double")
    assert all(r.got == r.want for r in pairs.withColumn("got", matching.sequence_ratio(F.col("a"), F.col("b"))).collect())


def test_best_match(spark):
    pairs = spark.createDataFrame([(1, 7, 0.9), (1, 5, 0.9), (1, 3, 0.8), (2, 4, 0.2)], "l long, r long, similarity double")
    assert [tuple(x) for x in matching.best_match(pairs, "l", "r", 0.5).collect()] == [(1, 5, 0.9)]


def test_ratings_follow_the_votes(spark):
    votes = [("a", "x", 1.0, 5.0)] * 10 + [("b", "x", 0.0, 1.0)] * 9 + [("b", "y", 0.0, 2.0)] * 3 + [("c", "x", 1.0, 5.0)] * 2
    v = spark.createDataFrame(votes, "item string, context string, reward double, rating double")
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "item string, context string")
    got = {r["item"]: (r.stars, r.rated, r.rating_score, r.rating_level) for r in R.item_ratings(items, v, "item", "context", "reward", "rating").collect()}
    assert got == {"a": (5.0, 10, 0.8, "context"), "b": (1.3, 12, 0.4375, "global"), "c": (None, 0, 0.7, "insufficient"), "d": (None, 0, 0.7, "none")}
