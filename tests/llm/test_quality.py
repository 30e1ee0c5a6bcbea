from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.llm import pu_quality
from siftspark.llm.queries import QUERIES, held_out_rows


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality"](spark, d).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").df().set_index("doc_id").quality
    both = got[got.held_out].join(labels, how="inner")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert (good.predicted == 1).mean() > 0.9
    assert (bad.predicted == 0).mean() > 0.9
    assert np.mean(good.score.values[:, None] > bad.score.values[None, :]) > 0.97
    assert got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()


def test_odd_rows(spark, make, prose):
    rows = [(i, prose(i, 60)) for i in range(40)] + [(i, "### $$$ !!! " * 30) for i in range(40, 60)] + [(90, None), (91, ""), (0, prose(0, 60)), (None, "a b")]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(5, 0), (31, None), (999, 1)], "doc_id long, quality int")
    got = pu_quality.score_quality(make(rows), labels, held_out_rows()).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    kept = pu_quality.keep_good(make(rows), labels, held_out_rows(), 0.5)
    assert kept.columns == make(rows).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.score >= 0.5)
    assert pu_quality.keep_good(make(rows), labels.filter("quality = 7"), held_out_rows()).count() == len(rows)
    assert pu_quality.score_quality(make([]), labels, held_out_rows()).count() == 0
    none = pu_quality.score_quality(make(rows), labels.filter("quality = 7"), held_out_rows())
    assert {r.score for r in none.collect()} == {0.5}


def test_prior_of_known_mixture():
    p, u = np.zeros(10), np.zeros(10)
    p[9], u[9], u[0] = 100_000, 70_000, 30_000
    assert pu_quality.estimate_prior(p, u) == pytest.approx(0.7, abs=0.01)


def test_labels_of_held_out_rows_are_not_learned(spark, make, prose):
    rows = [(i, prose(i, 50)) for i in range(40)]
    a = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    b = a.withColumn("quality", F.when(held_out_rows(), 0).otherwise(F.col("quality")))
    score = lambda x: {r.doc_id: r.score for r in pu_quality.score_quality(make(rows), x, held_out_rows()).collect()}
    assert score(a) == score(b)


def test_risk_and_its_slopes():
    rng = np.random.default_rng(3)
    loss = lambda z, y: np.log1p(np.exp(-z if y else z)).mean()
    for zp, zu, below in ((rng.normal(1, 1, 30), rng.normal(2, 1, 50), False), (rng.normal(2, 1, 30), rng.normal(-3, 1, 50), True)):
        total, negative, by_p, by_u = pu_quality.risk(zp, zu, 0.6)
        assert negative == pytest.approx(loss(zu, 0) - 0.6 * loss(zp, 0))
        assert (negative < 0) == below
        assert total == pytest.approx(0.6 * loss(zp, 1) + max(0.0, negative))
        own = (lambda p, u: -pu_quality.risk(p, u, 0.6)[1]) if below else (lambda p, u: pu_quality.risk(p, u, 0.6)[0])  # noqa: B023
        for i in (0, 7, 20):
            step = np.zeros(30)
            step[i] = 1e-5
            assert by_p[i] == pytest.approx((own(zp + step, zu) - own(zp - step, zu)) / 2e-5, abs=1e-6)
            step = np.zeros(50)
            step[i] = 1e-5
            assert by_u[i] == pytest.approx((own(zp, zu + step) - own(zp, zu - step)) / 2e-5, abs=1e-6)
