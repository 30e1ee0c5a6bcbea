"""Labels fitted in one pass, and links predicted from sampled neighbours, on planted data."""

from __future__ import annotations

import random
import tempfile

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from siftspark.operators import evaluation, linkmodel, multilabel


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        a, b, c = rng.gauss(5, 2), rng.choice([None, rng.gauss(0, 1)]), rng.choice(["x", "y", "z", None])
        p = 1 / (1 + np.exp(-(0.8 * (a - 5) + (1.5 if c == "x" else 0) - 0.4)))
        q = 1 / (1 + np.exp(-(2.0 if b is None else b)))
        rows.append((i, a, b, c, int(rng.random() < p), rng.choice([None, int(rng.random() < q)]), int(rng.random() < 0.1)))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    spark.createDataFrame(rows, "id int, a double, b double, c string, l1 int, l2 int, l3 int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_labels_together_equal_single_fits(spark, planted):
    labels = ["l1", "l2", "l3"]
    both = multilabel.fit_labels(planted, ["a", "b"], ["c"], labels)
    assert both.names() == ["a", "b", "a_missing", "b_missing", "c=x", "c=y", "c=z"]
    for i, label in enumerate(labels):
        alone = multilabel.fit_labels(planted, ["a", "b"], ["c"], [label])
        assert np.abs(np.array(alone.weights[0]) - both.weights[i]).max() < 1e-4
        own = planted.filter(F.col(label).isNotNull())
        share = own.agg(F.avg(label)).first()[0]
        design = own.select(*[(x / s).alias(f"x{k}") for k, (x, s) in enumerate(zip(both.features(), both.scale, strict=True))], F.col(label).cast("double").alias("y"), F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)).alias("w"))
        model = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.01, standardization=False, maxIter=500, tol=1e-12).fit(VectorAssembler(inputCols=[f"x{k}" for k in range(7)], outputCol="f").transform(design))
        assert np.abs(np.append(model.coefficients.toArray(), model.intercept) - both.weights[i]).max() < 1e-3
    scored = both.predict(planted)
    assert scored.columns == [*planted.columns, "p_l1", "p_l2", "p_l3"]
    auc = evaluation.auc(scored.withColumn("k", F.lit(1)), ["k"], F.col("p_l1"), F.col("l1")).first()
    assert auc["auc"] > 0.75


def test_jobs_dont_follow_the_labels(spark, planted):
    sc = spark.sparkContext

    def jobs(labels):
        group = f"fit-{len(labels)}"
        sc.setJobGroup(group, group)
        multilabel.fit_labels(planted, ["a", "b"], ["c"], labels, max_iter=3, tol=0)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    assert jobs(["l1"]) == jobs(["l1", "l2", "l3", "l1", "l2", "l3"])


def test_odd_tables(spark, planted):
    none = multilabel.fit_labels(planted.filter("false"), ["a"], ["c"], ["l1"])
    assert none.predict(planted.limit(3)).filter("p_l1 = 0.5").count() == 3
    with pytest.raises(ValueError, match="more than"):
        multilabel.fit_labels(planted, [], ["id"], ["l1"], most_values=10)


def blocks(n, groups, inside, seed):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a % groups == b % groups else 0.004)]


def test_links_of_a_planted_graph(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    edges = spark.createDataFrame([*blocks(160, 4, 0.7, 5), (3, 3), (8, 0), (0, 8)], "a long, b long")
    split = linkmodel.split_edges(linkmodel.simple_edges(edges))
    share = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    total = sum(share.values())
    assert abs(share["train"] / total - 0.70) < 0.04 and abs(share["test"] / total - 0.15) < 0.04
    nodes = spark.range(160).withColumnRenamed("id", "node")
    linkmodel.examples_of(split, linkmodel.hashed_features(nodes, 16), 16).coalesce(4).write.parquet(f"{path}/examples")
    examples = spark.read.parquet(f"{path}/examples")
    known = {tuple(r) for r in split.select("a", "b").collect()}
    false = [(r.a, r.b) for r in examples.filter("y = 0").select("a", "b").collect()]
    assert not known & set(false) and len(false) > 0.5 * total and all(a < b for a, b in false)
    model = linkmodel.train_links(examples, 16)
    scored = linkmodel.scored_links(examples.filter("split = 'test'"), model).withColumn("k", F.lit(1))
    auc = evaluation.auc(scored, ["k"], F.col("score"), F.col("y")).first()["auc"]
    assert auc >= 0.9, (auc, model.validation_auc, model.epochs)


def test_slopes_are_differences_of_the_loss(spark):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    dims, rows = 3, 5
    lists = lambda counts: pa.array([rng.normal(size=2 * dims * c).astype(np.float32).tolist() for c in counts], pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1, 0, 1]), lists([1] * rows), lists([2, 0, 3, 1, 1]), lists([1] * rows), lists([0, 1, 2, 2, 4])], ["y", "own_a", "around_a", "own_b", "around_b"])
    weights = linkmodel._start(dims, 4, 3, 1)
    got = linkmodel._slopes(batch, dims, weights)
    at = 2
    for w in weights:
        for i in range(w.size):
            losses = []
            for d in (1e-6, -1e-6):
                w.ravel()[i] += d
                losses.append(linkmodel._slopes(batch, dims, weights)[0])
                w.ravel()[i] -= d
            assert abs((losses[0] - losses[1]) / 2e-6 - got[at]) < 1e-4 * max(1, abs(got[at]))
            at += 1
    assert got[1] == rows


def test_a_hub_keeps_its_sample(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 200)], "a long, b long")
    n = {r.node: r["count"] for r in linkmodel.sampled_neighbours(edges, 10).groupBy("node").count().collect()}
    assert n[0] == 10 and all(n[i] == 1 for i in range(1, 200))
