"""What shows only on larger tables: rows that come in another order, sizes beyond a bound, sums by order."""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import functions as F

from siftspark.operators import decisions, extraction, ranking, recommend


def test_current_doses_of_rows_in_any_order(spark):
    def shuffled(batches):  # like rows after a shuffle: each reading has another order
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pylist(random.SystemRandom().sample(b.to_pylist(), b.num_rows), b.schema)

    items = spark.range(400).selectExpr("id AS k", "IF(id % 3 = 0, 'Vitamina D3', IF(id % 3 = 1, 'Magnesio plus', 'Other')) AS name").coalesce(1).mapInArrow(shuffled, "k long, name string")
    taken = spark.range(200).selectExpr("id * 2 AS k", "0 AS place", "'magnesio' AS supplement", "200D AS amount", "'mg' AS unit")
    words = spark.createDataFrame([("vitamina_d", "vitamina d"), ("magnesio", "magnesio")], "supplement string, keyword string")
    got = decisions.current_doses(items, "k", "name", taken, words).collect()
    assert len(got) == 400
    assert all((r.supplement, r.dose_status, r.blocked) == (("magnesio", "covered", True) if r.k % 3 == 1 and r.k % 2 == 0 else (None, None, False)) for r in got)


def test_current_doses_of_repeated_items_and_the_first_taken(spark):
    items = spark.createDataFrame([(1, "Magnesio y vitamina D"), (1, "Magnesio y vitamina D"), (None, "Magnesio"), (2, None)], "k int, name string")
    taken = spark.createDataFrame([(1, 1, "magnesio", 400.0, "mg"), (1, 0, "vitamina_d", 10.0, "mcg"), (1, 0, "vitamina_d", None, "mcg"), (2, 0, "magnesio", 1.0, "mg"), (None, 0, "magnesio", 1.0, "mg")], "k int, place int, supplement string, amount double, unit string")
    words = spark.createDataFrame([("vitamina_d", "Vitamina D"), ("magnesio", "magnesio")], "supplement string, keyword string")
    got = decisions.current_doses(items, "k", "name", taken, words).collect()
    assert sorted(((r.k, r.supplement, r.dose_status, r.blocked) for r in got), key=str) == [(1, "vitamina_d", "unknown", True), (1, "vitamina_d", "unknown", True), (2, None, None, False), (None, None, None, False)]


def test_item_ratings_add_rewards_in_their_order(spark):
    rows = [(i % 5, "c", r, float(i % 5 + 1), i) for i, r in enumerate([0.1, 0.3, 0.2, 0.9, 1.0, 0.7, 0.0, 0.6, 0.5, 0.4, 0.8] * 40)]
    one_by_one = lambda values: functools.reduce(lambda a, b: a + b, values) / len(values)
    want = {k: one_by_one([r[2] for r in rows if r[0] == k]) for k in range(5)}
    assert want != {k: one_by_one(sorted(r[2] for r in rows if r[0] == k)) for k in range(5)}  # so the order matters here
    for parts in (1, 3, 7):
        votes = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "item int, context string, reward double, rating double, at int").repartition(parts)
        per, every = recommend._means(votes, "item", "context", ["reward", "rating"], ["at"])
        assert {r.item: tuple(r._c) for r in per.collect()} == {r.item: tuple(r._g) for r in every.collect()} == {k: (v, k + 1.0, 88) for k, v in want.items()}


def test_item_ratings_round_scaled_doubles(spark):
    rewards = [0.3] * 41 + [0.4] * 19  # give 0.42374999999999996, and that times 10,000 is 4237.5
    votes = spark.createDataFrame([(1, "c", r, 3.0, i) for i, r in enumerate(rewards)], "item int, context string, reward double, rating double, at int")
    got = recommend.item_ratings(spark.createDataFrame([(1, "c")], "item int, context string"), votes, "item", "context", "reward", "rating", order=["at"]).first()
    assert (got.rating_score, got.stars, got.rating_level, got.rated) == (0.4238, 3.0, "context", 60)


def test_similar_components_of_more_vectors_than_one_cell_holds(spark):
    n = 100_500  # each vector stands twice, so names decide
    vectors = spark.range(n).selectExpr("concat('c', id) AS component", "transform(sequence(0, 2), i -> cast(xxhash64(id % 50250, i) % 1000 / 1000D as float)) AS embedding")
    seeds = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "c1"), (2, "c2"), (2, "c2"), (3, "c7")], "k int, component string")
    rows = vectors.collect()
    m, names = np.array([r.embedding for r in rows], float), np.array([r.component for r in rows])
    want = []
    for k, own in ((1, ["c1", "c2"]), (2, ["c1", "c2"]), (3, ["c7"])):
        c = m[[int(o[1:]) for o in own]].mean(axis=0)
        sim = (m * c).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((c * c).sum()) + 1e-8)
        sim[[int(o[1:]) for o in own]] = -1
        best = np.lexsort((names, -sim.round(12)))[:20]
        want += [(k, names[b], round(float(sim[b]), 4), i + 1) for i, b in enumerate(best[:3])]
    edges = vectors.select(F.col("component").alias("a"), F.explode(F.array(F.lit("c1"), F.lit("c7"))).alias("b"))
    none = spark.createDataFrame([], "component string, canonical string")
    got = recommend.similar_components(seeds, "k", vectors, edges, none).collect()
    assert sorted((r.k, r.component, r.similarity, r.place) for r in got) == sorted(want)


def test_nearest_is_the_same_in_cells_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m, c = rng.normal(size=(600, 8)), rng.normal(size=(90, 8))
    own = [[f"c{j}" for j in rng.integers(0, 600, 4)] for _ in range(90)]
    vectors = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(m)] + [("none", None)], "component string, embedding array<double>")
    centres = spark.createDataFrame([(i, v.tolist(), o) for i, (v, o) in enumerate(zip(c, own, strict=True))], "k int, _c array<double>, _own array<string>")
    sim = (c @ m.T) / (np.sqrt((c * c).sum(axis=1))[:, None] * np.sqrt((m * m).sum(axis=1)) + 1e-8)
    for i, o in enumerate(own):
        sim[i, [int(x[1:]) for x in o]] = -1
    want = {(i, f"c{j}", rank + 1) for i, row in enumerate(sim) for rank, j in enumerate(np.argsort(-row)[:5]) if row[j] >= 0.3}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys, columns in ((1000, 1000), (20, 1000), (1000, 50), (20, 50)):
            monkeypatch.setattr(recommend, "CELL_KEYS", keys)
            monkeypatch.setattr(recommend, "CELL_VECTORS", columns)
            assert {(r.k, r.component, r["_rank"]) for r in recommend._nearest(centres, "k", vectors, 0.3, 5).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packs_with_equal_components_share_a_selection(spark, monkeypatch):
    rng = random.Random(5)
    offers = [(c, rng.randrange(12), rng.randrange(3), rng.randrange(10) / 10, rng.random() < 0.2) for c in range(6) for _ in range(5)]
    offers = list({o[:3]: o for o in offers}.values())
    kinds = [rng.sample(range(7), rng.randrange(1, 5)) for _ in range(12)]  # component 6 has no offers
    packs = [(i, kinds[i % 12]) for i in range(300)]

    def greedy(components):
        used, shops, out = set(), [], []
        for slot, c in enumerate(components, 1):
            before = list(shops)
            ranked = sorted((o for o in offers if o[0] == c and not o[4]), key=lambda o: (-(o[3] + 0.06 * max(0.35, 1 - 0.20 * before.count(o[2]))), o[1], o[2]))
            for o in ranked:
                if o[1] not in used and sum(x[0] == slot for x in out) < 2:
                    used.add(o[1])
                    shops.append(o[2])
                    out.append((slot, o[1], o[2]))
        return out

    computed = []
    one_by_one = ranking.greedy_selection
    monkeypatch.setattr(ranking, "greedy_selection", lambda c, pack, *a, **k: computed.append(c.select(pack).distinct().count()) or one_by_one(c, pack, *a, **k))
    df = spark.createDataFrame(packs, "pack long, components array<int>").repartition(3)
    o = spark.createDataFrame(offers, "component int, product int, shop int, score double, blocked boolean")
    got = ranking.selection_of_packs(df, "pack", "components", o, "component", "product", "shop", "score", per_slot=2, blocked="blocked").collect()
    assert sorted(map(tuple, got)) == sorted((p, *x) for p, c in packs for x in greedy(c))
    assert computed[0] <= 12


def test_lines_meet_few_aliases_without_a_shuffle_of_their_words(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"Glucosa {90 + i} mg/dl 70 - 100\nCalcio 9,5 mg/dl") for i in range(5)], "k int, text string")
    aliases = spark.createDataFrame([("glucosa", "glucose"), ("calcio", "calcium")], "alias string, code string")
    values = lambda: extraction.lab_values(df, "text", ["k"], aliases)
    few = values()
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    want = [(i, c, v, "mg/dL") for i in range(5) for c, v in (("calcium", 9.5), ("glucose", 90.0 + i))]
    assert sorted(tuple(r)[:4] for r in few.collect()) == want
    monkeypatch.setattr(extraction, "MOST_BROADCAST", 1)
    many = values()
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[:4] for r in many.collect()) == want
