from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from siftspark.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def brute(rows, k):
    own = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q, v in own:
        if q % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in own if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-64, 64) / 64 for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, 0.0, "x") for i, v in rows], SCHEMA)
    for group, chunk in ((4 << 20, 256), (4096, 16)):
        got = topk_search.top_k(df, F.col("vec_id") % 3 == 0, k=5, group_bytes=group, chunk=chunk)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, 5)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0, "x"), (1, [0.5], 1, 0.0, "x")], SCHEMA)
    assert [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 512)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_blocks_are_skipped(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):  # 30 clusters, each of its own direction
        at = [rng.gauss(0, 0.02) for _ in range(16)]
        at[i % 30 % 16] += 1 if i % 30 < 16 else -1
        rows.append((i, [round(x * 4096) / 4096 for x in at], 1, 0.0, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    scored = spark.sparkContext.accumulator(0)
    got = topk_search.top_k(df, F.col("vec_id") % 3 == 0, k=5, group_bytes=1 << 16, scored=scored).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute([(r[0], r[1]) for r in rows], 5)
    blocks = 3000 / topk_search.BLOCK * 1000
    assert 0 < scored.value < 0.25 * blocks
