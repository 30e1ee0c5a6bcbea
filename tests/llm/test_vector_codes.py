from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftspark.llm import vector_codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, code, error, label_error) of rows (id, vector, label), with Python's integers, and the codebooks."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for c in cut:
                mine[near(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(z) // len(m) for z in zip(*m, strict=True)] if m else old for m, old in zip(mine, books[p], strict=True)]
    out = []
    for (i, _, lab), c in zip(kept, cut, strict=True):
        got = [near(c[p], books[p]) for p in range(parts)]
        out.append([i, bytes(g[0] for g in got), sum(g[1] for g in got), lab])
    total = Counter()
    for _, _, e, lab in out:
        total[lab] += e
    text = ",".join(str(x) for b in books for c in b for x in c)
    return [(i, c, e, total[lab]) for i, c, e, lab in out], hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, b"c", 1, 2) for i, v, lab in rows], "vec_id long, embedding array<double>, label string, code binary, error int, _label int")


def held(spark, rows, **how):
    got = vector_codes.compress_vectors(frame(spark, rows), **how).collect()
    want, sha = brute(rows, **how)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.vec_id, bytes(r.code), r.error, r.label_error) for r in got], key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} <= {sha}


def test_codes_are_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice(["a", "b", None])) for i in range(60)]
    rows += [rows[3], rows[3], (7, rows[9][1], "a"), (None, rows[1][1], None), (None, [0.0] * 8, "b"), (70, [rng.choice([-1.0, 1.0]) for _ in range(8)], "a")]
    odd = [(80, None, "a"), (81, [1.0, None] * 4, "a"), (82, [float("nan")] * 8, "a"), (83, [float("inf")] + [0.0] * 7, None), (84, [-float("inf")] + [0.0] * 7, None)]
    held(spark, rows + odd, entries=10)
    held(spark, rows[:5], entries=256, rounds=2)
    held(spark, [(i, [float(i % 2)] * 4, None) for i in range(9)], entries=4)  # ties everywhere, unused entries


def test_empty_and_refused(spark):
    assert vector_codes.compress_vectors(frame(spark, [])).collect() == []
    assert vector_codes.compress_vectors(frame(spark, [(1, None, "a")])).collect() == []
    for bad in ([(1, [1.0] * 6, "a")], [(1, [1.0] * 8, "a"), (2, [1.0] * 4, "a")], [(1, [1e300] * 8, "a")]):
        with pytest.raises(Exception, match="components|different lengths|exact up to"):
            vector_codes.compress_vectors(frame(spark, bad)).collect()


def test_large_components_take_several_limbs(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-200_000, 200_000) for _ in range(8)], "a") for i in range(30)]
    assert len(vector_codes.limbs(np.array([[200_000 * 1024]]), vector_codes.limb_width(2))) == 2
    held(spark, rows, entries=8)


@pytest.mark.parametrize("depth", [1, 2, 16, 100])
def test_exact_dot(depth):
    rng = np.random.default_rng(depth)
    most = vector_codes.largest(depth)
    for top in (1, 1000, 1 << 20, most):
        x, y = (rng.integers(-top, top + 1, (7, depth)) for _ in range(2))
        x[0], y[0] = top, -top
        want = [[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in y] for r in x]
        assert vector_codes.exact_dot(x, y).tolist() == want
        at, far = vector_codes.nearest(x, y)
        for r, i, d in zip(x, at, far, strict=True):
            all_d = [sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in y]
            assert (int(i), int(d)) == (all_d.index(min(all_d)), min(all_d))


def test_codes_decode_to_their_error(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], "a") for i in range(40)]
    df = frame(spark, rows)
    codes = vector_codes.train(df, entries=6)
    vectors = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows}
    for r in vector_codes.encode(df, codes, ["vec_id"]).collect():
        assert r.error == sum((a - b) ** 2 for a, b in zip(vectors[r.vec_id], codes.decoded(bytes(r.code)), strict=True))
