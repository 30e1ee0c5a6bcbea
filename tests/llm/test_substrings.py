from __future__ import annotations

import random

import numpy as np
import pytest

from siftspark.llm import substring_dedup

BIG = (1 << 63) - 1


def brute(rows, window=13):
    words = [(text or "").encode().split() for _, text in rows]
    ids = [BIG if i is None else i for i, _ in rows]
    owner = {}
    for i, w in zip(ids, words, strict=True):
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            owner[g] = min(owner.get(g, i), i)
    out = []
    for (i, _), own, w in zip(rows, ids, words, strict=True):
        gone = {s + k for s in range(len(w) - window + 1) if owner[tuple(w[s : s + window])] < own for k in range(window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def held(make, rows, **how):
    df = make(rows)
    got = substring_dedup.dedup_substrings(df, **how)
    assert set(df.columns) <= set(got.columns)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], key=key) == sorted(brute(rows, how.get("window", 13)), key=key)


def planted(seed, n, prose):
    """Texts with passages of each other, at all shifts, and words so few that short anchors repeat."""
    rng = random.Random(seed)
    passages = [prose(1000 + k, rng.randrange(10, 60)) for k in range(8)]
    out = []
    for i in range(n):
        parts = [prose(seed * 7919 + i * 10 + k, rng.randrange(0, 25), rng.choice([2, 400])) for k in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages).split()
            a = rng.randrange(0, max(1, len(p) - 12))
            parts.insert(rng.randrange(4), " ".join(p[a : a + rng.randrange(11, 40)]))
        out.append((i * 3 % n if rng.random() < 0.95 else None, rng.choice([" ", "\n", "\t "]).join(parts)))
    return out


@pytest.mark.parametrize("how", [{}, {"period": 1}, {"period": 3}, {"window": 30}, {"window": 5}, {"window": 1}])
def test_dedup_is_brute_force(make, prose, how):
    rows = planted(1, 70, prose)
    rows += [rows[3], (500, rows[3][1]), (2, rows[3][1]), (None, rows[5][1]), (None, None), (501, ""), (502, " \n\x0b "), (503, "a b"), (None, rows[5][1])]
    rows += [(504, "w " * 300), (505, "w " * 13), (506, "é ü\xa0x " * 20), (507, " ".join(rows[3][1].split()))]
    held(make, rows, **how)


def test_long_texts_small_chunks_and_hot_passages(make, prose, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 200)
    monkeypatch.setattr(substring_dedup, "SHARD", 50)
    shared = prose(3, 40)
    rows = [(i, prose(50 + i, 20) + " " + shared + " " + prose(90 + i, i)) for i in range(60)] + [(100 + i, shared) for i in range(40)] + [(200, prose(7, 30_000) + " " + shared)]
    held(make, rows)
    assert substring_dedup.dedup_substrings(make([])).collect() == []
    held(make, [(1, None), (None, None)])


def test_covers_hold_every_difference():
    assert substring_dedup.difference_cover(7) == (0, 1, 3)
    for period in range(1, 22):
        cover = substring_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substring_dedup.period_for(13) == 7


def test_any_two_windows_share_an_anchor():
    """Two places of one window, in texts of their own, always have an anchor at one shift."""
    for window, period in ((13, 7), (30, 21), (9, 3)):
        for a in range(period):
            for b in range(period):
                places = [set(substring_dedup.anchor_places(at + window + after, window, period).tolist()) for at, after in ((a, 0), (b, 5))]
                assert any(a + k in places[0] and b + k in places[1] for k in range(period))


def test_fewer_anchors_than_windows():
    places = substring_dedup.anchor_places(7_000, 13, 7)
    assert len(places) <= 7_000 * 3 / 7 + 3 and np.all(np.diff(places) > 0)
