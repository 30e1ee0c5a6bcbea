from __future__ import annotations

import random
import re

from siftspark.llm import minhash_dedup


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.setdefault(i, []).append(set(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else {tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_components_are_brute_force(make, prose):
    rows = []
    for g in range(12):  # families of copies that share one origin, which isn't the smallest id
        base = prose(1000 + g, 200)
        rows += [(g * 10 + k, edited(base, 3, g * 100 + k) if k != 7 else base) for k in range(9)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO"), (505, "one"), (506, "é É"), (507, "É é"), (500, None), (508, prose(1, 20000)), (509, prose(1, 20000).upper()), (510, "a b c"), (511, "a b c a b c")]
    for words, percent in ((3, 85), (5, 80)):
        got = minhash_dedup.near_duplicates(make(rows), words=words, percent=percent)
        want = brute(rows, words, percent)
        assert got.count() == len(rows)
        for r in got.collect():
            assert r.component_id == want[r.doc_id], (r, want[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)


def test_null_ids_and_empty_table(make, prose):
    got = minhash_dedup.near_duplicates(make([(None, prose(1, 50)), (4, prose(1, 50)), (None, "alone in the world")])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.component_id is not None)[0] == (False, 4)
    assert minhash_dedup.near_duplicates(make([])).count() == 0


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a long, b long")
    got = {r.node: r.component for r in minhash_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(101))
    assert got[201] == 200


def test_pairs_of_a_template_family(make, prose):
    base, rows = prose(77, 400, 10**6), []
    for g in range(200):  # pairs are 0.87 alike, strangers 0.80: their buckets hold the whole family
        origin = edited(base, 3, 10 * g)
        rows += [(2 * g, edited(origin, 4, 10 * g + 1)), (2 * g + 1, edited(origin, 5, 10 * g + 2))]
    random.Random(5).shuffle(rows)
    rows = [(n, text) for n, (_, text) in enumerate(rows)]
    want = brute(rows, 3, 85)
    assert sum(want[i] != i for i in want) > 150
    assert len(set(want.values())) > 150
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(make(rows), words=3, percent=85).collect()}
    assert got == want


def test_given_documents_are_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for words, percent in ((3, 85), (5, 80)):
        want = brute(rows, words, percent)
        assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, words=words, percent=percent).collect()} == want
