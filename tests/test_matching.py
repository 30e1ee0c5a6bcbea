from __future__ import annotations

from siftspark.operators import matching


def test_frequent_words_make_candidates(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04d}")
    right = spark.createDataFrame([(i, f"common {word(i)}") for i in range(2500)] + [(9000, "common aaab"), (9001, "other")], "r long, rt string")
    left = spark.createDataFrame([(1, "Common xyz"), (2, "common aaab"), (3, "nothing"), (4, None)], "l long, lt string")
    got = {(x.l, x.r): (x.shared, x.similarity) for x in matching.token_candidates(left, right, "lt", "rt", "l", "r").collect()}
    ids = [*range(2500), 9000]
    same = {1, 9000}
    want = {(1, i): (1, 0.333333) for i in ids} | {(2, i): (2, 1.0) if i in same else (1, 0.333333) for i in ids}
    assert got == want
    assert matching.token_candidates(left, right, "lt", "rt", "l", "r").count() == len(want)
