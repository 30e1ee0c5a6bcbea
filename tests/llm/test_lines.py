from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from siftspark.llm import line_dedup, line_rules

SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


ROWS = [
    (3, "The same long line\nshort\nÀ line of its own é"), (1, " the SAME long line \t\nunique words here"), (2, "short\nshort\nthe same long line\nthe same long line"), (5, None), (6, ""), (7, "\n\n"),
    (8, "twice in one text\ntwice in one text"), (9, "À LINE OF ITS OWN É"), (3, "The same long line\nshort\nÀ line of its own é"), (None, "unique words here\nnull id line here"), (11, "x" * 50_000 + "\nthe same long line"), (12, "123456789\n1234567890"), (13, "123456789\n1234567890"),
]


def brute_lines(rows):
    big = 1 << 63
    owner, seen = {}, defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = lower(line.strip(SPACES))
            if len(k) >= 10:
                j = big if i is None else i
                seen[k].add(j)
                owner[k] = min(owner.get(k, j), j)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(k := lower(x.strip(SPACES))) >= 10 and len(seen[k]) > 1 and owner[k] < (big if i is None else i))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_line_dedup_is_brute_force(make):
    for batches, fanout in ((1, 2), (3, 2), (5, 3)):
        got = line_dedup.dedup_lines(make(ROWS), batches=batches, fanout=fanout)
        assert set(make([]).columns) <= set(got.columns)
        assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()], key=key) == sorted(brute_lines(ROWS), key=key)
    assert line_dedup.dedup_lines(make([])).count() == 0


@pytest.mark.parametrize("ids", [[None, 1, 2] * 4, [None, None, None, 5] * 4, [None] * 9, [(1 << 63) - 1, None, (1 << 63) - 2, (1 << 53) + 1, 1 << 53] * 3, [-(1 << 63), None, None]])
def test_any_share_of_null_ids(spark, make, ids):
    rows = [(i, f"a shared line of text\nline number {n % 5} of some\nown line {n}") for n, i in enumerate(ids)]
    got = line_dedup.dedup_lines(make(rows))
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()], key=key) == sorted(brute_lines(rows), key=key)
    staged = corpus_pipeline.lines(spark, make(rows), "").collect()
    assert sorted([(r.doc_id, r.text) for r in staged], key=key) == sorted([(i, t) for i, _, _, t in brute_lines(rows)], key=key)


def test_session_and_folder_are_left_as_they_were(spark, make):
    import os

    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before, set_before = set(os.listdir(top)), spark.conf.get(line_dedup._SORTED)
    line_dedup.dedup_lines(make(ROWS)).collect()
    assert spark.conf.get(line_dedup._SORTED) == set_before and not spark.catalog.listTables()
    assert [x.split("-")[1] for x in set(os.listdir(top)) - before] == ["lost"]


def test_runs_are_merged_in_order(spark):
    frame = lambda rows: spark.createDataFrame(rows, "_h1 long, _h2 long, owner long").repartition(4, "_h1", "_h2")
    runs = line_dedup.LineRuns(spark, 4)
    first, second = [(i * 7919 % 1000, i, i) for i in range(200)], [(i * 104729 % 1000, i, i) for i in range(200, 500)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set(line_dedup._SORTED, "true")
    try:
        runs.levels[0] = [runs._write(frame(first)), runs._write(frame(second))]
        both = runs.merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
        anti = runs.unseen(frame(first[:50] + [(5, -1, 0)]))
        plan = anti._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in both and "Exchange" not in both and "Sort [" not in both
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1  # the batch's own
    assert [tuple(r) for r in anti.collect()] == [(5, -1, 0)]
    runs.add(frame([(-1, -1, 9)]))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert sorted(tuple(r) for r in runs.table().collect()) == sorted([*first, *second, (-1, -1, 9)])
    runs.drop()


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated)


def test_text_rules_are_brute_force(prose):
    texts = [None, "", " \n ", "a", "a b", "a b c", "a a a a", "a b c a b c\na b c\na b c", "é ü\xa0x # *\n# *", prose(1, 300, 5), prose(2, 3000, 30), "w " * 5000]
    for t in texts:
        assert line_rules.text_rules(t)[:5] == brute_rules(t), repr((t or "")[:40])


def test_frequent_lines_deplete(make, prose):
    shared = "a footer that very many of them share, word after word after word"
    rows = [(i, prose(i, 60) + "\n" + shared, "a") for i in range(30)] + [(100, "\n".join([shared] * 6), "a"), (101, prose(101, 80), None), (102, None, "a"), (103, prose(5, 60) + "\n" + shared, "b")]
    got = {r.doc_id: r for r in line_rules.apply_line_rules(make(rows), host_least=10).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept and got[i].n_removed_words == 13 for i in range(30))
    assert not got[100].kept
    assert got[101].kept
    assert (got[102].base_failed, got[102].n_words) == (True, 0)
    assert got[103].n_removed_words == 0
    copies = [(200 + i, prose(200, 60) + "\n" + prose(201, 60), "c") for i in range(15)] + [(300, prose(300, 60), "c")]
    counted = {r.doc_id: (r.kept, r.n_removed_words) for r in line_rules.apply_line_rules(make(copies), host_least=10).collect()}
    assert counted == {**{200 + i: (False, 120) for i in range(15)}, 300: (True, 0)}
    assert all(r.kept for r in line_rules.apply_line_rules(make(copies), host_least=10, count_copies=False).collect())
    assert all(r.kept for r in line_rules.apply_line_rules(make([copies[0]] * 15), host_least=10).collect())  # one document, repeated
    again = line_rules.apply_line_rules(make([rows[0], *rows]), host_least=10)
    assert again.count() == len(rows) + 1
    assert line_rules.apply_line_rules(make([])).count() == 0
