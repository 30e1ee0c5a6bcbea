from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lines import brute_lines
from test_near_duplicates import brute
from tokenizers import Tokenizer

import corpus_pipeline
from siftspark.llm import pu_quality, secret_scan
from siftspark.llm._shared import stored
from siftspark.llm.queries import held_out_rows


def plain_quality(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = {r.doc_id: r.score for r in pu_quality.score_quality(docs, labels, held_out_rows()).collect()}
    return {r.doc_id: r.text for r in docs.collect() if scored[r.doc_id] >= corpus_pipeline.REJECT_BELOW}


def plain_lines(spark, docs, sf_dir):
    return {i: text for i, _, _, text in brute_lines([(r.doc_id, r.text) for r in docs.collect()])}


def plain_near_duplicates(spark, docs, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    smallest = brute(rows, 5, 80)
    return {i: text for i, text in rows if smallest[i] == i}


def plain_secrets(spark, docs, sf_dir):
    found = {}
    for r in secret_scan.scan_secrets(docs, corpus_pipeline.tokenizer_file("byte_bpe_50k.json")).filter("is_secret").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    out = {}
    for r in docs.collect():
        text = r.text
        for a, b in sorted(found.get(r.doc_id, []), reverse=True):
            text = text[:a] + "[SECRET]" + text[b:]
        out[r.doc_id] = text
    return out


PLAIN = {"quality": plain_quality, "lines": plain_lines, "near_duplicates": plain_near_duplicates, "secrets": plain_secrets}


def test_stages_are_their_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), name)
        assert out.columns == columns, name
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert len(got) == len(dict(got))
        assert dict(got) == PLAIN[name](spark, docs, sf_dir), name
        assert out.filter("n_chars != length(text)").count() == 0
        docs = out
    t = Tokenizer.from_file(corpus_pipeline.tokenizer_file("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    want = {r.doc_id: np.asarray([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4").tobytes() for r in docs.collect()}
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in pieces.items()} == want


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), name)
        assert out.count() == 0
        docs = out


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf_dir, make, prose, name):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that are named like the stages' own."""
    long = prose(1, 60_000)
    rows = [(i, prose(i, 80)) for i in range(40)] + [(50, None), (51, ""), (52, " \n\n "), (53, long), (54, "x" * 200_000), (0, prose(0, 80)), (None, prose(7, 80)), (None, None), (55, "password = hunter2abc!xyz9")]
    docs = make(rows)
    for c in ("kept_text", "n_lines", "n_dropped", "component_id", "_t1", "_row", "is_secret", "start", "length", "ids"):
        docs = docs.withColumn(c, F.nullif(F.lit("mine"), F.lit("")))
    docs = docs.unionByName(spark.createDataFrame([(None,) * len(docs.columns)], docs.schema))
    out = stored(dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir), name)
    got = out.collect()
    if name == "packing":
        assert sum(r.length for r in got if r.start + r.length == r.doc_tokens) > 0
        assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
        return
    assert out.columns == docs.columns
    assert {r.component_id for r in got} <= {"mine", None}
    if name in ("lines", "secrets"):
        assert len(got) == docs.count()
        assert sum(r.text is None for r in got) == docs.filter("text IS NULL").count()
    if name == "near_duplicates":
        assert {r.doc_id for r in got} >= {None, 0, 50, 51, 52, 53, 54, 55}
