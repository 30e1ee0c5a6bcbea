from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftspark.llm import packing

TEXTS = ["", "  a  b \n\n c   d\t e ", "a \nb", "it's  'tis <|endoftext|> x", "  a  b c　 d", " ", "x ", "\x1c a\x85 b  ", "I 've   we'll 12 3.4  ,,, é", "word " * 3000, "é" * 5000]


def test_ids_are_the_tokenizers(tokenizer, prose):
    path = tokenizer("byte_bpe_50k.json")
    t, w = Tokenizer.from_file(path), packing.WordCachedEncoder(path)
    assert w.merge is not None
    for x in [*TEXTS, prose(1, 500), prose(2, 500)]:
        assert w(x) == np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x[:40])


def test_pieces_cover_each_document(spark, make, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(90, None), (0, TEXTS[0]), (None, "a b c")]
    got = packing.pack(make(rows), path).withColumn("crc", F.crc32("ids")).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 and len(r.ids) == 4 * r.length for r in got)
    for i, x in [*enumerate(TEXTS), (90, "")]:
        want = np.asarray([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == i)
        assert b"".join(b for _, b in own) in (want, want + want) if i == 0 else b"".join(b for _, b in own) == want
        assert all(r.doc_tokens == len(want) // 4 for r in got if r.doc_id == i)
    assert sum(r.doc_id is None for r in got) > 0
    assert packing.pack(make([]), path).count() == 0


def test_binary_lengths():
    assert packing.binary_lengths(2048 + 7, 1024) == [1024, 1024, 4, 2, 1]
    assert packing.binary_lengths(1, 1024) == [1]


def test_equal_lengths_stand_together(spark, make, tokenizer, prose):
    import tempfile

    pieces = packing.pack(make([(i, prose(i, 20 + 7 * i)) for i in range(60)]).coalesce(1), tokenizer("byte_bpe_50k.json"))
    lengths = [r.length for r in pieces.select("length").collect()]
    runs = 1 + sum(a != b for a, b in zip(lengths, lengths[1:], strict=False))
    assert runs == len(set(lengths)) > 5
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/buckets"
    packing.write_buckets(pieces, path)
    got = spark.read.parquet(path)
    assert sorted((r.doc_id, r.start, r.length) for r in got.collect()) == sorted((r.doc_id, r.start, r.length) for r in pieces.collect())
    assert spark.read.parquet(f"{path}/length=8").filter(F.length("ids") != 32).count() == 0
