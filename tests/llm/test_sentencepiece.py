from __future__ import annotations

import numpy as np
import pytest

from siftspark.llm import sentencepiece_ops as S

ODD = ["", "  a  b \n\n c   d\t e ", "a \nb", " x", "x ", "   ", "日本語 テスト 😀 é", "a" * 300, "              a               b", "<s> </s> <0x0A>", "▁a ▁▁b ▁", "ﬁ ½ Ｗide", "a\x00b c", "x" * 70 + "yz " * 40]


@pytest.fixture(scope="module")
def pieces(tokenizer):
    return S.pieces_of(tokenizer("piece_bpe_32k.model"))


def test_ids_are_the_librarys(pieces, prose):
    for texts in ([*ODD], [prose(i, 200) for i in range(20)], ["".join(chr(c) for c in np.random.default_rng(i).integers(32, 600, 300)) for i in range(30)]):
        for t, ids in zip(texts, S.encode_texts(texts, pieces), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == pieces.model.encode(t), repr(t[:60])


def test_decoding_is_the_librarys(pieces, prose):
    for t in [*ODD, prose(1, 300)]:
        ids = pieces.model.encode(t)
        assert S.decode_ids(ids, pieces) == pieces.model.decode(ids)


def test_borders_are_the_merges(pieces):
    rng = np.random.default_rng(5)
    known = np.array([i for p, i in pieces.id.items() if pieces.merged(p) == [p] and "▁▁" not in p])
    left, right = rng.choice(known, 20000), rng.choice(known, 20000)
    short = known[[len(pieces.text[i]) <= 2 for i in known]]
    left[:10000], right[:10000] = rng.choice(short, 10000), rng.choice(short, 10000)
    left[-300:] = right[-300:]  # a piece beside itself: ties
    want = [pieces.merged(pieces.text[a] + pieces.text[b]) == [pieces.text[a], pieces.text[b]] for a, b in zip(left, right, strict=True)]
    assert pieces.borders_kept(left, right).tolist() == want
    assert 0.05 < np.mean(want) < 0.999


def test_long_words(pieces):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abeinrst"), 3000)), "日本語テスト" * 200, "x" * 1000, "ab" * 70 + " " + "a" * 65]
    for t, ids in zip(texts, S.encode_texts(texts, pieces), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == pieces.model.encode(t), t[:20]


def test_other_models_are_refused(pieces):
    class Other(S.Pieces):
        def __init__(self):
            self.text, self.score, self.id = ["a"], [-1.5], {"a": 0}

    with pytest.raises(ValueError, match="byte-pair"):
        Other()._index_merges(["a"])


def test_frames(spark, make, tokenizer, prose):
    path = tokenizer("piece_bpe_32k.model")
    rows = [(1, prose(1, 100)), (2, None), (3, ""), (None, "a b"), (1, prose(1, 100)), (4, "é\nü  x")]
    got = S.decode(S.encode(make(rows), path), path).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text == rows[0][1]
    assert by[4].text == "é\nü  x"
    assert (by[2].n_pieces, by[2].text) == (0, "")
    assert S.encode(make([]), path).count() == 0
