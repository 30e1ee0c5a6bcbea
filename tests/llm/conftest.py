from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string, kept boolean"


def docs_of(spark, rows):
    """(doc_id, text[, source]) rows with the other columns of documents, and some whose names clash with the operators' own."""
    out = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, "x", True) for r in rows]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture
def make(spark):
    return lambda rows: docs_of(spark, rows)


@pytest.fixture(scope="session")
def prose():
    """Seeded words, the same in every run."""

    def write(seed, n, words=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(words)}x{rng.randrange(3)}" for _ in range(n))

    return write


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path
