"""Quality rules with cross-document line frequency.

Lines are normalised (white space at the ends off, A-Z in lower case) and hashed. For each host, the distinct documents
that hold a line are counted. A line above its host's limit is removed, and a document that lost too many of its words
that way is rejected. Documents of one text are counted by one row with their number, so a group of copies costs as much
as one of them; on request they count as one document altogether.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm._shared import stored, text_hash

#: The characters that n_symbols counts, and the ASCII white space.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_HALVES = struct.Struct("<qq")


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words that stand in an n-word window found twice or more."""
    import numpy as np

    if len(words) <= n:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    window = ids[: len(ids) - n + 1]
    for k in range(1, n):  # after each step, equal windows have equal small numbers
        window = np.unique(window * len(known) + ids[k : len(ids) - n + 1 + k], return_inverse=True)[1]
    twice = (np.bincount(window) > 1)[window]
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_rules(text: str | None) -> tuple[int, int, int, int, int, list[tuple[int, int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and (two halves of the hash, words) of each distinct normalised line."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    seen: set[bytes] = set()
    keys: dict[bytes, int] = {}
    again = 0
    for line in raw.split(b"\n"):
        own = len(line.split())
        if own:
            again += line in seen
            seen.add(line)
            key = line.strip(SPACES).lower()
            keys[key] = keys.get(key, 0) + own
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    lines = [(*_HALVES.unpack(hashlib.blake2b(k, digest_size=16).digest()), n) for k, n in keys.items()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated_words(words), lines


def apply_line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, host_share: float = 0.01, host_least: int = 10, least_left: float = 0.5, count_copies: bool = True) -> DataFrame:
    """One row per document: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept.

    A line is frequent if more than max(host_least, host_share * the host's distinct documents) of the host's documents
    hold it. count_copies: whether documents of one text count each, or as one. kept is false if a base rule fails or
    less than `least_left` of the words stay. A null text has no words and fails; a text of any length is taken whole; a
    null hosts together are one host; repeated rows of one id and text are one document in the counts and each get a row;
    null ids are passed on, and those of one text are one document. An empty table gives none, and other columns don't
    matter.
    """
    h1, h2 = text_hash(text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_rules(t.as_py()) for t in batch.column(4)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            flat = [x for own in columns[5] for x in own]
            parts = list(zip(*flat, strict=True)) if flat else [[]] * 3
            each = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["h", "g", "n"])
            lines = pa.ListArray.from_arrays(pa.array(list(itertools.accumulate(map(len, columns[5]), initial=0)), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.int64()) for c in columns[:5]), lines], ["_id", "_host", "_t1", "_t2", *numbers, "_lines"])

    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("")).alias("_host"), h1.alias("_t1"), h2.alias("_t2"), F.col(text_col).cast("string").alias("_text"))
    rules = stored(own.mapInArrow(measure, f"_id {id_type}, _host string, _t1 long, _t2 long, {', '.join(f'{n} long' for n in numbers)}, _lines array<struct<h: long, g: long, n: long>>"), "rules")

    text = ["_host", "_t1", "_t2"]
    copies = rules.select(*text, "_id").distinct().groupBy(*text).agg((F.count("*") if count_copies else F.lit(1).cast("long")).alias("_copies"))
    texts = rules.select(*text, "_lines").dropDuplicates(text).join(copies, text)
    lines = stored(texts.select(*text, "_copies", F.explode("_lines").alias("_line")).select(*text, "_copies", F.col("_line.h").alias("_h"), F.col("_line.g").alias("_g"), F.col("_line.n").alias("_n")), "rule-lines")
    hosts = copies.groupBy("_host").agg(F.greatest(F.lit(float(host_least)), F.sum("_copies") * F.lit(host_share)).alias("_limit"))
    key = ["_host", "_h", "_g"]
    frequent = lines.groupBy(*key).agg(F.sum("_copies").alias("_docs")).filter(F.col("_docs") > host_least).join(hosts, "_host").filter("_docs > _limit").select(*key)
    # stored, so that the join below can be split where a group of copies is large
    removed = stored(lines.join(frequent, key).groupBy(*text).agg(F.sum("_n").alias("n_removed_words")), "removed")
    out = rules.drop("_lines").join(removed, text, "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = (F.col("n_words") - F.col("n_removed_words")) >= F.lit(least_left) * F.col("n_words")
    return out.select(F.col("_id").alias(id_col), *numbers, "n_removed_words", failed.alias("base_failed"), (~failed & left).alias("kept"))
