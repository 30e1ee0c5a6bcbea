"""Packing by power-of-two decomposition.

Every document's ids are cut into pieces whose lengths are powers of two: as many of `max_length` as fit, then the
binary digits of the rest, from large to small. A piece is a sequence of its own and equal lengths share a bucket,
so nothing is padded and no sequence crosses documents. Pieces of a length are brought together in runs of bounded
size within a task, so the job stays one scan without a shuffle: every Arrow batch holds one length, rising.
"""

from __future__ import annotations

import array
import functools
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of words that a worker keeps; the cache is emptied beyond that.
CACHED_WORDS = 500_000
_SPACE_RUN = re.compile(r" \s| $")
_CUT = re.compile(r" (?=\S)")


class WordCachedEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    The byte-level pattern always starts a new word at a space before a non-space, whatever stands around it, so a text
    is cut there, each part is encoded once, and the parts' ids are joined. Parts are merged by tiktoken with the ranks
    that the tokenizer's own file gives, which is the same merging in less time; a file whose ids don't rise with its
    merges, and texts with a special token's string, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        self.merge = _ranked(path, self.special)

    def _encode(self, text: str) -> bytes:
        if self.merge is None:
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array.array("I", self.merge(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = _CUT.split(text) if _SPACE_RUN.search(text) else text.split(" ")
        first, rest = parts[0], parts[1:]
        if len(self.ids) > CACHED_WORDS:
            self.ids.clear()
        known, encode = self.ids, self._encode
        for w in set(rest).difference(known):
            known[w] = encode(" " + w)
        return encode(first) + b"".join(map(known.__getitem__, rest))


def _ranked(path: str, special: list[str]):
    """tiktoken's merging with the file's vocabulary; None if its ids aren't the merges' order or its pattern isn't the byte-level one."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre = model.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer") or sys.byteorder != "little":
        return None
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items() if w not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.cache
def encoder(path: str) -> WordCachedEncoder:
    """One for each Python worker."""
    return WordCachedEncoder(path)


def binary_lengths(n: int, most: int) -> list[int]:
    """n as powers of two of at most `most`, from large to small."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: id_col, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and null ids are packed each on their own. Other columns of
    the input don't matter, and texts of any length are cut whole. An empty table gives no rows. sequence_id is unique in
    the result; its offset is always 0 because a sequence holds one piece. Rows come in runs of equal length; for one
    bucket a length over the whole table, write the result with write_buckets.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            buckets: dict[int, tuple[list, list, list, list]] = {}

            def flush(batch=batch, buckets=buckets):
                """One batch a length, from short to long."""
                for k in sorted(buckets):
                    rows, start, ids, total = buckets[k]
                    columns = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(start, pa.int64()), pa.array([k] * len(rows), pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["_id", "start", "length", "ids", "doc_tokens"])
                buckets.clear()

            size = 0
            for i, text in enumerate(batch.column(1)):
                tokens = encode(text.as_py() or "") + end
                n, at = len(tokens) // 4, 0
                for k in binary_lengths(n, max_length):
                    rows, start, ids, total = buckets.setdefault(k, ([], [], [], []))
                    rows.append(i)
                    start.append(at)
                    ids.append(tokens[4 * at : 4 * (at + k)])
                    total.append(n)
                    at += k
                size += len(tokens)
                if size > 8 << 20:
                    yield from flush()
                    size = 0
            yield from flush()

    pieces = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(cut, f"_id {id_type}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(F.col("_id").alias(id_col), "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences of equal length go to one folder each; no row is shuffled."""
    pieces.write.partitionBy("length").parquet(path)
