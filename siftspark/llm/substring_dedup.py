"""Substring deduplication with difference-cover anchors.

A window of `window` words that also starts in a document of a smaller id loses its words. Hashing every window of the
corpus is avoided: positions are taken at a difference cover modulo `period`, a set whose differences give every
residue, and only anchors of window - period + 1 words that start there are hashed. Wherever two equal windows lie,
some shift below `period` puts both at cover positions, so they share an anchor. Anchors that occur in one text only
end there. Around the others, the whole windows that hold one are hashed with 96 bits and compared: the match extends
as far as windows agree, each with the smallest id that holds it.

Hashes travel as blocks by hash range (shards), and a shard is compared in one task by sorting. A task meets each hash
of a chunk of texts before that: what repeats inside the chunk is known there, and only one entry of it travels, so
the copies of a passage don't pile up in one shard. Texts equal as a whole are compared by their hash alone.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm._shared import row_id, scratch, stored, text_hash

#: Words of the shortest anchor that is still rare enough.
ANCHOR = 7
#: Hashes that a shard should hold, and that a chunk gathers before it is sent.
SHARD, CHUNK = 1 << 20, 1 << 20
_LOW = (1 << 48) - 1


@functools.cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set (of those, the first in order) of residues whose differences give every residue."""
    for size in itertools.count(1):
        if size * (size - 1) + 1 < period:
            continue
        for rest in itertools.combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover


def period_for(window: int) -> int:
    """The longest period with a perfect cover (a difference for every residue, once) that leaves anchors of ANCHOR words."""
    return max((p for p in (1, 3, 7, 13, 21) if window - p + 1 >= ANCHOR), default=1)


@functools.cache
def _factors(n: int, seed: int):
    import numpy as np

    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, np.uint64) | np.uint64(1)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def span_hashes(own, starts, length: int, seed: int):
    """One hash for each span of `length` words."""
    import numpy as np

    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(_factors(length, seed)):
            total += own[starts + k] * c
        return _mixed(total)


def anchor_places(n_words: int, window: int, period: int):
    """Where anchors start: the cover positions of a text that has a window."""
    import numpy as np

    last = n_words - (window - period + 1)
    if n_words < window:
        return np.zeros(0, np.int64)
    places = (np.arange(0, last + 1, period)[:, None] + np.array(difference_cover(period))).ravel()
    return places[places <= last]


def _shard(h, shards: int):
    import numpy as np

    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _packed(x) -> bytes:
    """The low 48 bits of each number."""
    import numpy as np

    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes):
    import numpy as np

    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _joined(column, kind):
    """All numbers of a column of packed arrays, and how many each row holds."""
    import numpy as np

    parts = [np.frombuffer(v.as_buffer(), kind) for v in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(p) for p in parts], np.int64)


def _runs(key):
    """Starts of the runs of equal neighbours."""
    import numpy as np

    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _blocks(shard, order_key, columns: dict) -> Iterator[tuple]:
    """Entries as (shard, slice of each column), ordered by shard and, in it, by `order_key`."""
    import numpy as np

    order = np.lexsort((order_key, shard))
    shard = shard[order]
    columns = {k: v[order] for k, v in columns.items()}
    first = _runs(shard)
    for a, b in zip(first, [*first[1:], len(shard)], strict=False):
        yield int(shard[a]), {k: v[a:b] for k, v in columns.items()}


def _schema(keys: list[str], value: str) -> pa.Schema:
    return pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in [*keys, "counts", value])])


def _by_text(part, columns: dict, keys: list[str]) -> dict:
    """Rows (part, keys, counts, values) of what a shard found: a block for each part of the texts, its values by text, packed."""
    import numpy as np

    (value,) = set(columns) - set(keys)
    out = {c: [] for c in ["part", *keys, "counts", value]}
    for at, c in _blocks(part, columns[keys[-1]], columns):
        order = np.lexsort([c[k] for k in keys])
        c = {n: v[order] for n, v in c.items()}
        run = np.flatnonzero(np.concatenate([[True], functools.reduce(np.logical_or, [c[k][1:] != c[k][:-1] for k in keys])]))
        row = {"part": at, "counts": np.diff([*run, len(order)]).astype(np.int32).tobytes(), value: _packed(c[value].astype(np.uint64)), **{k: c[k][run].tobytes() for k in keys}}
        for k, v in row.items():
            out[k].append(v)
    return out


def _gathered(blocks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): one row a text, with the packed values of all shards. Blocks travel by the part of the texts, so their number doesn't follow the texts."""

    def merge(table: pa.Table) -> pa.Table:
        import numpy as np

        counts, _ = _joined(table.column("counts"), np.int32)
        own = {k: np.repeat(_joined(table.column(k), np.int64)[0], counts) for k in keys}
        values = np.concatenate([_unpacked(v.as_py()) for v in table.column(value)])
        order = np.lexsort([own[k] for k in keys])
        own, values = {k: v[order] for k, v in own.items()}, values[order]
        run = np.flatnonzero(np.concatenate([[True], functools.reduce(np.logical_or, [v[1:] != v[:-1] for v in own.values()])]))
        return pa.table({**{k: pa.array(v[run]) for k, v in own.items()}, value: pa.array([_packed(values[a:b]) for a, b in zip(run, [*run[1:], len(values)], strict=False)], pa.binary())})

    return blocks.groupBy("part").applyInArrow(merge, ", ".join(f"{k} long" for k in keys) + f", {value} binary")


def repeated_anchors(keyed: DataFrame, window: int, period: int, shards: int) -> DataFrame:
    """(_k, hits): for each text key, the packed hashes of its anchors that another key has too. keyed: _k, _text."""
    length = window - period + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["shard", "known", "keys", "counts", "hashes"]
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]

        def sent(found):
            k, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((k, h))
            k, h = k[order], h[order]
            entry = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])  # repeats in one text count once
            k, h = k[entry], h[entry]
            first = _runs(h)
            many = np.repeat(np.diff([*first, len(h)]) > 1, np.diff([*first, len(h)]))
            lead = np.zeros(len(h), bool)
            lead[first] = True
            rows = [[] for _ in names]
            # what two keys of the chunk share is known; one entry of each hash travels on
            for known, some in ((True, many), (False, lead)):
                shard = (k[some].view(np.uint64) % np.uint64(shards)) if known else _shard(h[some], shards)
                for s, c in _blocks(shard, k[some], {"k": k[some], "h": h[some]}):
                    at = _runs(c["k"])
                    for row, v in zip(rows, (s, known, c["k"][at].tobytes(), np.diff([*at, len(c["k"])]).astype(np.int32).tobytes(), _packed(c["h"])), strict=True):
                        row.append(v)
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names)

        found, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                places = anchor_places(len(words), window, period)
                if len(places):
                    found.append((np.full(len(places), key, np.int64), span_hashes(word_hashes(words), places, length, 1)))
                    size += len(places)
                if size >= CHUNK:
                    yield sent(found)
                    found, size = [], 0
        if found:
            yield sent(found)

    def met(table: pa.Table) -> pa.Table:
        import numpy as np

        keys, per_row = _joined(table.column("keys"), np.int64)
        counts, _ = _joined(table.column("counts"), np.int32)
        h = np.concatenate([_unpacked(v.as_py()) for v in table.column("hashes")])
        known = np.repeat(np.repeat(np.array(table.column("known").to_pylist(), bool), per_row), counts)
        k = np.repeat(keys, counts)
        new_k, new_h = k[~known], h[~known]
        order = np.argsort(new_h, kind="stable")
        new_k, new_h = new_k[order], new_h[order]
        first = _runs(new_h)
        many = np.repeat(np.minimum.reduceat(new_k, first) != np.maximum.reduceat(new_k, first), np.diff([*first, len(new_h)])) if len(first) else np.zeros(0, bool)
        k, h = np.concatenate([k[known], new_k[many]]), np.concatenate([h[known], new_h[many]])
        return pa.table(_by_text(k.view(np.uint64) % np.uint64(shards), {"_k": k, "hits": h}, ["_k"]), _schema(["_k"], "hits"))

    blocks = keyed.select("_k", "_text").mapInArrow(cut, "shard long, known boolean, keys binary, counts binary, hashes binary")
    return _gathered(blocks.groupBy("shard").applyInArrow(met, "part long, _k binary, counts binary, hits binary"), ["_k"], "hits")


def lost_windows(hit: DataFrame, window: int, period: int, shards: int) -> DataFrame:
    """(_id, _k, starts): for each text, the packed starts of windows that a smaller id holds. hit: _id, _k, _text, hits."""
    length = window - period + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["shard", "known", "ids", "keys", "counts", "starts", "first", "second"]
        kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 6]

        def sent(found):
            i, k, at, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((i, g, h))
            i, k, at, h, g = (x[order] for x in (i, k, at, h, g))
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
            least = np.repeat(i[first], np.diff([*first, len(h)]))
            rows = [[] for _ in names]
            for known, some in ((True, i > least), (False, i == least)):
                shard = (k[some].view(np.uint64) % np.uint64(shards)) if known else _shard(h[some], shards)
                for s, c in _blocks(shard, at[some], {"i": i[some], "k": k[some], "at": at[some], "h": h[some], "g": g[some]}):
                    by = np.lexsort((c["at"], c["k"], c["i"]))
                    c = {n: v[by] for n, v in c.items()}
                    run = np.flatnonzero(np.concatenate([[True], (c["i"][1:] != c["i"][:-1]) | (c["k"][1:] != c["k"][:-1])]))
                    count = np.diff([*run, len(by)])
                    hashes = (b"", b"") if known else (_packed(c["h"]), _packed(c["g"]))
                    for row, v in zip(rows, (s, known, c["i"][run].tobytes(), c["k"][run].tobytes(), count.astype(np.int32).tobytes(), c["at"].astype(np.int32).tobytes(), *hashes), strict=True):
                        row.append(v)
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names)

        found, size = [], 0
        for batch in batches:
            for one, key, text, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                own = word_hashes(text.as_py().encode("utf-8", "replace").split())
                places = anchor_places(len(own), window, period)
                shared = places[np.isin(span_hashes(own, places, length, 1) & np.uint64(_LOW), _unpacked(hits.as_py()))]
                # windows that hold a shared anchor
                starts = np.zeros(len(own) + 1, np.int64)
                np.add.at(starts, np.maximum(shared - (period - 1), 0), 1)
                np.add.at(starts, np.minimum(shared, len(own) - window) + 1, -1)
                starts = np.flatnonzero(np.cumsum(starts)[: len(own) - window + 1] > 0)
                if len(starts):
                    found.append((np.full(len(starts), one, np.int64), np.full(len(starts), key, np.int64), starts, span_hashes(own, starts, window, 2), span_hashes(own, starts, window, 3)))
                    size += len(starts)
                if size >= CHUNK:
                    yield sent(found)
                    found, size = [], 0
        if found:
            yield sent(found)

    def met(table: pa.Table) -> pa.Table:
        import numpy as np

        ids, per_row = _joined(table.column("ids"), np.int64)
        keys, _ = _joined(table.column("keys"), np.int64)
        counts, _ = _joined(table.column("counts"), np.int32)
        at, _ = _joined(table.column("starts"), np.int32)
        known = np.repeat(np.repeat(np.array(table.column("known").to_pylist(), bool), per_row), counts)
        i, k = np.repeat(ids, counts), np.repeat(keys, counts)
        h, g = (np.concatenate([_unpacked(v.as_py()) for v in table.column(c)]) for c in ("first", "second"))
        new = np.flatnonzero(~known)
        order = np.lexsort((i[new], g, h))
        new, h, g = new[order], h[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(new) else np.zeros(0, np.int64)
        least = np.repeat(i[new][first], np.diff([*first, len(new)]))
        gone = np.concatenate([np.flatnonzero(known), new[i[new] > least]])
        return pa.table(_by_text(k[gone].view(np.uint64) % np.uint64(shards), {"_id": i[gone], "_k": k[gone], "starts": at[gone].astype(np.uint64)}, ["_id", "_k"]), _schema(["_id", "_k"], "starts"))

    blocks = hit.select("_id", "_k", "_text", "hits").mapInArrow(cut, "shard long, known boolean, ids binary, keys binary, counts binary, starts binary, first binary, second binary")
    return _gathered(blocks.groupBy("shard").applyInArrow(met, "part long, _id binary, _k binary, counts binary, starts binary"), ["_id", "_k"], "starts")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, period: int | None = None) -> DataFrame:
    """All columns of docs with `kept_text` (the words that stay, joined by one space), `n_words` and `n_removed`.

    Words are what ASCII white space separates. A word goes if a window of `window` words that covers it also starts in
    a document of a smaller id; windows are judged on the input. A null or empty text has no words. A null id counts as
    the largest; rows of one id are one document, none of which loses words for another's sake. Texts of any length are
    taken whole, and repeated rows are judged alike. Extra columns are passed on, but for those named like one of the
    three new ones, which are replaced. An empty table gives an empty table. Ids must be whole numbers. The comparison
    runs when the function is called. A hash of a passage travels once for each chunk of about CHUNK anchors that holds
    it, so a shard's memory grows with the number of chunks, not of documents, that share a passage.
    """
    period = period or period_for(window)
    spark = docs.sparkSession
    h1, h2 = text_hash(text_col)
    text = F.col(text_col).cast("string")
    own = [row_id(id_col).alias("_id"), h1.alias("_t1"), h2.alias("_t2"), F.xxhash64(row_id(id_col), h1, h2).alias("_k")]
    with scratch(spark) as keep:
        keys = stored(docs.select(*own, F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes")), "keys")
        n_bytes = keys.agg(F.sum("n_bytes")).first()[0] or 0
        # a word is about six bytes
        shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / 6 / SHARD))
        # a copy of a text with a smaller id loses every window, so it holds none first
        owner = keys.filter("n_bytes > 0").groupBy("_t1", "_t2").agg(F.min("_id").alias("_first"))
        placed = stored(keys.filter("n_bytes > 0").select("_id", "_t1", "_t2", "_k").distinct().join(owner, ["_t1", "_t2"]).select("_id", "_k", (F.col("_id") > F.col("_first")).alias("_copy")), "placed")
        hits = stored(repeated_anchors(docs.select(*own, text.alias("_text")), window, period, shards), "hits")
        wanted = hits.join(placed.filter("NOT _copy"), "_k")
        texts = docs.select(*own, text.alias("_text")).join(wanted, ["_id", "_k"])
        lost = lost_windows(texts, window, period, shards)
        gone = keep(stored(placed.join(lost, ["_id", "_k"], "left").filter("_copy OR starts IS NOT NULL"), "gone"))

    @F.pandas_udf("struct<kept_text string, n_words long, n_removed long>")
    def without(texts, copies, lost):
        import numpy as np
        import pandas as pd

        out = []
        for t, copy, packed in zip(texts, copies, lost, strict=True):
            words = (t or "").encode("utf-8", "replace").split()
            n, stays = len(words), words
            if copy is True or copy == 1:  # a missing one is None or NaN
                stays = words if n < window else []
            elif packed is not None:
                edge = np.zeros(n + 1, np.int64)
                starts = _unpacked(packed).astype(np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                stays = [w for w, c in zip(words, np.cumsum(edge)[:n].tolist(), strict=True) if not c]
            out.append((b" ".join(stays).decode(), n, n - len(stays)))
        return pd.DataFrame(out, columns=["kept_text", "n_words", "n_removed"])

    # the row travels as one struct, so that its column names can't clash with those used here
    others = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    out = docs.select(F.struct("*").alias("_row"), *own).join(gone, ["_id", "_k"], "left")
    out = out.withColumn("_out", without(F.col("_row")[text_col].cast("string"), "_copy", "starts"))
    return out.select(*[F.col("_row")[c].alias(c) for c in others], "_out.kept_text", "_out.n_words", "_out.n_removed")
