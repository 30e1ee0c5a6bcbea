"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are concatenated and indexed with a suffix array. Every piece of the vocabulary is looked up
in it by binary search; its range of suffixes are the places where it occurs, each an edge of the word's lattice.
Edges are sorted by position and relaxed from left to right. The model is a byte-pair one, so what decides is not a sum
of scores: an edge may follow another if the model's merges keep the border between the two pieces, and the chain of
such edges is unique. That gives the library's own ids. Whether a border is kept is read off the two pieces' own last
merges, for all pairs of a step at once: going back in time, no merge over the border may come before one that is
undone. Words with runs of spaces are merged as a whole, since the pieces of spaces share one score.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words that a worker keeps; the cache is emptied beyond that.
CACHED = 400_000
#: Longer words are indexed and relaxed apart from the others, whose number of steps is their longest word's length.
LONG = 64
#: Characters of distinct words that are indexed at once.
INDEXED = 500_000
#: Slots (a power of two of 2**SLOTS) that tell most pairs without a joint piece from those with one.
SLOTS = 22
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """A byte-pair SentencePiece model's vocabulary, read once for each worker."""

    def __init__(self, path: str):
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.text = [self.model.id_to_piece(i) for i in range(n)]
        self.score = [self.model.get_score(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if self.model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.special = {i for i in range(n) if special[i]}
        self.odd = np.array([x or i in self.byte_of for i, x in enumerate(special)], bool)
        self.id = {p: i for i, p in enumerate(self.text) if not special[i] and i not in self.byte_of}
        # sorted by UTF-32 code points, as the suffixes are
        known = sorted(self.id)
        self.longest = max(map(len, known), default=1)
        self.lengths = np.array([len(p) for p in known])
        self.ids = np.array([self.id[p] for p in known])
        self.codes = np.zeros((len(known), self.longest), np.uint32)
        for k, p in enumerate(known):
            self.codes[k, : len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length_of = list(map(len, self.text))
        self.length_array = np.array(self.length_of)
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        self.words: dict[str, bytes] = {}
        self._index_merges(known)

    def _index_merges(self, known: list[str]) -> None:
        """Each piece's place in the order of merges, the halves it is made of last, and the pieces that two make together."""
        import numpy as np

        n = len(self.text)
        if any(self.score[self.id[p]] % 1 for p in known):
            raise ValueError("not a byte-pair model: its scores aren't an order of merges")
        self.rank = np.full(n, -1, np.int64)  # -1: a single character, there from the start
        self.first_half, self.second_half = np.arange(n), np.arange(n)
        self.regular = np.zeros(n, bool)
        #: Whether the merges lead to a piece at all.
        self.alone = np.zeros(len(known), bool)
        for k in sorted(range(len(known)), key=lambda k: len(known[k])):
            p, last = known[k], []
            i = self.id[p]
            self.alone[k] = self.merged(p, last) == [p]
            if len(p) == 1:
                self.regular[i] = True
            elif self.alone[k]:
                a, b = (self.id.get(x) for x in last)
                self.rank[i] = int(-self.score[i])
                if a is not None and b is not None and self.regular[a] and self.regular[b] and max(self.rank[a], self.rank[b]) < self.rank[i]:
                    self.regular[i], self.first_half[i], self.second_half[i] = True, a, b
        joint = {}
        for p in known:
            for k in range(1, len(p)):
                if (a := self.id.get(p[:k])) is not None and (b := self.id.get(p[k:])) is not None:
                    joint[a * n + b] = int(-self.score[self.id[p]])
        self.joint_keys = np.array(sorted(joint), np.int64)
        self.joint_rank = np.array([joint[k] for k in sorted(joint)], np.int64)
        self.slots = np.zeros(1 << SLOTS, bool)
        self.slots[self._slot(self.joint_keys)] = True

    @staticmethod
    def _slot(keys):
        import numpy as np

        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)

    def merged(self, text: str, last: list[str] | None = None) -> list[str]:
        """Pieces of a text after all merges, best score first, leftmost among equals; single characters where nothing merges.

        last: gets the two parts of the merge that was made last."""
        part: list[str | None] = list(text)
        after, before = [*range(1, len(part)), -1], [-1, *range(len(part) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := self.id.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, j, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != both:
                continue
            if last is not None:
                last[:] = part[i], part[j]
            part[i], part[j], after[i] = both, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in part if p is not None]

    def borders_kept(self, left, right):
        """Whether the merges of each two pieces keep the border between them.

        The two pieces are taken apart again, the later merge first. At each step a merge of the two parts beside the
        border must not come before the merge that was undone last; among equals the one further left comes first.
        """
        import numpy as np

        kept = np.ones(len(left), bool)
        odd = ~(self.regular[left] & self.regular[right])
        for k in np.flatnonzero(odd).tolist():
            a, b = self.text[left[k]], self.text[right[k]]
            kept[k] = self.merged(a + b) == [a, b]
        at = np.flatnonzero(~odd)
        a, b = left[at], right[at]
        limit = np.full(len(at), 1 << 62)  # twice the place in the order; an odd number takes in the place itself
        while len(at):
            keys = a * len(self.text) + b
            maybe = np.flatnonzero(self.slots[self._slot(keys)])
            found = np.minimum(np.searchsorted(self.joint_keys, keys[maybe]), len(self.joint_keys) - 1)
            crossed = np.zeros(len(at), bool)
            if len(self.joint_keys):
                crossed[maybe] = (self.joint_keys[found] == keys[maybe]) & (2 * self.joint_rank[found] < limit[maybe])
            kept[at[crossed]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            more = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
            at, a, b, rank_a, rank_b = at[more], a[more], b[more], rank_a[more], rank_b[more]
            undo_a = rank_a > rank_b
            limit = np.where(undo_a, 2 * rank_a, 2 * rank_b + 1)
            a, b = np.where(undo_a, self.second_half[a], a), np.where(undo_a, b, self.first_half[b])
        return kept

    def ids_of(self, pieces: list[str]) -> bytes:
        """Ids as little-endian 32-bit bytes; a character outside the vocabulary as its bytes, or as unknown."""
        out = []
        for p in pieces:
            if (k := self.id.get(p)) is not None:
                out.append(k)
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.model.unk_id())
        return b"".join(k.to_bytes(4, "little") for k in out)


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def suffix_array(codes, depth: int):
    """Order of the suffixes by their first `depth` code points: four at a time, then by doubling ranks."""
    import numpy as np

    n = len(codes)
    symbol = (np.unique(codes, return_inverse=True)[1] + 1).astype(np.uint64)
    bits = np.uint64(16 if int(symbol.max()) < 1 << 16 else 21)
    k = 4 if bits == 16 else 3
    padded = np.concatenate([symbol, np.zeros(k, np.uint64)])
    key = symbol.copy()
    for d in range(1, k):
        key = (key << bits) | padded[d : d + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        if k >= depth or int(rank.max()) == n:
            return order
        second = np.zeros(n, np.uint64)
        second[: max(0, n - k)] = rank[k:]
        key = rank * np.uint64(n + 2) + second
        k *= 2


def occurrences(codes, order, pieces: Pieces):
    """Ranges [low, high) of the suffix array whose suffixes start with each piece: one binary search for all pieces, code point by code point."""
    import numpy as np

    n, count = len(codes), len(pieces.ids)
    padded = np.concatenate([codes, np.zeros(pieces.longest + 1, np.uint32)])
    low, high = np.zeros(count, np.int64), np.full(count, n)
    for d in range(pieces.longest):
        live = np.flatnonzero((pieces.lengths > d) & (low < high))
        if not len(live):
            break
        want = pieces.codes[live, d]
        for right in (False, True):
            a, b = low[live].copy() if not right else low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                at = padded[order[np.minimum(mid, n - 1)] + d]
                up = open_ & ((at <= want) if right else (at < want))
                a, b = np.where(up, mid + 1, a), np.where(open_ & ~up, mid, b)
            if right:
                high[live] = a
            else:
                start = a
        low[live] = start
    return low, high


def encode_words(words: list[str], pieces: Pieces) -> list[bytes]:
    """Ids of words that hold the space mark at their start at most, all relaxed at once, position by position."""
    import numpy as np

    if not words:
        return []
    text = "\x00".join(words) + "\x00"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    order = suffix_array(codes, pieces.longest)
    low, high = occurrences(codes, order, pieces)
    hit = np.flatnonzero((low < high) & pieces.alone)
    sizes = (high - low)[hit]
    place = order[np.repeat(low[hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(sizes.sum())] if len(hit) else np.zeros(0, np.int64)
    length, piece = np.repeat(pieces.lengths[hit], sizes), np.repeat(pieces.ids[hit], sizes)
    stops = np.flatnonzero(codes == 0)
    begins = np.concatenate([[0], stops[:-1] + 1])
    begin_of = np.repeat(begins, stops - begins + 1)  # of each position, its word's
    offset = place + length - begin_of[place]
    by_end = np.argsort(offset.astype(np.uint8 if offset.max(initial=0) < 256 else np.int64), kind="stable")  # the edges, sorted by the position in their word that they reach
    place, length, piece, offset = place[by_end], length[by_end], piece[by_end], offset[by_end]
    sizes = stops - begins
    most = int(sizes.max())
    bound = np.searchsorted(offset, np.arange(most + 2))
    # last[p]: the piece that ends at p; none: not reached yet; odd: a character that no piece holds
    none, odd = -1, len(pieces.text)
    last = np.full(len(codes) + 1, none, np.int64)
    long_ones = np.argsort(-sizes, kind="stable")
    ordered = -sizes[long_ones]
    for i in range(1, most + 1):
        at = slice(bound[i], bound[i + 1])
        start, own, own_length = place[at], piece[at], length[at]
        inside = start > begin_of[start]
        left = np.where(inside, last[start], odd)
        fits = left >= 0
        ask = fits & (left != odd)
        fits[ask] = pieces.borders_kept(left[ask], own[ask])
        last[start[fits] + own_length[fits]] = own[fits]
        ends = begins[long_ones[: np.searchsorted(ordered, -i, side="right")]] + i
        bare = ends[last[ends] == none]
        last[bare] = odd
    # walk all words back from their ends at once; a step's tokens stand before those of the steps before it
    word, at = np.arange(len(words)), begins + sizes
    found = []
    while len(word):
        token = last[at]
        found.append((word, token))
        at = at - np.where(token == odd, 1, pieces.length_array[np.minimum(token, odd - 1)])
        more = at > begins[word]
        word, at = word[more], at[more]
    found.reverse()
    word, token = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(word, kind="stable")
    token = token[order]
    counts = np.bincount(word, minlength=len(words))
    stop = np.cumsum(counts)
    packed, bounds = token.astype("<u4").tobytes(), (4 * stop).tolist()
    out = [packed[low:high] for low, high in zip([0, *bounds[:-1]], bounds, strict=True)]
    for k in np.unique(np.searchsorted(stop, np.flatnonzero(token == odd), side="right")).tolist():
        # characters that no piece holds stand as their bytes
        own, i = [], 0
        for x in token[stop[k] - counts[k] : stop[k]].tolist():
            own.append(pieces.ids_of([words[k][i]]) if x == odd else pieces.packed[x])
            i += 1 if x == odd else pieces.length_of[x]
        out[k] = b"".join(own)
    return out


def _units(text: str) -> list[str]:
    return _UNIT.findall(text)


def encode_texts(texts: list[str], pieces: Pieces) -> list[bytes]:
    """Ids of whole texts, as the model's own encoder gives them."""
    normal = pieces.model.normalize(texts)
    # words by their text after the space mark; texts with runs of marks, or none at the start, are cut by a pattern
    simple = [t.startswith(SPACE) and SPACE * 2 not in t for t in normal]
    units = [t[1:].split(SPACE) if s else [u[1:] if u.startswith(SPACE) and not u.startswith(SPACE * 2) else SPACE * 2 + u for u in _units(t)] for t, s in zip(normal, simple, strict=True)]
    known = pieces.words
    every = set().union(*units)
    new = list(every.difference(known))
    if len(known) + len(new) > CACHED:
        known.clear()
        new = list(every)
    plain, long, whole = [], [], []
    for u in new:
        (whole if not u or u.startswith(SPACE * 2) or "\x00" in u else plain if len(u) <= LONG else long).append(u)
    for kind in (plain, long):
        part, size = [], 0
        for k, u in enumerate(kind):
            part.append(u)
            size += len(u)
            if size >= INDEXED or k == len(kind) - 1:
                known.update(zip(part, encode_words([SPACE + x for x in part], pieces), strict=True))
                part, size = [], 0
    for u in whole:
        known[u] = pieces.ids_of(pieces.merged(u[2:] if u.startswith(SPACE * 2) else SPACE + u))
    return [b"".join(map(known.__getitem__, own)) for own in units]


def decode_ids(ids, pieces: Pieces) -> str:
    """The text of ids: pieces joined, byte pieces as UTF-8, space marks as spaces without the one put first."""
    import numpy as np

    ids = np.asarray(ids, np.int64)
    out, raw, at = [], bytearray(), 0
    odd = np.flatnonzero(pieces.odd[ids]) if len(ids) else ids
    for k, i in zip(odd.tolist(), ids[odd].tolist(), strict=True):
        if k > at:
            out += [raw.decode("utf-8", "replace"), *map(pieces.text.__getitem__, ids[at:k].tolist())]
            raw.clear()
        if i in pieces.byte_of:
            raw.append(pieces.byte_of[i])
        at = k + 1
    out += [raw.decode("utf-8", "replace"), *map(pieces.text.__getitem__, ids[at:].tolist())]
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, ids (binary: little-endian unsigned 32-bit), n_pieces, and the ids' text as decoded_col, if named.

    A null or empty text has no pieces; a text of any length is encoded whole. Repeated rows are encoded each, null ids are passed on, an empty table gives
    none, and other columns don't matter. One scan, without a shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["_id", "ids", "n_pieces", *(["_decoded"] if decoded_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pieces = pieces_of(model_path)
        for batch in batches:
            ids = encode_texts([t or "" for t in batch.column(1).to_pylist()], pieces)
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded_col:
                columns.append(pa.array([decode_ids(np.frombuffer(x, "<u4"), pieces) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {id_type}, ids binary, n_pieces long" + ", _decoded string" * bool(decoded_col))
    return out.select(F.col("_id").alias(id_col), "ids", "n_pieces", *([F.col("_decoded").alias(decoded_col)] if decoded_col else []))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the text of its ids; null ids give a null text."""

    @F.pandas_udf("string")
    def run(ids):
        import numpy as np
        import pandas as pd

        pieces = pieces_of(model_path)
        return pd.Series([None if x is None else decode_ids(np.frombuffer(x, "<u4"), pieces) for x in ids], dtype=object)

    return encoded.withColumn(text_col, run(ids_col))
