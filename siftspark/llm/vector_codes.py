"""Vector code compression: product codes of integer vectors, trained and assigned in exact arithmetic.

Components become integers floor(scale * x). Each of `parts` equal parts of a vector is coded by the nearest entry of
that part's codebook. Dot products are taken by limb-split matrix products: integers are broken into limbs so short
that a float64 BLAS product of two limb matrices stays below 2^53 and is exact; the limb products are recombined in
int64. The nearest entry is the first argmin of |c|^2 - 2 x.c. Training rounds read the table once each: a task sends
one row of sums for each part and entry, and only the codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siftspark.llm._shared import scratch, stored

#: Rows of one matrix product.
BLOCK = 4096


def finite(vector: str) -> Column:
    """True where a vector and all its components are there and finite."""
    x = F.col(vector)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))), F.lit(False))


def limb_width(depth: int) -> int:
    """Bits of a limb: `depth` products of two limbs, summed, stay below 2^53."""
    return (53 - max(depth, 1).bit_length()) // 2


def limbs(x, width: int, most: int | None = None) -> list:
    """x = sum of limb k times 2^(width * k), as float64 matrices; all but the last lie in 0 .. 2^width - 1, the last in -2^width .. 2^width - 1."""
    import numpy as np

    most = int(max(np.abs(x).max(initial=0), 1)) if most is None else most
    n = max(1, -(-int(most).bit_length() // width))
    low = np.int64((1 << width) - 1)
    return [((x >> np.int64(width * k)) & low if k < n - 1 else x >> np.int64(width * k)).astype(np.float64) for k in range(n)]


def exact_dot(x, y):
    """x @ y.T in int64, for integer matrices whose products fit there."""
    import numpy as np

    width = limb_width(x.shape[1])
    out = np.zeros((len(x), len(y)), np.int64)
    right = [b.T for b in limbs(y, width)]
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(right):
            out += (a @ b).astype(np.int64) << np.int64(width * (i + j))
    return out


def largest(depth: int) -> int:
    """Components up to this size keep every squared distance over `depth` of them in int64."""
    return int(((1 << 62) // max(depth, 1)) ** 0.5) // 2


def nearest(x, entries):
    """Index of each row's nearest entry (ties: the lower one) and its squared distance, both exact."""
    import numpy as np

    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norms = (entries * entries).sum(axis=1)
    for i in range(0, len(x), BLOCK):
        rows = x[i : i + BLOCK]
        d = norms - 2 * exact_dot(rows, entries)
        best = d.argmin(axis=1)
        at[i : i + BLOCK] = best
        far[i : i + BLOCK] = d[np.arange(len(rows)), best] + (rows * rows).sum(axis=1)
    return at, far


def integers(column: pa.Array, scale: int, length: int):
    """The vectors of an Arrow list column as one int64 matrix of floor(scale * x)."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(column) * length or (len(column) and set(np.diff(column.offsets.to_numpy()).tolist()) != {length}):
        raise ValueError(f"vectors of different lengths; the first has {length} components")
    x = np.floor(values.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > largest(length):
        raise ValueError(f"a component of {np.abs(x).max():.4g} after scaling; sums of squares are exact up to {largest(length)}")
    return x.astype(np.int64).reshape(len(column), length)


class ProductCodes:
    """Codebooks of integer entries: an array (parts, entries, length of a part), the same on every executor."""

    def __init__(self, books, scale: int):
        self.books, self.scale = books, scale

    @property
    def length(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def parts_of(self, x) -> list:
        size = self.books.shape[2]
        return [x[:, p * size : (p + 1) * size] for p in range(len(self.books))]

    def decoded(self, code: bytes) -> list[int]:
        """The vector that a code stands for."""
        return [int(c) for book, at in zip(self.books, code, strict=True) for c in book[at]]


def first_codebooks(vectors: DataFrame, vector: str, order: list[Column], parts: int, entries: int, scale: int) -> ProductCodes | None:
    """Entries from the first `entries` vectors in the order given; None of an empty table. Brings those vectors to the driver."""
    import numpy as np

    rows = [r[0] for r in vectors.orderBy(*order).limit(entries).select(vector).collect()]
    if not rows:
        return None
    length = len(rows[0])
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    x = integers(pa.array(rows, pa.list_(pa.float64())), scale, length)
    return ProductCodes(np.stack([x[:, p * (length // parts) : (p + 1) * (length // parts)] for p in range(parts)]), scale)


def refined(vectors: DataFrame, vector: str, codes: ProductCodes) -> ProductCodes:
    """One round: every part goes to its nearest entry, and an entry becomes the floor of its parts' mean; unused ones stay."""
    parts, entries, size = codes.books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, count = np.zeros(codes.books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for p, x in enumerate(codes.parts_of(integers(batch.column(0), codes.scale, codes.length))):
                at, _ = nearest(x, codes.books[p])
                np.add.at(total[p], at, x)
                count[p] += np.bincount(at, minlength=entries)
        used = np.argwhere(count)
        flat = pa.array(total[used[:, 0], used[:, 1]].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * size, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(count[used[:, 0], used[:, 1]]), lists], ["part", "entry", "n", "sums"])

    # a sum over all rows can leave 64 bits: decimals
    whole = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    found = vectors.select(vector).mapInArrow(sums, "part long, entry long, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *whole)
    books = codes.books.copy()
    for r in found.collect():  # parts * entries rows at most
        books[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return ProductCodes(books, codes.scale)


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> ProductCodes | None:
    """Codebooks fitted to every vector, begun with the `entries` smallest ids (null ids last, ties by the vector). None of an empty table.

    A scan of the table for each round. Sums of parts are exact; the driver holds `parts * entries` rows of sums.
    """
    kept = vectors.filter(finite(vector_col))
    codes = first_codebooks(kept, vector_col, [F.col(id_col).asc_nulls_last(), F.col(vector_col)], parts, entries, scale)
    for _ in range(rounds if codes else 0):
        codes = refined(kept, vector_col, codes)
    return codes


def encode(vectors: DataFrame, codes: ProductCodes, columns: list[str], vector_col: str = "embedding") -> DataFrame:
    """`columns` of every finite vector with `code` (a byte for each part) and `error`, the squared distance to what the code stands for."""
    if codes.books.shape[1] > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x = integers(batch.column(1), codes.scale, codes.length)
            at, far = np.zeros((len(x), len(codes.books)), np.uint8), np.zeros(len(x), np.int64)
            for p, part in enumerate(codes.parts_of(x)):
                at[:, p], d = nearest(part, codes.books[p])
                far += d
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in at], pa.binary()), pa.array(far)], ["_own", "code", "error"])

    rows = vectors.filter(finite(vector_col)).select(F.struct(*columns).alias("_own"), vector_col)
    schema = StructType([rows.schema["_own"], StructField("code", BinaryType()), StructField("error", LongType())])
    return rows.mapInArrow(assign, schema).select(*[F.col("_own")[c].alias(c) for c in columns], "code", "error")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """id_col, `code` (binary), `error`, `label_error` (error summed over equal labels, null ones together) and `codebooks_sha256`.

    Vectors that are null or hold null, NaN or infinite components give no row. Repeated rows and ids are coded alike,
    each in its own row; a null id comes last among the first entries. Vectors of unequal lengths, a length that `parts`
    doesn't divide, and components above `largest(length)` after scaling are refused with a ValueError. An empty table
    gives an empty one. Further columns don't matter, whatever their names. Fitted when called; labels are summed
    before they are joined with the rows, so a label of any size is one row there.
    """
    own = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"), F.col(label_col).alias("_label"))
    codes = train(own, "_id", "_vector", parts, entries, rounds, scale)
    if codes is None:
        return own.filter("false").select(F.col("_id").alias(id_col), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    with scratch(vectors.sparkSession) as keep:
        coded = keep(stored(encode(own, codes, ["_id", "_label"], "_vector"), "codes"))
    of_label = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_other")
    both = coded.join(of_label, F.col("_label").eqNullSafe(F.col("_other")))
    return both.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
