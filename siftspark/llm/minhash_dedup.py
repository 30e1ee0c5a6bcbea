"""Near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

Texts of equal shingle sets form one class first. One hash a shingle fills the signature's bins; an empty bin borrows
from a bin that a fixed random sequence names. In each bucket of a band, the smallest id is the centre, and only edges
from it to the members are candidates. Candidates are confirmed on full shingle sets. Members that the centre isn't
linked with get two more stars in their bucket: around the linked member that is nearest to the centre, and around
their own smallest. Linked classes become components by alternating large-star and small-star steps. A bucket is
settled if its members but the centre, which was compared with all of them, are in one component. The classes of all
other buckets are then joined exactly, by a prefix filter on their differences from a common pivot, so no pair of a
bucket is lost and a template that many pages share isn't joined with itself.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm._shared import NULL_ID, row_id, scratch, stored

#: Bands and bins a band. A pair of similarity 0.85 shares no bucket with a chance of 4e-7, one of 0.8 of 5e-5.
BANDS, ROWS = 25, 5


@functools.cache
def _constants(n: int):
    import numpy as np

    return np.random.Generator(np.random.PCG64(20240229 + n)).integers(1, 1 << 63, n, np.uint64) | np.uint64(1)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int):
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text's words are one; none without words."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxh3_64_intdigest(b" ".join(found), 1)], np.uint64)
    own = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(own) - words + 1
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(_constants(words)):
            total += own[k : k + n] * c
        return np.unique(_mixed(total))


@functools.cache
def _donors(bins: int):
    """For each attempt and empty bin, the bin to borrow from."""
    return (_constants(64 * bins) >> 20).reshape(64, bins) % bins


def signature(shingles, bins: int):
    """The least hash in each bin; empty bins borrow (optimal densification)."""
    import numpy as np

    at = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at[first]], full[at[first]] = shingles[first], True
    empty, attempt, donors = np.flatnonzero(~full), 0, _donors(bins)
    while len(empty):
        donor = donors[attempt][empty].astype(np.int64) if attempt < len(donors) else (empty + attempt) % bins
        got = full[donor]
        out[empty[got]] = out[donor[got]]
        empty, attempt = empty[~got], attempt + 1
    return out


def band_keys(sig, bands: int = BANDS, rows: int = ROWS):
    """One 64-bit bucket a band."""
    import numpy as np

    with np.errstate(over="ignore"):
        return _mixed((sig.reshape(bands, rows) * _constants(rows)).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with `similarity`, and `linked` if 100 * intersection >= percent * union of the full sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            linked, similar = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                linked.append(100 * both >= percent * either)
                similar.append(both / either)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked, pa.bool_()), pa.array(similar, pa.float64())], ["a", "b", "linked", "similarity"])

    of = lambda k: sets.select(F.col("_id").alias(k), F.col("set").alias(f"set_{k}"))
    # the centre's side first: what is dealt out by a centre's key are ids, and sets go by the members' keys
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(count, "a long, b long, linked boolean, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node it reaches."""

    def state(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()

    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (after := state(now)) != before and after.n:
        before = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "edges")
        # small star: every node and its smaller neighbours go to the smallest
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        star = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(star.filter("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def family_pairs(sets: DataFrame, families: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that can be linked, of sets (_id, _component, set) within a family and of different components, and the links (a, b) with the families' pivots.

    families: _id, family; the pivot is the set of the id that names the family. A set counts as its difference from the
    pivot, so what a template's pages share drops out, however many they are. Of sets of n and m shingles that differ in d
    at most when linked, the differences of k and l shingles must share (k + l - d) / 2. If that is nothing, both are linked
    with the pivot, which is tested. Else shingles are ordered by the differences that hold them, rarest first, and the
    first shared one is early in both: the smaller difference puts its first d / 2 + 1 in the index, the larger asks with
    its first d + 1.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            of, delta = [], []
            for x, t in zip(batch.column(4), batch.column(5), strict=True):
                x, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, t))
                of.append(len(t))
                delta.append(np.setxor1d(x, t, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(6), pa.array(of, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], ["family", "_id", "_component", "_set", "n", "of", "delta"])

    own = sets.join(families, "_id")
    pivots = sets.join(families.filter("_id = family").select("_id"), "_id", "left_semi").groupBy(F.col("_id").alias("family")).agg(F.min("set").alias("pivot"))
    size = (F.octet_length("set") / 8).cast("long")
    both = own.join(pivots, "family").select("family", "_id", "_component", F.xxhash64("set").alias("_set"), "set", "pivot", size.alias("n"))
    deltas = stored(both.mapInArrow(differ, "family long, _id long, _component long, _set long, n long, of long, delta array<long>").withColumn("m", F.size("delta").cast("long")), "deltas")
    # 100 * intersection >= percent * union, in terms of the sizes and of the difference
    within = lambda n, m: (100 + percent) * m <= (100 - percent) * n
    links = deltas.filter(within(F.col("n") + F.col("of"), F.col("m")) & (F.col("_id") != F.col("family"))).select(F.col("family").alias("a"), F.col("_id").alias("b")).distinct()

    shingles = deltas.select("family", "_id", "_component", "_set", "n", "m", F.explode("delta").alias("w"))
    # a shingle that many differences hold is counted before it is shuffled, and its rows meet one row here
    shared = shingles.join(shingles.groupBy("family", "w").agg(F.count("*").alias("held")).filter("held > 1"), ["family", "w"])
    # those of one difference alone come first and are never shared, so only their number matters
    each = Window.partitionBy("_id", "_set")
    place = F.row_number().over(each.orderBy("held", "w")) - 1 + F.col("m") - F.count("*").over(each)
    most = F.floor((100 - percent) * F.col("n") / percent)
    postings = stored(shared.withColumn("place", place).filter(F.col("place") <= most).select("family", "w", "_id", "_component", "n", "m", (F.col("m") - F.col("place")).alias("left"), (F.col("place") <= F.floor(most / 2)).alias("first")), "postings")
    x, y = postings.filter("first").alias("x"), postings.alias("y")
    smaller = (F.col("x.m") < F.col("y.m")) | ((F.col("x.m") == F.col("y.m")) & (F.col("x._id") < F.col("y._id")))
    total, most_shared = F.col("x.n") + F.col("y.n"), F.least("x.left", "y.left")
    enough = within(total, F.col("x.m") + F.col("y.m") - 2 * most_shared)
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.w") == F.col("y.w")) & smaller & (F.col("x._component") != F.col("y._component")) & enough & within(total, F.col("y.m") - F.col("x.m")))
    return pairs.select(F.least("x._id", "y._id").alias("a"), F.greatest("x._id", "y._id").alias("b")).distinct(), links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable, itself included), kept.

    Null and empty texts have no shingles and are linked with nothing; texts of any length are taken whole. Rows of one
    id are one document, which each of its texts links. Ids must be whole numbers; a null one counts as the largest and
    comes back as null. An empty table gives none, other columns don't matter, whatever their names. No link between
    classes that share a bucket is lost: work on a bucket grows with its members, and only those of buckets that stars
    leave in several components meet in the exact join, by the rare shingles of their differences from a pivot. The worst
    case is a family of pages that differ from one another just too much to be linked: pairs are formed for the rarest
    shingle that each lacks or has of its own, which for n pages of which a share s lacks each shingle are about s n^2.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                first, second = _signed(xxh3_128_digest(s.tobytes()))
                d1.append(first)
                d2.append(second)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "n_shingles", "d1", "d2", "keys"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, sets = [], []
            for i, text, d1, d2 in zip(*batch.columns, strict=True):
                s = shingle_set(text.as_py(), words)
                if _signed(xxh3_128_digest(s.tobytes())) == (d1.as_py(), d2.as_py()):
                    ids.append(i.as_py())
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["_id", "set"])

    with scratch(docs.sparkSession) as keep:
        own = docs.select(row_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        sketches = keep(stored(own.mapInArrow(sketch, "_id long, n_shingles long, d1 long, d2 long, keys array<long>"), "sketches"))
        classes = stored(sketches.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("_id").alias("_id"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")

        # buckets of two classes or more: (key, _id, n) and each bucket's centre
        banded = classes.select("_id", "n", F.explode("keys").alias("key"))
        centres = stored(banded.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("_id", "n")).alias("centre")).filter("members > 1").select("key", F.col("centre._id").alias("a"), F.col("centre.n").alias("na")), "centres")
        members = stored(banded.join(centres, "key").filter("_id != a"), "members")
        involved = members.select("_id").unionByName(centres.select(F.col("a").alias("_id"))).distinct()
        chosen = classes.select("_id", "d1", "d2").join(involved, "_id")
        sets = stored(own.join(chosen, "_id").select("_id", "_text", "d1", "d2").mapInArrow(full, "_id long, set binary").dropDuplicates(["_id", "set"]), "sets")

        near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else the sets are too unequal
        first = stored(confirmed(members.filter(near(F.col("n"), F.col("na"))).select("a", F.col("_id").alias("b")).distinct(), sets, percent), "star")
        links = [first]
        # second stars, for members that their centre isn't linked with
        tried = members.join(first.withColumnRenamed("b", "_id"), ["a", "_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
        rest = stored(tried.select("key", "a", "_id", "n", "linked", "similarity"), "tried")
        heads = stored(
            rest.groupBy("key")
            .agg(
                F.min(F.when(~F.col("linked"), F.struct("_id", "n"))).alias("outer"),
                F.max(F.when(F.col("linked"), F.struct("similarity", "_id", "n"))).alias("inner"),
                F.count_if(~F.col("linked")).alias("outside"),
            )
            .filter("outside > 0"),
            "heads",
        )
        outside = rest.filter(~F.col("linked")).select("key", "_id", "n")
        ends = heads.select("key", F.explode(F.array(F.struct(F.col("outer._id").alias("a"), F.col("outer.n").alias("na")), F.struct(F.col("inner._id").alias("a"), F.col("inner.n").alias("na")))).alias("_end")).select("key", "_end.*").filter("a IS NOT NULL")
        more = outside.join(stored(ends, "ends"), "key").filter(F.col("a") != F.col("_id")).filter(near(F.col("n"), F.col("na")))
        more = more.select(F.least("a", "_id").alias("a"), F.greatest("a", "_id").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
        links.append(stored(confirmed(more, sets, percent), "star"))
        edges = links[0].unionByName(links[1]).filter("linked").select("a", "b")

        reached = stored(components(edges).select(F.col("node").alias("_id"), "component"), "reached")
        # every pair of a bucket whose members but the centre are in several components
        inside = stored(members.select("key", "_id").join(reached, "_id", "left").select("key", "_id", F.coalesce("component", "_id").alias("_component")), "inside")
        mixed = stored(inside.groupBy("key").agg(F.min("_component").alias("_least"), F.max("_component").alias("_most")).filter("_least != _most").select("key"), "mixed")
        # buckets that have a member in common are one family, named by its smallest id
        bucketed = members.join(mixed, "key", "left_semi").select("a", F.col("_id").alias("b")).distinct()
        families = stored(components(bucketed).select(F.col("node").alias("_id"), F.col("component").alias("family")), "families")
        unsettled = families.select("_id").join(reached, "_id", "left").select("_id", F.coalesce("component", "_id").alias("_component"))
        pairs, pivoted = family_pairs(sets.join(unsettled, "_id"), families, percent)
        found = stored(confirmed(stored(pairs, "pairs"), sets, percent).filter("linked").select("a", "b").unionByName(pivoted), "found")
        of = lambda k: reached.select(F.col("_id").alias(k), F.col("component").alias(f"of_{k}"))
        # components of components
        merged = components(found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
        first_of = classes.select("d1", "d2", "_id").join(reached, "_id", "left").select("d1", "d2", F.coalesce("component", "_id").alias("node"))
        placed = keep(stored(first_of.join(merged, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("_component")), "placed"))
    out = sketches.select("_id", "n_shingles", "d1", "d2").join(placed, ["d1", "d2"], "left").withColumn("_component", F.coalesce("_component", "_id"))
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).cast(id_type)
    return out.select(back("_id").alias(id_col), "n_shingles", back("_component").alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept"))
