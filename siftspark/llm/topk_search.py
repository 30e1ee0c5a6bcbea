"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are numbered by clusters over the whole table (their nearest pivot, a sampled vector) and laid out in blocks of
neighbouring numbers, each with a forward index (its vectors) and the largest and smallest value of each term. For a
query, a block's bound is the sum over terms of the larger of weight times maximum and weight times minimum. A task
takes its blocks in order of falling bound and scores them through their forward indexes until the bound falls below
the k-th best score; the tasks' best rows are merged. Every task starts from the query's k-th best score among the
pivots, so no task has to find ten good rows of its own first.

How much is pruned depends on the data: on clustered vectors most blocks are skipped, on vectors without any structure
(independent components) the summed maxima lie above every score and none is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm._shared import stored

#: Vectors of a block, and queries of a chunk.
BLOCK, CHUNK = 16, 256
#: Bytes of a task's group of blocks; long vectors make smaller groups.
GROUP_BYTES = 4 << 20
#: Sampled vectors that documents are numbered by: those nearest to one of them stand together.
PIVOTS = 512


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def pivots_of(rows: DataFrame, count: int = PIVOTS) -> list[tuple[int, list[int]]]:
    """(_id, _v) of the rows with the smallest hashes, `count` at most. A first cut by hash leaves few more, so no task sends many."""
    place = F.pmod(F.xxhash64(F.lit("pivot"), "_id", "_v"), F.lit(1 << 30))
    cut = math.ceil((2 * count + 100) / max(1, rows.count()) * (1 << 30))
    return [(r["_id"], r["_v"]) for r in rows.filter(place < cut).orderBy(place, "_id", "_v").select("_id", "_v").limit(count).collect()]


def _pivot_matrix(pivots, dims: int):
    import numpy as np

    out = np.zeros((len(pivots), dims), np.int64)
    for k, (_, v) in enumerate(pivots):
        out[k, : len(v)] = v
    return out


def blocks_of(rows: DataFrame, pivots, dims: int, parts: int, block: int = BLOCK) -> DataFrame:
    """rows: _id, _v (array<long>). One row per block: grp, ids, values, high, low (binary int64).

    Rows are sorted by (pivot, id hash) over the whole table and cut into `parts` ranges of about equal size, so that a
    cluster of a third of all rows, or one vector repeated as often, is spread over a third of the groups.
    """
    matrix = _pivot_matrix(pivots, dims)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        p = matrix.astype(float)
        half = (p * p).sum(axis=1) / 2
        for batch in batches:
            v = _matrix(batch.column(1), dims).astype(float)
            found = np.argmax(v @ p.T - half, axis=1) if len(p) else np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], ["_id", "_v", "_pivot"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = _matrix(batch.column(1), dims)
            out = {k: [] for k in ("ids", "values", "high", "low")}
            for at in range(0, len(ids), block):
                own = slice(at, at + block)
                for k, x in (("ids", ids[own]), ("values", v[own]), ("high", v[own].max(axis=0)), ("low", v[own].min(axis=0))):
                    out[k].append(np.ascontiguousarray(x, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary()) for k in out], list(out))

    kind = rows.schema["_id"].dataType.simpleString()
    numbered = rows.select("_id", "_v").mapInArrow(nearest, f"_id {kind}, _v array<long>, _pivot int").withColumn("_h", F.xxhash64("_id", "_v"))
    numbered = numbered.repartitionByRange(parts, "_pivot", "_h").sortWithinPartitions("_pivot", "_h")
    return numbered.select("_id", "_v").mapInArrow(lay, "ids binary, values binary, high binary, low binary").withColumn("grp", F.spark_partition_id().cast("long"))


def _matrix(column, dims: int):
    """Rows of up to dims numbers; missing trailing ones count as 0."""
    import numpy as np

    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def search_blocks(blocks: list[tuple], queries: list[tuple], dims: int, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query id, vector id, score) of each query's best k in these blocks, and how many blocks were scored for a query.

    queries: (id, vector, least); rows below `least`, a score that k other rows are known to reach, may be missing.
    """
    import numpy as np

    ids = [np.frombuffer(b[0], np.int64) for b in blocks]
    values = [np.frombuffer(b[1], np.int64).reshape(-1, dims) for b in blocks]
    high, low = (np.stack([np.frombuffer(b[c], np.int64) for b in blocks]).astype(float) for c in (2, 3))
    q = np.stack([np.frombuffer(x[1], np.int64) for x in queries])
    bounds = np.maximum(q, 0).astype(float) @ high.T + np.minimum(q, 0).astype(float) @ low.T
    bounds += 1e-12 * np.abs(bounds) + 1e-6  # the bounds' rounding
    order = np.argsort(-bounds, axis=1, kind="stable")
    out, scored = [], 0
    for i, (query, _, least) in enumerate(queries):
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = order[i]
        falling, kth = bounds[i][rest], -math.inf if least is None else least
        at = 0
        while at < len(rest):
            # strictly below: a tie may still win by its id
            stop = int(np.searchsorted(-falling, -kth, side="right"))
            if at >= stop:
                break
            # the blocks that are open now, some at a time
            own_blocks = rest[at : min(stop, at + 16)]
            at += len(own_blocks)
            scored += len(own_blocks)
            v = np.concatenate([ids[b] for b in own_blocks])
            s = np.concatenate([values[b] for b in own_blocks]) @ q[i]
            own = (v != query) & (s >= kth)
            s, v = np.concatenate([best_s, s[own]]), np.concatenate([best_i, v[own]])
            keep = np.lexsort((v, -s))[:k]
            best_s, best_i = s[keep], v[keep]
            if len(best_s) == k:
                kth = max(kth, int(best_s[-1]))
        out += [(query, int(v), int(s)) for v, s in zip(best_i, best_s, strict=True)]
    return out, scored


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, group_bytes: int = GROUP_BYTES, chunk: int = CHUNK, block: int = BLOCK, scored: Accumulator | None = None
) -> DataFrame:
    """query_id, rank, <id_col>, score: each query row's k best other rows, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and null ids, take no part. Shorter vectors count as
    padded with zeros; an overlong one makes every block longer, and groups then hold fewer vectors. Scores are right up to 64 bits: vectors of so large
    components that a sum of products leaves them aren't meant. Repeated rows of one id are scored each; a query never meets a row of its own id. An empty table gives none, and other columns don't
    matter. The stated queries are dealt in chunks against groups of blocks, both of bounded size; only the pivots, a
    bounded sample, are sent to every task. scored: counts the blocks that were scored, over all queries.
    """
    own = F.col(id_col)
    rows = vectors.select(own.cast("long").alias("_id"), whole_numbers(F.col(vector_col), scale).alias("_v"), is_query.alias("_q")).filter("_id IS NOT NULL AND _v IS NOT NULL")
    rows = stored(rows, "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("dims"), F.count_if("_q").alias("queries")).first()
    dims = max(1, size.dims or 1)
    chunks = max(1, math.ceil(size.queries / chunk))
    pivots = pivots_of(rows)
    parts = max(1, math.ceil(size.n * 8 * dims / group_bytes))
    blocks = stored(blocks_of(rows, pivots, dims, parts, block), "blocks")
    matrix, pivot_ids = _pivot_matrix(pivots, dims), [i for i, _ in pivots]

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The query's bytes, and its k-th best score among the pivots of other ids."""
        import numpy as np

        ids = np.array(pivot_ids, np.int64)
        for batch in batches:
            q, least = _matrix(batch.column(1), dims), []
            for i, s in zip(batch.column(0).to_pylist(), q @ matrix.T, strict=True):
                best = np.sort(s[ids != i])[::-1]
                least.append(int(best[k - 1]) if len(best) >= k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(least, pa.int64())], ["_id", "q", "least"])

    queries = rows.filter("_q").select("_id", "_v").mapInArrow(prepared, "_id long, q binary, least long").distinct().withColumn("chunk", F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int"))
    groups = blocks.select("grp").distinct()
    # each chunk of queries is sent once to each group of blocks
    sent = queries.groupBy("chunk").agg(F.collect_list(F.struct("_id", "q", "least")).alias("queries"))
    pairs = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(sent, "chunk")
    held = blocks.groupBy("grp").agg(F.collect_list(F.struct("ids", "values", "high", "low")).alias("blocks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, blocks in zip(batch.column(0), batch.column(1), strict=True):
                found, n = search_blocks([(b["ids"], b["values"], b["high"], b["low"]) for b in blocks.as_py()], [(q["_id"], q["q"], q["least"]) for q in queries.as_py()], dims, k)
                if scored is not None:
                    scored.add(n)
                a, b, s = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, s)], ["query_id", "_id", "score"])

    found = pairs.join(held, "grp").select("queries", "blocks").mapInArrow(search, "query_id long, _id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "score")
