"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches of rising ids. A batch's distinct line hashes are merge-anti-joined with the runs of the
batches before it; those that no run holds form a new run, sorted by hash and bucketed, with the id that owns each
line. When a level has `fanout` runs, they are merged into one run of the next level, bucket by bucket. Runs are tables
in the shared folder, bucketed alike with one sorted file a bucket, and are read in that order: neither an anti-join
nor a merge shuffles or sorts them again.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm._shared import ASCII_SPACE, NULL_ID, ascii_lower, discard, row_id, scratch, settings, shared_dir, stored, text_hash

KEY = ["_h1", "_h2"]
#: Bytes of line hashes a bucket of a run should hold; the number of buckets follows the batch's size.
BUCKET_BYTES = 64 << 20
#: Spark takes a bucket's file as sorted only if told so; it holds where every bucket is one file, as here.
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The runs of lines seen so far, by level. Jobs on them run with `_SORTED` set."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = f"sift_runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/{self.name}"
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        """rows: dealt out by hash of the key to as many partitions as there are buckets, so that a bucket is one file."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", f"{self.folder}/{self.made}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.folder}/{name.rpartition('_')[2]}")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those of the batch's keys that no run holds: a merge-anti-join with each run."""
        for r in self.runs():
            keys = keys.join(self.spark.table(r).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """keys: _h1, _h2, owner, none of them in a run so far."""
        self.levels[0].append(self._write(keys))
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                self._compact(at)
            at += 1

    def merged(self, runs: list[str]) -> DataFrame:
        """Runs have no key in common, so a full outer join of two merges them: like buckets meet, both in order."""
        out = self.spark.table(runs[0])
        for r in runs[1:]:
            out = out.join(self.spark.table(r).withColumnRenamed("owner", "_other").hint("merge"), KEY, "full_outer").select(*KEY, F.coalesce("owner", "_other").alias("owner"))
        return out

    def _compact(self, at: int) -> None:
        old, self.levels[at] = self.levels[at], []
        new = old[0]
        for r in old[1:]:  # two at a time: a join's result has no buckets for the next
            made = self._write(self.merged([new, r]))
            self._forget(new)
            self._forget(r)
            new = made
        if at + 1 == len(self.levels):
            self.levels.append([])
        self.levels[at + 1].append(new)

    def table(self) -> DataFrame:
        """Every line seen so far, once, with its owner; read as plain files, so that a skewed join with it can be split."""
        return self.spark.read.schema(self.spark.table(self.runs()[0]).schema).parquet(*(f"{self.folder}/{r.rpartition('_')[2]}" for r in self.runs()))

    def drop(self) -> None:
        for r in range(1, self.made + 1):  # merged ones are gone; after a failure some are not
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{r}")
        discard(self.spark, self.folder)


def line_key(line):
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def batch_bounds(lines: DataFrame, batches: int) -> list[int | None]:
    """Ids that cut the lines into batches of about equal size, None at both ends. A quantile is a double: at the largest id it is rounded beyond a long."""
    cuts = lines.approxQuantile("_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    return [None, *sorted({min(int(c), NULL_ID - 1) for c in cuts}), None]


def _lost_lines(lines: DataFrame, batches: int, fanout: int) -> DataFrame:
    """(_id, _t1, _t2, _lost): the places of the lines that a smaller id holds, by text. lines: _id, _t1, _t2, _at, _h1, _h2."""
    spark = lines.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() * 24 / BUCKET_BYTES))
    runs = LineRuns(spark, buckets, fanout)
    try:
        bounds = batch_bounds(lines, batches)
        for low, high in zip(bounds, bounds[1:], strict=False):
            batch = lines
            if low is not None:
                batch = batch.filter(F.col("_id") > low)
            if high is not None:
                batch = batch.filter(F.col("_id") <= high)
            found = batch.groupBy(*KEY).agg(F.min("_id").alias("owner"))
            runs.add(runs.unseen(found.repartition(buckets, *KEY)))
        # a hot line's rows meet its one owner row here: a plain join, which Spark splits where it is skewed
        owners = runs.table()
        lost = lines.join(owners.hint("merge"), KEY).filter(F.col("owner") < F.col("_id"))
        return stored(lost.groupBy("_id", "_t1", "_t2").agg(F.collect_set("_at").alias("_lost")), "lost")
    finally:
        runs.drop()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of docs with `kept_text`, `n_lines` and `n_dropped`.

    A line whose key has `min_chars` code points stays only in the smallest id that holds it (all its places there). A
    null or empty text is one empty line; kept_text is then empty. A null id counts as the largest. Rows of one id are
    one document: their lines count once, and none is dropped for another's sake. Extra columns are passed on, but for
    those named like one of the three new ones, which are replaced. An empty table gives an empty table. Texts of any
    length are taken whole. `batches`: of about equal row counts, in order of the id; rows without an id, however many,
    are in the last. Ids must be whole numbers. The runs are built when the function is called, before the result is read.
    """
    spark = docs.sparkSession
    h1, h2 = text_hash(text_col)
    # ids and hashes only: texts are read again where they are needed
    split = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
    keys = docs.select(row_id(id_col).alias("_id"), h1.alias("_t1"), h2.alias("_t2"), F.posexplode(F.transform(split, line_key)).alias("_at", "_key"))
    keys = keys.filter(F.char_length("_key") >= min_chars).select("_id", "_t1", "_t2", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second half"), "_key").alias("_h2"))
    with scratch(spark) as keep, settings(spark, {_SORTED: "true"}):
        lost = keep(_lost_lines(stored(keys, "lines"), batches, fanout))

    @F.pandas_udf("struct<kept_text string, n_lines long, n_dropped long>")
    def without(texts, lost):
        import pandas as pd

        out = []
        for text, gone in zip(texts, lost, strict=True):
            parts = (text or "").split("\n")
            drop = set() if gone is None else set(gone.tolist())
            out.append(("\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else text or "", len(parts), len(drop)))
        return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_dropped"])

    # the row travels as one struct, so that its column names can't clash with those used here
    own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    out = docs.select(F.struct("*").alias("_row"), row_id(id_col).alias("_id"), h1.alias("_t1"), h2.alias("_t2")).join(lost, ["_id", "_t1", "_t2"], "left")
    out = out.withColumn("_out", without(F.col("_row")[text_col].cast("string"), "_lost"))
    return out.select(*[F.col("_row")[c].alias(c) for c in own], "_out.kept_text", "_out.n_lines", "_out.n_dropped")
