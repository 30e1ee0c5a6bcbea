"""What the operators of this subpackage share: tables in the shared folder, text scans."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The ASCII white space `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null id inside joins: the largest one, so a null never owns anything first.
NULL_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster without one is refused."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a shared folder for intermediate tables")
        known = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; then as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: The intermediate tables of the innermost `scratch`.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def stored(df: DataFrame, name: str = "t", sort: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and a lost executor costs a reread.

    The job's shuffle files go when the table is written.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/sift-{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sift_path = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables `stored` inside when left, but for those passed to the function it gives.

    Those belong to the scratch around it, if there is one; else they are the caller's, who has a result that reads them.
    """
    outer, mine, needed = _made.get(), [], set()

    def keep(df: DataFrame) -> DataFrame:
        needed.add(df._sift_path)
        return df

    token = _made.set(mine)
    try:
        yield keep
    finally:
        _made.reset(token)
        for path in mine:
            if path not in needed:
                discard(spark, path)
            elif outer is not None:
                outer.append(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote to the shared folder."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(top, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay at some MB. The setting stays on in the session: results are read after a query has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def row_id(id_col: str) -> Column:
    """The id as a whole number; ids of other types must be numbered first."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def text_hash(text_col: str) -> tuple[Column, Column]:
    """128 bits of a text, in two halves of different seeds; a null text hashes as such."""
    return F.xxhash64(F.col(text_col)), F.xxhash64(F.lit("second half"), F.col(text_col))
