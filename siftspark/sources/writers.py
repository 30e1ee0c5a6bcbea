"""Writers: safe CSV export, staged replacement, nested saves, metric text, zipped CSV, latest report."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_cell(c: Column) -> Column:
    """A text that a spreadsheet would read as a formula gets an apostrophe in front."""
    return F.when(c.rlike(r"^[=+@\t\r\-]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    own = columns or df.columns
    safe = [safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.select(*own).dtypes]
    df.select(*safe).write.option("header", True).csv(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes the whole table beside the target, then renames the old one away and the new one in.

    A reader never sees half a table. Between the two renames the path isn't there: a reader that starts just then fails
    and can try again; if the job dies there, the old table stands beside it, under the target's name and `.old-`.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, staged, old = (hadoop.Path(p) for p in (path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"))
    df.write.parquet(staged.toString())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    fs.rename(staged, target)
    if had:
        fs.delete(old, True)


def nested_parts(df: DataFrame, key: str, packs: str, items: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A nested response as flat tables: one row a session, a pack, and a pack's item. packs is an array of structs that hold the array `items`."""
    p = df.select(key, F.posexplode(packs).alias("pack_no", "_p"))
    i = p.select(key, "pack_no", F.posexplode(F.col("_p")[items]).alias("item_no", "item"))
    return df.drop(packs), p.select(key, "pack_no", F.size(F.col("_p")[items]).alias("n_items")), i


def metric_text(counts: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One line of text exposition for each row: name{label="x"} value."""
    inner = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return counts.select(F.concat(F.lit(f"{name}{{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))


def zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of every CSV inside the zip files, one task a file; `member` names the inner file."""

    def rows(frames: Iterator) -> Iterator:
        import csv
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            for raw in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for member in sorted(m for m in z.namelist() if m.lower().endswith(".csv")):
                        with z.open(member) as f:
                            found = list(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig")))
                        yield pd.DataFrame([{"member": member, **{c: r.get(c) for c in columns}} for r in found], columns=["member", *columns], dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in ["member", *columns]))


def latest_report(spark: SparkSession, pattern: str) -> DataFrame:
    """The JSON report of the newest file that fits the pattern."""
    df = spark.read.option("multiLine", True).json(pattern).withColumn("_at", F.col("_metadata.file_modification_time")).withColumn("_file", F.col("_metadata.file_path"))
    newest = df.agg(F.max(F.struct("_at", "_file")).alias("_m"))
    return df.join(F.broadcast(newest), F.struct("_at", "_file") == F.col("_m"), "left_semi").drop("_at", "_file")  # one row


def inspected(df: DataFrame) -> DataFrame:
    """(column, kind, n_null): a table's schema with its counts, in one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.col(f"`{c}`").alias("n_null")) for c, t in df.dtypes]
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
