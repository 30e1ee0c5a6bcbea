"""Readers and writers: all-string CSV, several formats, SAS transport files, manifests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import text


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def separator(spark: SparkSession, path: str, among: str = ",;\t|") -> str:
    """The sign of those given that the file's first line has most of; the first one if it has none."""
    line = (spark.read.text(path).filter("trim(value) != ''").head() or [""])[0]
    return max(among, key=line.count)


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str | None = ",") -> DataFrame:
    """A CSV with a header, every column a string, blanks null; a byte order mark goes. A missing file is an empty table of the columns given. Without a separator the file's own is found."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns or ["value"]))
    sep = sep or separator(spark, path)
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    df = df.select(*[F.when(F.trim(c) != "", F.col(f"`{c}`")).alias(c) for c in df.columns])
    if not columns:
        return df
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV, tab-separated text, JSON, Parquet, or the largest table of a page, by the file's name."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("html", "htm"):
        return read_page_table(spark, path, columns)
    if kind in ("csv", "txt", "tsv"):
        return read_strings(spark, path, columns, "\t" if kind == "tsv" else None)
    df = spark.read.option("multiLine", kind == "json").format("json" if kind in ("json", "jsonl") else "parquet").load(path)
    return df.select(*columns) if columns else df


def read_page_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The largest table of each page, every column a string, named by the first row; blanks are null. Pages without a table are an error if none has one."""
    rows = spark.read.text(path, wholetext=True).select(text.table_rows(F.col("value")).alias("_rows")).filter("_rows IS NOT NULL")
    first = rows.select(F.get("_rows", F.lit(0)).alias("names")).head()
    if first is None:
        raise ValueError(f"no table in {path}")
    cells = rows.select(F.explode(F.slice("_rows", F.lit(2), F.size("_rows"))).alias("_c"))
    own = {name: F.when(F.get("_c", F.lit(i)) != "", F.get("_c", F.lit(i))) for i, name in enumerate(first.names)}
    return cells.select(*[own.get(c, F.lit(None).cast("string")).alias(c) for c in columns or list(own)])


def by_alias(df: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their canonical names, the first alias that is there and not null; a missing required one is an error."""
    low = {c.lower(): c for c in df.columns}
    found = {k: [low[a.lower()] for a in v if a.lower() in low] for k, v in aliases.items()}
    if missing := [k for k in required if not found.get(k)]:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df.select(*[(F.coalesce(*[F.col(f"`{c}`") for c in v]) if v else F.lit(None).cast("string")).alias(k) for k, v in found.items()])


def read_xpt(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """SAS transport files, one task a file: the columns asked for, null where a file lacks one."""
    import io

    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())

    def parse(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for raw in frame["content"]:
                df = pd.read_sas(io.BytesIO(raw), format="xport", encoding="utf-8")
                yield df.reindex(columns=list(columns))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def to_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("errorifexists").parquet(path)


def append_audit(df: DataFrame, before: list[str], after: list[str], path: str, by: str) -> None:
    """Appends who changed what as JSON before and after."""
    df.select(F.lit(by).alias("actor"), F.to_json(F.struct(*before)).alias("before"), F.to_json(F.struct(*after)).alias("after")).write.mode("append").parquet(path)
