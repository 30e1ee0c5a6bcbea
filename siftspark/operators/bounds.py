"""Sizes that a plan relies on, checked before it is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else an error, for joins that no key can distribute."""
    n = df.limit(rows + 1).count()
    if n > rows:
        raise ValueError(f"{what}: more than {rows} rows can't be joined without a key")
    return F.broadcast(df)
