"""Structured Streaming forms of the event operators; each takes a streaming DataFrame with a `timestamp` column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, at: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with its time as a timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn(at, F.col(at).cast("timestamp"))


def valid(events: DataFrame, kinds: tuple[str, ...], kind: str = "event_type", at: str = "ts") -> DataFrame:
    """Rows with a known type and a time; the rest is dropped at the door."""
    return events.filter(F.col(kind).isin(*kinds) & F.col(at).isNotNull())


def impressions_once(events: DataFrame, keys: list[str], repeats: Column, at: str = "ts", late: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(impressions without repeats within the delay, all other events)."""
    return events.filter(repeats).withWatermark(at, late).dropDuplicatesWithinWatermark(keys), events.filter(~repeats)


def counts(events: DataFrame, keys: list[str], at: str = "ts", length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling or sliding windows."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, keys: list[str], at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def click_rate(events: DataFrame, keys: list[str], shown: Column, clicked: Column, at: str = "ts", length: str = "1 day", late: str = "1 hour") -> DataFrame:
    n = events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), *keys).agg(F.count_if(shown).alias("shown"), F.count_if(clicked).alias("clicked"))
    return n.select(F.col("w.start").alias("start"), *keys, "shown", "clicked", F.when(F.col("shown") > 0, F.round(F.col("clicked") / F.col("shown"), 4)).alias("rate"))


def limited(events: DataFrame, key: str, at: str = "ts", seconds: int = 60, most: int = 60, late: str = "1 hour") -> DataFrame:
    """(key, ts, in_window, allowed): a sliding limit with the times of the key's last let-through requests as state.

    Refused requests don't count. A key's state goes once the watermark is past its last request by the window's length;
    requests older than the watermark are dropped.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = sorted(t for f in frames for t in f[at])
        out = []
        for t in rows:
            s = t.timestamp()
            recent = [r for r in recent if r >= s - seconds]
            out.append((k[0], t, len(recent), len(recent) < most))
            if len(recent) < most:
                recent.append(s)
        state.update((recent,))
        last = max(recent, default=0.0)
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, at, "in_window", "allowed"])

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, in_window long, allowed boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_votes(votes: DataFrame, keys: list[str], at: str, sink: Callable[[DataFrame, int], None]):
    """A streaming writer whose batches hold each key's latest row; the sink merges them into its table."""

    def batch(df: DataFrame, n: int) -> None:
        rest = [c for c in df.columns if c not in keys]
        sink(df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(*keys, "_r.*"), n)

    return votes.writeStream.foreachBatch(batch)


def purged(df: DataFrame, at: str, cutoff: Column, redact: list[str]) -> DataFrame:
    """Rows older than the cutoff keep their keys and lose the named columns."""
    return df.withColumns({c: F.when(F.col(at) >= cutoff, F.col(c)) for c in redact})
