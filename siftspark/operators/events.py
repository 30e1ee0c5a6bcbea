"""Events: idempotent impressions, funnels, sessions, sliding limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_repeated(df: DataFrame, keys: list[str], order: list[str], repeats: Column) -> DataFrame:
    """Of the rows that `repeats` marks, the first of each key stays; all others stay."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    once = df.filter(repeats).withColumn("_rn", rn).filter("_rn = 1").drop("_rn")
    return once.unionByName(df.filter(~repeats))


def sessions(df: DataFrame, key: str, at: str, order: str, gap_s: int) -> DataFrame:
    """df with session_no: a new one after more than gap_s seconds without an event of the key."""
    w = Window.partitionBy(key).orderBy(at, order)
    new = F.when(F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(w).cast("timestamp")) > gap_s, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def funnel(df: DataFrame, session: str, step: str, kind: str, at: str, order: str, position: str) -> DataFrame:
    """(step, viewed, completed, abandoned_here, drop_rate, mean_position) of every step that was viewed, in sessions.

    A session abandons at its last viewed step, if it never submits. kind: view, complete or submit. mean_position: of
    the views that know their position, else 999; it is the order in which steps are shown.
    """
    view = F.col(kind) == "view"
    last = df.groupBy(session).agg(F.max_by(F.when(view, F.col(step)), F.when(view, F.struct(at, order))).alias("_last"), F.bool_or(F.col(kind) == "submit").alias("_done"))
    left = last.filter(~F.col("_done") & F.col("_last").isNotNull()).groupBy(F.col("_last").alias(step)).agg(F.count("*").alias("abandoned_here"))
    seen = df.filter(F.col(kind).isin("view", "complete")).groupBy(step, session).agg(F.bool_or(view).alias("_v"), F.bool_or(~view).alias("_c"), F.sum(F.when(view, F.col(position))).alias("_sum"), F.count(F.when(view, F.col(position))).alias("_n"))
    n = seen.groupBy(step).agg(F.count_if("_v").alias("viewed"), F.count_if("_c").alias("completed"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")).filter("viewed > 0")
    abandoned = F.coalesce("abandoned_here", F.lit(0)).cast("long")
    place = F.round(F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(F.lit(999.0)), 4)
    return n.join(left, step, "left").select(step, "viewed", "completed", abandoned.alias("abandoned_here"), F.round(abandoned / F.col("viewed"), 4).alias("drop_rate"), place.alias("mean_position"))


def funnel_summary(df: DataFrame, session: str, kind: str) -> DataFrame:
    """One row: sessions that viewed or submitted, those that submitted, and their share."""
    per = df.groupBy(session).agg(F.bool_or(F.col(kind) == "view").alias("_v"), F.bool_or(F.col(kind) == "submit").alias("_s"))
    out = per.agg(F.count_if(F.col("_v") | F.col("_s")).alias("sessions"), F.count_if("_s").alias("submitted"))
    return out.withColumn("completion_rate", F.when(F.col("sessions") > 0, F.round(F.col("submitted") / F.col("sessions"), 4)))


def rate_limited(df: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """df with in_window (requests of the key that were let through in the last seconds, before this one) and allowed.

    A refused request doesn't count, so a key that keeps asking is let through again. A key's requests are cut where
    more than `seconds` pass without any: nothing reaches over such a gap, so its parts are folded apart, in order, each
    holding `most` times at once.
    """
    parts = sessions(df.withColumn("_s", F.unix_micros(F.col(at).cast("timestamp")) / 1e6), key, at, order, seconds)
    ordered = parts.repartition(key, "session_no").sortWithinPartitions(key, "session_no", at, order)

    def fold(batches):
        import pyarrow as pa

        now, hits = None, []
        for batch in batches:
            names = batch.schema.names
            keys = zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index("session_no")).to_pylist(), strict=True)
            inside, allowed = [], []
            for k, t in zip(keys, batch.column(names.index("_s")).to_pylist(), strict=True):
                if k != now:
                    now, hits = k, []
                hits = [x for x in hits if x >= t - seconds]
                inside.append(len(hits))
                allowed.append(len(hits) < most)
                if allowed[-1]:
                    hits.append(t)
            own = [c for c in names if c not in ("_s", "session_no")]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in own), pa.array(inside, pa.int64()), pa.array(allowed, pa.bool_())], [*own, "in_window", "allowed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return ordered.mapInArrow(fold, f"{fields}, in_window long, allowed boolean")
