"""Batched ingest of requests: limits, checks, rejected requests with their reason, and writing once whatever is replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.sources.versions import Tables

#: Events that one request may bring.
MOST_RECOMMENDATION_EVENTS, MOST_SURVEY_EVENTS = 50, 100

_text = lambda c, least, most: c.isNotNull() & F.length(c).between(least, most)
_optional = lambda c, most: c.isNull() | (F.length(c) <= most)
_number = lambda c, most: c.isNull() | c.between(0, most)


def survey_checks(e: Column) -> dict[str, Column]:
    """What a survey event must hold, by field."""
    return {
        "survey_session_id": _text(e["survey_session_id"], 8, 80),
        "step_key": _text(e["step_key"], 1, 80) & e["step_key"].rlike("^[a-z0-9_]+$"),
        "event_type": e["event_type"].isin("view", "complete", "submit"),
        "position": _number(e["position"], 200),
        "visible_steps": _number(e["visible_steps"], 200),
        "contract_version": _optional(e["contract_version"], 20),
    }


def recommendation_checks(kinds: tuple[str, ...]):
    """What an event of a recommendation must hold, by field; kinds: the event types there are."""
    return lambda e: {
        "recommendation_id": _text(e["recommendation_id"], 1, 120),
        "event_type": e["event_type"].isin(*kinds),
        "pack_key": _optional(e["pack_key"], 160),
        "component_id": _optional(e["component_id"], 120),
        "product_id": _optional(e["product_id"], 64),
        "position": _number(e["position"], 1000),
        "conditions": e["conditions"].isNull() | (F.size(e["conditions"]) <= 20),
    }


def refusal(events: Column, checks, most: int) -> Column:
    """Why a request is refused as a whole, null if it isn't: too few or too many events, or the first field of the first event that fails."""
    wrong = lambda e: F.get(F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(f"invalid {name}")) for name, ok in checks(e).items()])), F.lit(0))
    n = F.coalesce(F.size(events), F.lit(0))
    return F.when(n < 1, "no_events").when(n > most, "too_many_events").otherwise(F.get(F.filter(F.transform(events, wrong), lambda w: w.isNotNull()), F.lit(0)))


def ingest(requests: DataFrame, tables: Tables, stream: str, checks, most: int, key: str = "request_id", accepted: str = "events", rejected: str = "rejected"):
    """A streaming writer: events of good requests go to one table, refused requests with reason and content to another.

    requests: key and `events`, an array of structs. Both tables and the batch's number in the ledger appear in one
    version, so a batch that is run again after a stop finds its number and writes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        if tables.version()["ledger"].get(stream, -1) >= number:
            return
        judged = df.withColumn("_reason", refusal(F.col("events"), checks, most))
        good = judged.filter("_reason IS NULL").select(key, F.posexplode("events").alias("event_no", "_e")).select(key, "event_no", "_e.*")
        bad = judged.filter("_reason IS NOT NULL").select(key, F.col("_reason").alias("reason"), F.to_json("events").alias("content"))
        tables.commit(append={accepted: good, rejected: bad}, ledger={stream: number})

    return requests.writeStream.foreachBatch(batch)
