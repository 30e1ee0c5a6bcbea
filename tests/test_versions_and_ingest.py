"""Tables that change together, erasure, ingest that survives replays, typed state."""

from __future__ import annotations

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from siftspark.operators import events as E
from siftspark.sources.versions import Conflict, Tables, response_tables
from siftspark.streaming import ingest, stateful


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/tables"


RESPONSES = """recommendation_id string, user_id int, conditions array<string>, recommendations array<struct<component_id: string, name: string, reason: string, score: double, type: string, condition: string>>,
packs_ranked array<struct<pack_id: string, rank: int, score_final: double, components: array<struct<component_id: string, name: string>>, selected_products: array<struct<component_id: string, product_id: string, price: double, availability: string>>>>"""


def responses(spark, ids, price=1.0):
    rows = []
    for i in ids:
        products = [("c1", "old", 9.0, "no"), ("c1", f"p{i}", price, " yes "), ("c3", "other", 2.0, None)]
        packs = [("", 2, 0.5, [("c1", "One"), None, (" ", "Two")], products), ("first", 1, 0.9, [], None), (None, None, None, None, None)]
        rows.append((f"r{i}", i, ["x"], [("c1", " One ", "", 0.7, "core", "x"), ("c2", "Two", "why", None, None, None)], packs))
    return spark.createDataFrame(rows, RESPONSES)


def test_nested_responses_become_five_tables(spark):
    t = {k: [r.asDict() for r in v.collect()] for k, v in response_tables(responses(spark, [1])).items()}
    assert list(t) == ["sessions", "items", "packs", "pack_items", "impressions"]
    assert [(r["rank"], r["component_name"], r["reason"]) for r in t["items"]] == [(1, "One", None), (2, "Two", "why")]
    assert [(r["pack_key"], r["rank"]) for r in t["packs"]] == [("pack_2", 2), ("first", 1), ("pack_0", 0)]
    assert [(r["rank"], r["component_id"], r["product_id"], r["price_at_recommendation"], r["availability_at_recommendation"]) for r in t["pack_items"]] == [(1, "c1", "p1", 1.0, "yes"), (3, None, None, None, None)]
    assert [(r["pack_key"], r["position"], r["event_type"]) for r in t["impressions"]] == [("pack_2", 2, "impression"), ("first", 1, "impression"), ("pack_0", 0, "impression")]


class Stopped(Exception):
    pass


def test_a_stop_between_any_two_steps_leaves_a_whole_version(spark, root):
    first, second = (response_tables(responses(spark, ids, p)) for ids, p in (([1, 2], 1.0), ([3], 7.0)))
    Tables(spark, root).commit(put=first)
    whole = lambda parts: {k: sorted(map(str, v.collect())) for k, v in parts.items()}
    old, new = whole(first), whole(second)
    steps = []
    Tables(spark, root + "-dry", steps.append).commit(put=second)
    assert steps == ["wrote sessions", "wrote items", "wrote packs", "wrote pack_items", "wrote impressions", "staged the version", "published"]
    for n in range(len(steps)):
        done = []

        def stop(step, n=n, done=done):
            done.append(step)
            if len(done) > n:
                raise Stopped

        with pytest.raises(Stopped):
            Tables(spark, root, stop).commit(put=second)
        t = Tables(spark, root)
        assert whole({k: t.read(k) for k in t.names()}) == (new if n == len(steps) - 1 else old), steps[n]
    assert Tables(spark, root).version()["number"] == 2
    assert whole({"packs": Tables(spark, root).read("packs", 1)})["packs"] == old["packs"]
    left = Tables(spark, root).purge()
    assert len([x for x in left if "/packs/" in x]) == 5 and whole({"packs": Tables(spark, root).read("packs")})["packs"] == new["packs"]
    assert not [x for x in os.listdir(f"{root}/_versions") if x == "000000000001.json"]


def test_two_writers_of_one_version_conflict(spark, root):
    df = spark.range(3)

    def meanwhile(step):
        if step == "staged the version":
            Tables(spark, root).commit(put={"t": spark.range(5)})

    with pytest.raises(Conflict):
        Tables(spark, root, meanwhile).commit(put={"t": df})
    assert Tables(spark, root).read("t").count() == 5


def hashes(root, table):
    out = {}
    for top, _, names in os.walk(f"{root}/{table}"):
        for n in names:
            if n.endswith(".parquet"):
                out[n] = hashlib.sha256(open(os.path.join(top, n), "rb").read()).hexdigest()
    return out


def test_erase_rewrites_only_the_files_that_hold_the_subject(spark, root):
    t = Tables(spark, root)
    users = spark.range(100).select((F.col("id") % 50).alias("user_id"), F.col("id").alias("v")).repartitionByRange(10, "user_id")
    t.commit(put={"labs": users, "plain": spark.range(4)}, append={"profile": spark.createDataFrame([(7, "a"), (None, "b")], "user_id long, v string").coalesce(1)})
    t.commit(append={"labs": spark.createDataFrame([(7, 1000), (8, 1001)], "user_id long, v long").coalesce(1)})
    before = hashes(root, "labs")
    own = {(r.table, r.row) for r in t.export("user_id", 7).collect()}
    assert own == {("labs", '{"user_id":7,"v":7}'), ("labs", '{"user_id":7,"v":57}'), ("labs", '{"user_id":7,"v":1000}'), ("profile", '{"user_id":7,"v":"a"}')}
    t.erase("user_id", 7, "me")
    assert t.export("user_id", 7).count() == 0 and t.read("labs").count() == 99 and t.read("profile").count() == 1 and t.read("plain").count() == 4
    assert sorted(r.v for r in t.read("labs").filter("user_id = 8").collect()) == [8, 58, 1001]
    t.purge()
    after = hashes(root, "labs")
    kept = set(before) & set(after)
    assert len(before) - len(kept) == 2 and all(before[k] == after[k] for k in kept) and t.read("labs").count() == 99
    audit = t.read("audit").first()
    assert (audit.action, audit.actor, audit.subject) == ("erase", "me", hashlib.sha256(b"7").hexdigest())
    with pytest.raises(Stopped):

        def stop(step):
            raise Stopped

        Tables(spark, root, stop).erase("user_id", 8, "me")
    assert t.export("user_id", 8).count() == 3


EVENT = "struct<survey_session_id: string, step_key: string, event_type: string, position: int, visible_steps: int, contract_version: string>"


def requests(spark):
    good = ("session-1", "step_1", "view", 1, 5, None)
    rows = [("a", [good] * 3), ("b", []), ("c", None), ("d", [good] * 101), ("e", [good] * 100), ("f", [good, ("short", *good[1:])]), ("g", [("session-1", "Step", *good[2:])]), ("h", [("session-1", "s", "other", None, None, None)]), ("i", [("session-1", "s", "submit", 201, None, None)]), ("j", [("session-1", "s", "submit", None, None, "x" * 21)])]
    return spark.createDataFrame(rows, f"request_id string, events array<{EVENT}>")


def test_ingest_writes_once_whatever_is_replayed(spark, root):
    folder = os.path.dirname(root)
    requests(spark).repartition(3, "request_id").write.parquet(f"{folder}/in")

    def run(tables, checkpoint):
        stream = spark.readStream.schema(requests(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = ingest.ingest(stream, tables, "survey", ingest.survey_checks, ingest.MOST_SURVEY_EVENTS).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)

    def stop(step, seen=[]):  # noqa: B006
        seen.append(step)
        if seen.count("published") == 2:  # the second batch is written, but the stream doesn't know
            raise Stopped

    with pytest.raises(Exception, match="Stopped"):
        run(Tables(spark, root, stop), f"{folder}/cp")
    t = Tables(spark, root)
    assert t.version()["ledger"] == {"survey": 1}
    run(t, f"{folder}/cp")
    assert t.version()["ledger"]["survey"] >= 2
    assert {(r.request_id, r.n) for r in t.read("events").groupBy("request_id").agg(F.count("*").alias("n")).collect()} == {("a", 3), ("e", 100)}
    why = {"b": "no_events", "c": "no_events", "d": "too_many_events", "f": "invalid survey_session_id", "g": "invalid step_key", "h": "invalid event_type", "i": "invalid position", "j": "invalid contract_version"}
    assert sorted((r.request_id, r.reason) for r in t.read("rejected").collect()) == sorted(why.items())
    run(t, f"{folder}/cp-lost")  # a stream that begins anew: its first batches are in the ledger
    assert t.read("events").count() == 103


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(df, folder, name, **trigger):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(**trigger or {"availableNow": True}).start()
    assert q.awaitTermination(180)
    return q, df.sparkSession.table(name)


def test_limiter_on_typed_state(spark, sf_dir, root):
    folder = os.path.dirname(root)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id < 6").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(2, "ts").write.parquet(f"{folder}/in")
    want = {(r.user_id, r.ts, r.in_window, r.allowed) for r in E.rate_limited(events, "user_id", "ts", "event_id", 86_400, 2).collect()}
    spark.conf.set(*ROCKS)
    try:
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        q, got = drained(stateful.limited(stream.select("user_id", "ts"), "user_id", seconds=86_400, most=2, late="1000 days"), folder, "typed")
        assert {tuple(r) for r in got.collect()} == want and any(not w[3] for w in want)
        # a watermark that moves on: silent keys leave the state
        last = events.agg(F.max("ts")).first()[0]
        spark.createDataFrame([(99, 99, last.replace(year=last.year + 1))], events.schema).write.parquet(f"{folder}/in/late")
        both = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).option("latestFirst", False).parquet(f"{folder}/in")
        q, _ = drained(stateful.limited(both.select("user_id", "ts"), "user_id", seconds=60, most=2, late="1 second"), folder, "silent")
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        assert rows[-1] < max(rows), rows
        before = events.groupBy("user_id").agg((F.min("ts") - F.expr("INTERVAL 10 MINUTES")).alias("ts"))
        _, begun = drained(stateful.limited(stream.select("user_id", "ts"), "user_id", seconds=86_400, most=2, late="1000 days", before=before), folder, "begun")
        assert begun.groupBy("user_id").agg(F.min_by("in_window", "ts").alias("n")).filter("n != 1").count() == 0
        # with times to live, a stream never runs out of batches: one is asked for
        _, once = drained(stateful.impressions_once(stream, "user_id", "event_id"), folder, "once", once=True)
        assert once.count() == events.select("user_id", "event_id").distinct().count()
    finally:
        spark.conf.unset(ROCKS[0])
