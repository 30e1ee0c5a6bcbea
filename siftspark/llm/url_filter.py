"""URL filter with a Bloom filter cascade.

The list is a table of hosts, of any origin; the universe is every host in the pages. Level 0 encodes the listed hosts
of the universe; level 1 the unlisted ones that level 0 takes for listed; level 2 the listed ones that level 1 takes for
unlisted; and so on until a level makes no mistake. Over that universe the cascade's answer is exact, and judging a
page reads no list and joins nothing.

The universe is cut into shards by hash, each with its own small cascade. Cascades of at most `pass_bytes` together
are broadcast. Larger ones are dealt out by shard, and the pages with them, in one scan: a task reads a shard's cascade
first and then its pages as a stream. A shard with many pages is cut into parts, each of which gets the cascade.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm._shared import ascii_lower, scratch, stored

#: Host, path prefix, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: The query's list has the hosts of which a label has one of these words between hyphens.
LISTED_WORDS = ("spam", "pills", "casino", "bets", "adult", "ads")
#: Keys of a shard, and its bits a key at even and odd levels.
SHARD_KEYS, BITS, HASHES = 100_000, (10, 3), (6, 2)
#: Pages that a part of a shard should hold.
PART_PAGES = 1_000_000


def _positions(h1, h2, level: int, m: int, k: int):
    """Places in a level's m bits of keys with the 64-bit hashes h1, h2 (numpy uint64 arrays); k rows."""
    import numpy as np

    with np.errstate(over="ignore"):
        a = (h1 ^ np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * level + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (h2 + np.uint64(0x94D049BB133111EB) * np.uint64(level + 1)) | np.uint64(1)
        return [((a + np.uint64(i) * b) >> np.uint64(11)) % np.uint64(m) for i in range(k)]


def build_levels(listed, rest) -> list[tuple[int, bytes]]:
    """(bits, bitmap) of each level, from arrays of (h1, h2) of listed and of other keys."""
    import numpy as np

    levels: list[tuple[int, bytes]] = []
    inside, outside = listed, rest
    while len(inside[0]):
        at = len(levels)
        m = max(64, len(inside[0]) * BITS[at % 2])
        bits = np.zeros(m, bool)
        for p in _positions(*inside, at, m, HASHES[at % 2]):
            bits[p] = True
        levels.append((m, np.packbits(bits).tobytes()))
        wrong = np.logical_and.reduce([bits[p] for p in _positions(*outside, at, m, HASHES[at % 2])]) if len(outside[0]) else np.zeros(0, bool)
        inside, outside = tuple(x[wrong] for x in outside), inside
    return levels


def holds(levels: list[tuple[int, bytes]], h1, h2):
    """Whether each key is listed; exact for the universe."""
    import numpy as np

    verdict = np.zeros(len(h1), bool)
    live = np.arange(len(h1))
    for at, (m, bitmap) in enumerate(levels):
        octets = np.frombuffer(bitmap, np.uint8)
        hit = np.ones(len(live), bool)
        for p in _positions(h1[live], h2[live], at, m, HASHES[at % 2]):  # single bits; the bitmap stays packed
            hit &= (octets[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1 == 1
        verdict[live[~hit]] = bool(at % 2)
        live = live[hit]
    verdict[live] = bool(len(levels) % 2)
    return verdict


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones are longer and win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def listed_host(host: Column, words=LISTED_WORDS) -> Column:
    return host.rlike(rf"(^|[.\-])({'|'.join(words)})([.\-]|$)")


def build_cascades(hosts: DataFrame, listed: DataFrame, shards: int) -> DataFrame:
    """hosts, listed: column host. A row for each shard and level: shard, level, bits, bitmap. A shard has about SHARD_KEYS hosts."""

    def build(keys):
        import numpy as np
        import pandas as pd

        pair = lambda x: (x.h1.to_numpy().view(np.uint64), x.h2.to_numpy().view(np.uint64))
        levels = build_levels(pair(keys[keys.listed]), pair(keys[~keys.listed]))
        return pd.DataFrame([(int(keys.shard.iloc[0]), i, m, b) for i, (m, b) in enumerate(levels)], columns=["shard", "level", "bits", "bitmap"])

    marked = hosts.select("host").distinct().join(listed.select("host", F.lit(True).alias("listed")).distinct(), "host", "left")
    keys = marked.select(_shard("host", shards).alias("shard"), F.xxhash64("host").alias("h1"), F.xxhash64(F.lit("second half"), "host").alias("h2"), F.coalesce("listed", F.lit(False)).alias("listed"))
    return keys.groupBy("shard").applyInPandas(build, "shard int, level int, bits long, bitmap binary")


def _shard(host: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), host), F.lit(shards)).cast("int")


def hosts_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The distinct hosts of the pages, column host."""
    return pages.select(host_of(F.col(url_col)).alias("host")).distinct()


def _by_broadcast(rows: DataFrame, cascades: DataFrame, schema: str) -> DataFrame:
    """rows (_id, host, path, shard, h1, h2) with `listed` in place of the last three; all cascades go to every executor."""
    known: dict[int, list] = {}
    for r in cascades.orderBy("shard", "level").collect():
        known.setdefault(r.shard, []).append((r.bits, bytes(r.bitmap)))
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            shard = batch.column(3).to_numpy()
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in (4, 5))
            out = np.zeros(len(shard), bool)
            for s in np.unique(shard):
                m = shard == s
                out[m] = holds(sent.value.get(int(s), []), h1[m], h2[m])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], ["_id", "host", "path", "listed"])

    return rows.mapInArrow(ask, schema)


def _by_shard(rows: DataFrame, cascades: DataFrame, schema: str, part_pages: int) -> DataFrame:
    """The same for cascades of any size: rows and cascades meet by shard and part, the cascade's levels first."""
    parts = rows.groupBy("shard").agg(F.ceil(F.count("*") / part_pages).alias("parts"))
    of = F.pmod(F.xxhash64("_id", "host", "path"), F.col("parts"))
    none = lambda t: F.lit(None).cast(t)
    pages = rows.join(parts, "shard").select("shard", of.alias("part"), F.lit(1 << 30).alias("level"), none("long").alias("bits"), none("binary").alias("bitmap"), "_id", "host", "path", "h1", "h2")
    id_type = rows.schema["_id"].dataType.simpleString()
    levels = cascades.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    levels = levels.select("shard", "part", "level", "bits", "bitmap", none(id_type).alias("_id"), none("string").alias("host"), none("string").alias("path"), none("long").alias("h1"), none("long").alias("h2"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, known = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
            level = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at != tuple(keys[:, a]):
                    at, known = tuple(keys[:, a]), []
                first = a + int((level[a:b] < 1 << 30).sum())
                known += [(batch.column(3)[i].as_py(), batch.column(4)[i].as_py()) for i in range(a, first)]
                mine = batch.slice(first, b - first)
                if mine.num_rows:
                    h1, h2 = (mine.column(c).to_numpy().view(np.uint64) for c in (8, 9))
                    yield pa.RecordBatch.from_arrays([*mine.columns[5:8], pa.array(holds(known, h1, h2))], ["_id", "host", "path", "listed"])

    both = pages.unionByName(levels).repartition("shard", "part").sortWithinPartitions("shard", "part", "level")
    return both.mapInArrow(ask, schema)


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, pass_bytes: int = 32 << 20, part_pages: int = PART_PAGES) -> DataFrame:
    """id_col, host, path, rule, verdict ("allow" or "block"), listed of every page.

    listed: the hosts to block, column host, A-Z in lower case; null and repeated ones, and those of no page, don't
    matter. The longest rule that fits decides; else a listed host is blocked, itself alone and not its subdomains. A
    null url, or one without "://", has an empty host and path; a url of any length is judged whole. Repeated rows and
    null ids are judged each on their own, an empty table gives none, and other columns don't matter. The cascades are
    built when the function is called; the pages are then read once, whatever the list's size.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    with scratch(pages.sparkSession) as keep:
        hosts = stored(hosts_of(pages, url_col), "hosts")
        shards = max(1, math.ceil(hosts.count() / SHARD_KEYS))
        cascades = keep(stored(build_cascades(hosts, listed, shards), "cascades"))
    size = cascades.agg(F.coalesce(F.sum(F.length("bitmap")), F.lit(0)).alias("n")).first().n
    hashed = rows.select("_id", "host", "path", _shard("host", shards).alias("shard"), F.xxhash64("host").alias("h1"), F.xxhash64(F.lit("second half"), "host").alias("h2"))
    schema = f"_id {id_type}, host string, path string, listed boolean"
    judged = _by_broadcast(hashed, cascades, schema) if size <= pass_bytes else _by_shard(hashed, cascades, schema, part_pages)
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
