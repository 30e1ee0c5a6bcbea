"""Joins by time and by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import plain_text, tokens


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, within_s: int, left_id: str, right_id: str) -> DataFrame:
    """Each left row with the right row of the same keys that is nearest in time, at most within_s seconds away; ties to the earlier one, then the smaller id.

    Times are cut into slots of within_s seconds; a left row asks its own slot and the two beside it, so the join is by
    equality and a key's rows spread over its slots.
    """
    slot = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / within_s)
    asks = left.withColumn("_slot", F.explode(F.array(*[slot(left_at) + d for d in (-1, 0, 1)])))
    there = right.withColumn("_slot", slot(right_at))
    gap = F.abs(F.unix_micros(F.col(left_at).cast("timestamp")) - F.unix_micros(F.col(right_at).cast("timestamp")))
    pairs = asks.join(there, [*keys, "_slot"]).withColumn("gap_us", gap).filter(F.col("gap_us") <= within_s * 1_000_000)
    own = [c for c in right.columns if c not in keys]
    best = pairs.groupBy(left_id).agg(F.min(F.struct("gap_us", right_at, right_id)).alias("_b"))
    return best.join(left, left_id).select(*left.columns, F.col(f"_b.{right_id}").alias(right_id), F.col("_b.gap_us").alias("gap_us")) if own else best


def token_candidates(left: DataFrame, right: DataFrame, left_text: str, right_text: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, shared, similarity): pairs that share a word, with the Jaccard similarity of their word sets.

    Equal word sets are compared once. The right sets of a word that more than 1000 hold are cut into parts, and each left
    one asks every part; a pair comes from its first shared word only.
    """
    a = left.select(left_id, F.array_sort(tokens(F.col(left_text))).alias("_a"))
    b = right.select(right_id, F.array_sort(tokens(F.col(right_text))).alias("_b"))
    asks, there = a.select("_a").distinct().withColumn("_w", F.explode("_a")), b.select("_b").distinct().withColumn("_w", F.explode("_b"))
    hot = there.groupBy("_w").agg(F.ceil(F.count("*") / 1000).alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    asks = asks.join(hot, "_w", "left").select("_w", "_a", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    there = there.join(hot, "_w", "left").select("_w", "_b", F.pmod(F.xxhash64("_b"), parts).alias("_part"))
    both = F.array_intersect("_a", "_b")
    shared = F.size(both)
    pairs = asks.join(there, ["_w", "_part"]).filter(F.col("_w") == F.array_min(both))
    pairs = pairs.select("_a", "_b", shared.alias("shared"), F.round(shared / F.size(F.array_union("_a", "_b")), 6).alias("similarity"))
    return pairs.join(a, "_a").join(b, "_b").select(left_id, right_id, "shared", "similarity")


def best_match(pairs: DataFrame, left_id: str, right_id: str, least: float) -> DataFrame:
    """The most similar right row of each left row, ties to the smaller id."""
    return pairs.filter(F.col("similarity") >= least).groupBy(left_id).agg(F.max(F.struct(F.col("similarity"), (-F.col(right_id)).alias("_r"))).alias("_b")).select(left_id, (-F.col("_b._r")).alias(right_id), F.col("_b.similarity").alias("similarity"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        import pandas as pd

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def name_score(query: Column, name: Column) -> Column:
    """How well a registered name fits a query: whole words only.

    A one-word name fits only the same one-word query. Of longer ones two words must be shared; then a name that stands in
    the query as a phrase, or the other way round, scores 1, all others by their sequence ratio.
    """
    q, n = plain_text(query), plain_text(name)
    a, b = tokens(query), tokens(name)
    inside = lambda x, y: F.contains(F.concat(F.lit(" "), y, F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))
    phrase = inside(n, q) | ((F.size(a) >= 2) & inside(q, n))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, 0.0).when(F.size(b) < 2, F.when(F.array_sort(a) == F.array_sort(b), 1.0).otherwise(0.0)).when(F.size(F.array_intersect(a, b)) < 2, 0.0).when(phrase, 1.0).otherwise(sequence_ratio(q, n))


def tiered_lookup(names: DataFrame, aliases: DataFrame, name: str, alias: str, target: str) -> DataFrame:
    """names with `target` and `tier` (1 exact, 2 every word of the alias is in the name, longest alias first; null: none). aliases is a small dimension."""
    n = names.select(F.monotonically_increasing_id().alias("_row"), "*", plain_text(F.col(name)).alias("_n"))
    al = aliases.select(plain_text(F.col(alias)).alias("_al"), target).filter("_al != ''").withColumn("_words", F.split("_al", " "))
    first = al.withColumn("_first", F.explode("_words"))
    hits = n.select("_row", "_n", F.explode(F.array_distinct(F.split("_n", " "))).alias("_first")).join(first, "_first").filter(F.size(F.array_except("_words", F.split("_n", " "))) == 0)
    tier = F.when(F.col("_n") == F.col("_al"), 1).otherwise(2)
    best = hits.groupBy("_row").agg(F.min(F.struct(tier.alias("tier"), (-F.length("_al")).alias("_l"), F.col(target).alias("target"))).alias("_b"))
    return n.join(best, "_row", "left").select(*names.columns, F.col("_b.target").alias(target), F.col("_b.tier").alias("tier"))


#: Names that hold a gram are cut into parts of so many; each query asks every part.
GRAM_PART = 1000


def _grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is one itself."""
    return F.when(F.length(c) < n, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))))


def _rarest(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Each query's gram that the fewest names hold; none if a gram is in no name. parts: _q, _gram."""
    found = parts.join(counts, "_gram", "left").groupBy("_q").agg(F.min(F.struct("_held", "_gram")).alias("_least"), F.count_if(F.col("_held").isNull()).alias("_absent"))
    return found.filter("_absent = 0").select("_q", F.col("_least._gram").alias("_gram"), F.col("_least._held").alias("_held"))


def find_names(queries: DataFrame, query: str, names: DataFrame, name: str, target: str, place: str) -> DataFrame:
    """queries with `target` and `tier` of the first name (by place, then target) that fits; both null if none does.

    Plain texts are compared: 1, the name equals the query; 2, the name holds the query as a substring; 3, it holds every
    query word of three characters or more. Substrings are found by an index of three-character grams: a query asks with
    its rarest one only, so the join is by equality and a check. Queries shorter than a gram ask an index of grams of
    their length. Names of a hot gram are cut into parts of GRAM_PART; what a part finds is reduced before it travels.
    """
    known = names.select(plain_text(F.col(name)).alias("_n"), F.struct(F.col(place).alias("place"), F.col(target).alias("target")).alias("_own")).filter("_n IS NOT NULL").groupBy("_n").agg(F.min("_own").alias("_own"))
    asked = queries.select(plain_text(F.col(query)).alias("_q")).filter("_q != ''").distinct()
    words = F.filter(F.array_distinct(F.split("_q", " ")), lambda w: F.length(w) >= 3)
    longest = F.least(F.length("_q"), F.lit(3))

    exact = asked.join(known.withColumnRenamed("_n", "_q"), "_q").select("_q", F.lit(1).alias("tier"), "_own")
    index = known.select("_n", "_own", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("_n"), n) for n in (1, 2, 3)])))).alias("_gram"))
    # the index is cut to the grams that are asked for
    whole = asked.select("_q", F.explode(F.when(longest < 3, F.array("_q")).otherwise(_grams(F.col("_q")))).alias("_gram"))
    parts = asked.select("_q", F.explode(words).alias("_w")).select("_q", F.explode(_grams(F.col("_w"))).alias("_gram")).distinct()
    counts = index.join(whole.select("_gram").unionByName(parts.select("_gram")).distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_held"))

    def holding(own: DataFrame, test: Column, tier: int) -> DataFrame:
        n_parts = F.ceil(F.col("_held") / GRAM_PART)
        there = index.join(own.select("_gram", "_held").distinct(), "_gram").withColumn("_part", F.pmod(F.xxhash64("_n"), n_parts)).drop("_held")
        asks = own.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1))).drop("_held")
        return asks.join(there, ["_gram", "_part"]).filter(test).groupBy("_q").agg(F.min("_own").alias("_own")).select("_q", F.lit(tier).alias("tier"), "_own")

    second = holding(_rarest(whole, counts), F.contains("_n", "_q"), 2)
    third = holding(_rarest(parts, counts), F.forall(words, lambda w: F.contains(F.col("_n"), w)), 3)
    best = exact.unionByName(second).unionByName(third).groupBy("_q").agg(F.min(F.struct("tier", "_own")).alias("_b"))
    out = queries.withColumn("_q", plain_text(F.col(query))).join(best, "_q", "left")
    return out.select(*queries.columns, F.col("_b._own.target").alias(target), F.col("_b.tier").alias("tier"))
