"""Weighted rules over entities: predicates, evidence families, proxies, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("eq", "in", "contains", "gte", "lte", "lt")


def unpivot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value): one row per entity and field; a null field has no row."""
    return df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], fields, "field", "value").filter("value IS NOT NULL")


def holds(op: Column, have: Column, want: Column) -> Column:
    """Whether a rule's predicate holds. Negative numbers stand for absence and match no comparison; an unknown operator fails the job."""
    x, y = have.try_cast("double"), want.try_cast("double")
    there = x.isNotNull() & (x >= 0)
    unknown = F.raise_error(F.concat(F.lit("unknown operator "), op)).cast("boolean")
    return F.coalesce(
        F.when(op == "eq", have == want)
        .when(op == "in", F.array_contains(F.split(want, "\\|"), have))
        .when(op == "contains", F.contains(have, want))
        .when(op == "gte", there & (x >= y))
        .when(op == "lte", there & (x <= y))
        .when(op == "lt", there & (x < y))
        .otherwise(unknown),
        F.lit(False),
    )


def fired(entities: DataFrame, key: str, fields: list[str], rules: DataFrame) -> DataFrame:
    """(key, cond, field, op, weight) of every rule that holds. rules: cond, field, op, value, weight; a small dimension."""
    r = rules.withColumnRenamed("value", "want")
    return unpivot(entities, key, fields).join(r, "field").filter(holds(F.col("op"), F.col("value"), F.col("want"))).select(key, "cond", "field", "op", "weight")


def family_scores(hits: DataFrame, key: str, families: DataFrame, proxies: DataFrame) -> DataFrame:
    """(key, cond, score, n_families, corroborated, raw_score, proxies): one score by family of evidence.

    Weights add up within a field. A family counts with its strongest field; a field without a family is its own. Then
    proxies, by falling weight (ties: by name), count only if none of their components is claimed by a family or by a
    proxy before them. families: field, family, is_lab; proxies: field, components (array); both small dimensions. A case
    is corroborated by a family of laboratory values or by two of any kind. One shuffle: all steps are by key and cond.
    """
    per_field = hits.repartition(key, "cond").groupBy(key, "cond", "field").agg(F.sum("weight").alias("w"))
    known = per_field.join(families.select("field", "family", "is_lab"), "field", "left").join(proxies.select("field", "components"), "field", "left")
    is_proxy = F.col("components").isNotNull()
    unit = F.when(is_proxy, F.concat(F.lit("proxy:"), "field")).otherwise(F.coalesce("family", "field"))
    per_family = known.groupBy(key, "cond", unit.alias("family")).agg(F.max("w").alias("w"), F.bool_or(F.coalesce("is_lab", F.lit(False)) & ~is_proxy).alias("lab"), F.first("components", ignorenulls=True).alias("components"))
    raw = F.col("components").isNull()
    both = per_family.groupBy(key, "cond").agg(
        F.coalesce(F.sum(F.when(raw, F.col("w"))), F.lit(0.0)).alias("raw_score"),
        F.count_if(raw).alias("n"),
        F.bool_or("lab").alias("any_lab"),
        F.collect_set(F.when(raw, F.col("family"))).alias("claimed"),
        F.array_sort(F.collect_list(F.when(~raw, F.struct((-F.col("w")).alias("order"), "family", "components")))).alias("all"),
    )
    start = F.struct(F.lit(0.0).alias("score"), F.col("claimed").alias("claimed"), F.array().cast("array<string>").alias("counted"))
    step = lambda s, x: F.when(F.arrays_overlap(s["claimed"], x["components"]), s).otherwise(
        F.struct((s["score"] - x["order"]).alias("score"), F.array_union(s["claimed"], x["components"]).alias("claimed"), F.array_append(s["counted"], x["family"]).alias("counted"))
    )
    out = both.withColumn("_p", F.aggregate("all", start, step))
    n = F.col("n") + F.size("_p.counted")
    return out.select(key, "cond", F.round(F.col("raw_score") + F.col("_p.score"), 4).alias("score"), n.alias("n_families"), (F.col("any_lab") | (n >= 2)).alias("corroborated"), F.round("raw_score", 4).alias("raw_score"), F.col("_p.counted").alias("proxies"))


def sum_scores(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy(key, "cond").agg(F.round(F.sum("weight"), 4).alias("score"), F.count("*").alias("n_rules"))


def thresholds(rules: DataFrame, families: DataFrame, proxies: DataFrame, base: DataFrame) -> DataFrame:
    """(cond, family_max, sum_max, threshold): a condition's rule threshold under scoring by family.

    rules: cond, field, op, weight; base: cond, threshold, set for plain sums. The most that answers alone, without
    laboratory fields, can reach: steps of a field (op gte) add up, other values of a field exclude each other. Where
    only double counting reached the base threshold, the two strongest families' sum takes its place, if that is less.
    """
    lab = families.filter("is_lab").select("field")
    own = rules.join(lab, "field", "left_anti")
    steps, single = F.sum(F.when(F.col("op") == "gte", F.col("weight"))), F.max(F.when(F.col("op") != "gte", F.col("weight")))
    most = own.groupBy("cond", "field").agg((F.coalesce(steps, F.lit(0.0)) + F.coalesce(single, F.lit(0.0))).alias("weight"))
    by_family = family_scores(most.withColumn("_key", F.lit(1)), "_key", families, proxies).select("cond", F.col("score").alias("family_max"))
    by_sum = most.groupBy("cond").agg(F.round(F.sum("weight"), 4).alias("sum_max"))
    raw = own.join(proxies.select("field"), "field", "left_anti").join(families.select("field", "family"), "field", "left")
    of_field = raw.groupBy("cond", F.coalesce("family", "field").alias("family"), "field").agg(F.when(F.bool_and(F.col("op") == "gte"), F.sum("weight")).otherwise(F.max("weight")).alias("w"))
    of_family = of_field.groupBy("cond", "family").agg(F.max("w").alias("w"))
    two = of_family.groupBy("cond").agg(F.slice(F.sort_array(F.collect_list("w"), asc=False), 1, 2).alias("w")).filter(F.size("w") == 2).select("cond", F.round(F.get("w", F.lit(0)) + F.get("w", F.lit(1)), 4).alias("two"))
    t = F.col("threshold")
    lowered = F.coalesce(F.least(t, F.col("two")), t)
    out = base.join(by_family, "cond", "left").join(by_sum, "cond", "left").join(two, "cond", "left")
    zero = F.lit(0.0)
    fmax, smax = F.coalesce("family_max", zero), F.coalesce("sum_max", zero)
    return out.select("cond", fmax.alias("family_max"), smax.alias("sum_max"), F.when((fmax >= t) | (smax < t), t).otherwise(lowered).alias("threshold"))


def lifted(probability: Column, rule_score: Column, rule_threshold: Column, threshold: Column, corroborated: Column, floor: float = 0.30) -> Column:
    """A probability below its threshold, lifted where corroborated rules reach theirs."""
    t = F.greatest(threshold, F.lit(floor))
    lift = F.least(F.lit(0.98), t + F.least(F.lit(0.12), F.greatest(F.lit(0.03), rule_score - t)))
    return F.when((rule_score >= rule_threshold) & (probability < t) & corroborated, lift).otherwise(probability)


def decision(probability: Column, rule_score: Column, rule_threshold: Column, threshold: Column, corroborated: Column, observed_lab: Column, taken: Column) -> Column:
    """probability, positive, suppressed_by and score_basis of a condition.

    It is positive if the lifted probability reaches the threshold (.30 at least), evidence corroborates it and no
    supplement that suppresses the condition is taken; a laboratory value overrules such a supplement. taken: the
    suppressing ones that are taken; the first by name is reported.
    """
    final = lifted(probability, rule_score, rule_threshold, threshold, corroborated)
    by = F.when(~observed_lab, F.array_min(taken))
    raised = (rule_score >= rule_threshold) & (probability < F.greatest(threshold, F.lit(0.30))) & corroborated
    positive = (final >= F.greatest(threshold, F.lit(0.30))) & corroborated & by.isNull()
    return F.struct(F.round(final, 4).alias("probability"), positive.alias("positive"), by.alias("suppressed_by"), F.when(raised, "model+rules").otherwise("model").alias("score_basis"))
