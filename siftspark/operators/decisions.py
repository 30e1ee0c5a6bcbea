"""Decisions on top of rule scores: signal groups, second opinions, current doses, the catalog gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import names_agree, plain_text

#: Groups of signals, the first one there is the primary one.
GROUP_ORDER = ("observed_lab", "medical_safety", "declared_diet", "self_reported_symptoms", "restrictions", "profile_context", "survey_context", "derived_soft_signal")


def signal_groups(hits: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """key, cond, group, weight, n, drivers, strength of each group of signals among a case's rules. groups: field, group; a field that it lacks is survey_context."""
    rows = hits.join(groups, "field", "left").withColumn("group", F.coalesce("group", F.lit("survey_context")))
    out = rows.groupBy(key, "cond", "group").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("n"), F.array_sort(F.collect_set("field")).alias("drivers"))
    middle = (F.col("weight") >= 0.30) | (F.col("n") >= 2)
    strength = F.when(F.col("group").isin("observed_lab", "medical_safety"), "alta").when(F.col("group").isin("declared_diet", "self_reported_symptoms") & middle, "media").otherwise("baja")
    return out.withColumn("strength", strength)


def primary_signals(groups: DataFrame, key: str, score: Column, safety: Column) -> DataFrame:
    """key, cond, primary_group, n_groups, evidence_level, signal_strength out of signal_groups. score, safety: aggregates over a case's groups."""
    order = F.array(*map(F.lit, GROUP_ORDER))
    place = F.nullif(F.array_position(order, F.col("group")), F.lit(0))
    out = groups.groupBy(key, "cond").agg(F.min_by("group", F.struct(F.coalesce(place, F.lit(99)), "group")).alias("primary_group"), F.collect_set("group").alias("_all"), score.alias("_score"), safety.alias("_safety"))
    p, n = F.col("primary_group"), F.size("_all")
    level = (
        F.when(F.col("_safety") & p.isin("medical_safety", "observed_lab"), "medical_safety").when(p.isin("observed_lab", "medical_safety", "declared_diet", "self_reported_symptoms", "restrictions"), p)
        .when(F.array_contains("_all", "declared_diet") & F.array_contains("_all", "self_reported_symptoms"), "diet_and_symptoms").otherwise("self_reported")
    )
    s = F.col("_score")
    strength = F.when(p.isin("observed_lab", "medical_safety"), "alta").when(p.isin("declared_diet", "self_reported_symptoms"), F.when((s >= 0.45) | (n >= 2), "media").otherwise("baja")).when(s >= 0.55, "media").otherwise("baja")
    return out.select(key, "cond", "primary_group", n.alias("n_groups"), level.alias("evidence_level"), strength.alias("signal_strength"))


def second_opinions(details: DataFrame, key: str, opinions: DataFrame, complementary: DataFrame, margin: float = 0.15) -> DataFrame:
    """details with positive, probability and reason as another model's positive estimates change them.

    details: key, cond, positive, suppressed, corroborated, rule_score, rule_threshold, probability, families (array).
    opinions: key, cond, estimate, of positive estimates only. complementary: cond, family that the other model doesn't see;
    a small dimension. A case that isn't positive becomes so if it is corroborated and its rules are less than the margin
    under their threshold (borderline), or if it has such a family (complementary_family).
    """
    seen = complementary.groupBy("cond").agg(F.collect_set("family").alias("_more"))
    rows = details.join(opinions, [key, "cond"], "left").join(seen, "cond", "left")
    open_ = F.col("estimate").isNotNull() & ~F.col("positive") & ~F.coalesce("suppressed", F.lit(False))
    near = F.coalesce("corroborated", F.lit(False)) & (F.col("rule_score") >= F.col("rule_threshold") - margin)
    reason = F.when(open_ & near, "borderline").when(open_ & F.coalesce(F.arrays_overlap("_more", "families"), F.lit(False)), "complementary_family")
    rows = rows.withColumn("reason", reason)
    raised = F.round(F.greatest("probability", "estimate"), 4)
    changed = {"positive": F.col("positive") | F.col("reason").isNotNull(), "probability": F.when(F.col("reason").isNotNull(), raised).otherwise(F.col("probability"))}
    return rows.withColumns(changed).select(*details.columns, "reason")


#: Current daily doses that count as low below the first and as high from the second number on.
DOSES = {"vitamina_d": (600.0, 4000.0), "calcio": (300.0, 1200.0), "magnesio": (100.0, 350.0), "zinc": (8.0, 40.0), "vitamina_c": (200.0, 1000.0), "hierro": (14.0, 45.0), "omega_3": (250.0, 2000.0), "proteina": (20.0, 120.0)}


def current_doses(items: DataFrame, key: str, name: str, taken: DataFrame, keywords: DataFrame) -> DataFrame:
    """items with supplement, dose_status (unknown, low, covered, high) and blocked: whether a person takes the item already.

    taken: key, place, supplement, amount, unit; keywords: supplement, keyword; a small dimension. The first taken
    supplement of which a keyword stands in the item's name counts. Vitamin D in micrograms counts forty units each.
    What a person takes is one row's array and meets the items by the key alone: items need no row ids, which would be
    others each time they are read.
    """
    words = keywords.groupBy("supplement").agg(F.collect_set(F.lower("keyword")).alias("_words"))
    of = taken.join(words, "supplement").groupBy(key).agg(F.collect_list(F.struct("place", "supplement", "amount", "unit", "_words")).alias("_taken"))
    named = F.filter("_taken", lambda t: F.exists(t["_words"], lambda w: F.contains(F.lower(F.col(name)), w)))
    first = F.array_min(F.transform(named, lambda t: F.struct(*[t[c].alias(c) for c in ("place", "supplement", "amount", "unit")])))
    rows = items.join(of, key, "left").withColumn("_t", first).withColumn("supplement", F.col("_t.supplement"))
    unit = F.lower(F.coalesce("_t.unit", F.lit("")))
    amount = F.when(F.col("_t.amount") > 0, F.col("_t.amount") * F.when((F.col("supplement") == "vitamina_d") & unit.rlike("mcg|µg"), 40.0).otherwise(1.0))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (a, b) in DOSES.items():
        low, high = F.when(F.col("supplement") == k, a).otherwise(low), F.when(F.col("supplement") == k, b).otherwise(high)
    status = F.when(F.col("supplement").isNotNull(), F.when(amount.isNull() | high.isNull(), "unknown").when(amount >= high, "high").when(amount < low, "low").otherwise("covered"))
    return rows.withColumn("dose_status", status).select(*items.columns, "supplement", "dose_status", F.coalesce(F.col("dose_status").isin("unknown", "covered", "high"), F.lit(False)).alias("blocked"))


def catalog_gate(raw: DataFrame, approved: DataFrame, now: Column, excluded: str, min_raw: int, min_approved: int, min_shops: int, required_shops: tuple[str, ...] = (), max_bad_prices: float = 0.01, max_age_hours: int = 48, max_fan_out: int = 5) -> DataFrame:
    """check, level (error or warning), value, failed of each check on a rebuilt catalog; it passes if no error failed.

    raw: shop, price, seen_at. approved: shop, sku, component, name, registry, registered_name, price, availability.
    excluded: a pattern of names that are no supplements. Each table is read once for its counts, and once for fan-out.
    """
    bad = F.avg(F.when(F.col("price").isNull() | (F.col("price") <= 0), 1.0).otherwise(0.0))
    of_raw = raw.agg(F.count("*").alias("raw_rows"), F.countDistinct("shop").alias("raw_shops"), F.round(F.coalesce(bad, F.lit(0.0)), 4).alias("raw_bad_prices"), F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.max("seen_at"))) / 3600).alias("raw_age_hours"))
    key = F.struct(*[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("shop", "sku", "component")])
    of_approved = approved.agg(
        F.count("*").alias("approved_rows"), F.countDistinct("shop").alias("approved_shops"), F.round(F.coalesce(bad, F.lit(0.0)), 4).alias("approved_bad_prices"), F.count_if(F.lower(F.trim(F.coalesce("availability", F.lit("")))) != "available").alias("approved_unavailable"),
        F.count_if(plain_text(F.col("name")).rlike(excluded)).alias("approved_non_supplements"), (F.count("*") - F.countDistinct(key)).alias("approved_duplicates"),
        F.count_if((F.coalesce(F.col("registered_name"), F.lit("")) != "") & ~names_agree(F.col("name"), F.col("registered_name"))).alias("approved_names_without_overlap"),
    )
    fan = approved.filter("registry != '' AND name != ''").groupBy("registry").agg(F.countDistinct(F.lower(F.trim("name"))).alias("n")).agg(F.count_if(F.col("n") > max_fan_out).alias("approved_fan_out"))
    shops = raw.select("shop").unionByName(approved.select("shop")).agg(*[F.coalesce(F.bool_or(F.col("shop") == s), F.lit(False)).alias(f"_s{i}") for i, s in enumerate(required_shops)], F.lit(True).alias("_any"))
    one = of_raw.crossJoin(of_approved).crossJoin(fan).crossJoin(shops)  # one row each
    missing = sum((F.when(~F.col(f"_s{i}"), 1).otherwise(0) for i in range(len(required_shops))), F.lit(0))
    col = F.col
    checks = [
        ("raw_rows", "error", col("raw_rows"), col("raw_rows") < min_raw), ("approved_rows", "error", col("approved_rows"), col("approved_rows") < min_approved), ("raw_shops", "error", col("raw_shops"), col("raw_shops") < min_shops), ("approved_shops", "error", col("approved_shops"), col("approved_shops") < min_shops),
        ("required_shops_missing", "error", missing, missing > 0), ("raw_bad_prices", "error", col("raw_bad_prices"), col("raw_bad_prices") > max_bad_prices), ("approved_bad_prices", "error", col("approved_bad_prices"), col("approved_bad_prices") > max_bad_prices),
        ("raw_age_hours", "error", col("raw_age_hours"), F.coalesce(col("raw_age_hours") > max_age_hours, F.lit(True))), ("approved_unavailable", "error", col("approved_unavailable"), col("approved_unavailable") > 0), ("approved_non_supplements", "error", col("approved_non_supplements"), col("approved_non_supplements") > 0),
        ("approved_fan_out", "error", col("approved_fan_out"), col("approved_fan_out") > 0), ("approved_duplicates", "warning", col("approved_duplicates"), col("approved_duplicates") > 0), ("approved_names_without_overlap", "warning", col("approved_names_without_overlap"), col("approved_names_without_overlap") > 0),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(lv).alias("level"), v.cast("double").alias("value"), f.alias("failed")) for n, lv, v, f in checks])).alias("_c")).select("_c.*")


#: Counters of a catalog's quality: name and condition over a product's columns.
QUALITY_COUNTERS = {
    "active_products": "status IN ('active', 'preferred')", "products_with_registro_sanitario": "registry != ''", "products_with_verified_restriction_flags": "verified_flags", "products_with_inferred_restriction_flags": "inferred_flags", "products_with_label_source": "label_source != ''",
    "products_with_recent_label_review": "label_at IS NOT NULL", "products_without_registro_sanitario": "coalesce(registry, '') = ''", "products_with_digemid_name_match": "registry_source = 'digemid_name_match'", "products_with_image_ocr_rs": "registry_source = 'image_ocr'",
    "products_with_low_commercial_confidence": "lower(confidence) = 'baja'", "products_with_medium_commercial_confidence": "lower(confidence) = 'media'", "products_with_high_commercial_confidence": "lower(confidence) = 'alta'",
}


def catalog_quality(products: DataFrame, missing: DataFrame, weak: DataFrame) -> DataFrame:
    """One row: the counters, traceability_rate, verified_label_rate and warnings of a catalog, in one pass over it.

    products: status, registry, registry_source, verified_flags, inferred_flags, label_source, label_at, confidence. missing,
    weak: components that have no product, or few; only whether there are any counts.
    """
    total = F.count("*")
    rate = lambda c: F.when(total > 0, F.round(F.count_if(F.expr(c)) / total, 4)).otherwise(0.0)
    one = products.agg(total.alias("products_total"), *[F.count_if(F.expr(c)).alias(n) for n, c in QUALITY_COUNTERS.items()], rate("registry != ''").alias("traceability_rate"), rate("label_source != ''").alias("verified_label_rate"))
    any_of = lambda df, name: df.limit(1).agg((F.count("*") > 0).alias(name))
    both = one.crossJoin(any_of(missing, "_missing")).crossJoin(any_of(weak, "_weak"))  # one row each
    checks = {
        "empty": F.col("products_total") == 0, "traceability_below_95": F.col("traceability_rate") < 0.95, "few_label_sources": F.col("verified_label_rate") < 0.50, "no_verified_flags": F.col("products_with_verified_restriction_flags") == 0, "components_without_product": F.col("_missing"),
        "components_of_low_rotation": F.col("_weak"),
    }
    return both.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).drop("_missing", "_weak")
