"""Scores, keys and ladders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of evidence, role, source, laboratory need and risk.
GRADE = {"high": 1.0, "moderate": 0.82, "low": 0.72, "very_low": 0.62, "expert_opinion": 0.58}
STRENGTH = {"high": 1.0, "strong": 1.0, "strong_with_lab": 0.96, "moderate": 0.82, "low_moderate": 0.72, "contextual": 0.66}
ROLE = {"primary": 1.0, "primary_with_lab": 0.96, "supportive": 0.74, "supportive_with_lab": 0.68, "safety_context": 0.22}
SOURCE = {"official_fact_sheet": 1.0, "official_consumer_fact_sheet": 0.92, "official_health_resource": 0.90, "medical_reference": 0.86, "internal_rules": 0.70}
LAB = {"no": 1.0, "optional": 0.95, "preferred": 0.90, "required": 0.72}
RISK = {"low": 0.0, "low_moderate": 0.03, "moderate": 0.07, "moderate_high": 0.14, "high": 0.25}
#: What a perceived benefit adds to a reward.
BENEFIT = {"claro": 0.10, "leve": 0.05}
#: Weights of a product's commercial score without and with a budget.
COMMERCIAL = {"match": 0.26, "unit": 0.14, "price_stock": 0.16, "review": 0.20, "quality": 0.12, "shop": 0.06, "fresh": 0.04, "exposure": 0.03, "verified": 0.03}
COMMERCIAL_BUDGET = {"match": 0.24, "unit": 0.13, "price_stock": 0.24, "review": 0.14, "quality": 0.11, "shop": 0.05, "fresh": 0.04, "exposure": 0.03, "verified": 0.02}


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def weight(c: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in weights.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def reward(rating: Column, purchased: Column, still: Column, benefit: Column) -> Column:
    """Rating, held to 1 to 5, with outcomes; a rating alone counts whole, no rating counts as none of it."""
    base = F.coalesce((clip(rating.cast("double"), 1.0, 5.0) - 1) / F.lit(4.0), F.lit(0.0))
    alone = purchased.isNull() & still.isNull() & benefit.isNull()
    full = 0.40 * base + F.when(purchased, 0.20).otherwise(0.0) + F.when(still, 0.30).otherwise(0.0) + weight(F.lower(F.trim(benefit)), BENEFIT, 0.0)
    return clip(F.when(alone, base).otherwise(full), 0.0, 1.0)


def bayesian_mean(n: Column, mean: Column, prior: float = 0.70, m: float = 8) -> Column:
    """The mean, held to 0 to 1, drawn toward the prior; the prior itself without votes."""
    return F.when((n <= 0) | n.isNull() | mean.isNull(), F.lit(prior)).otherwise((n * clip(mean, 0.0, 1.0) + m * prior) / (n + m))


def exploration(n: Column, total: Column, c: float = 0.01) -> Column:
    return c * F.sqrt(F.log(total + 1) / (n + 1))


def chosen_signal(context_n: Column, context_mean: Column, global_n: Column, global_mean: Column, least_context: int = 5, least_global: int = 10, prior: float = 0.70, m: float = 8) -> Column:
    """struct(level, value, used): the context's votes if they are enough, else the global ones, else the prior and no votes."""
    cn, gn = F.coalesce(context_n, F.lit(0)), F.coalesce(global_n, F.lit(0))
    out = lambda level, value, used: F.struct(F.lit(level).alias("level"), value.alias("value"), used.cast("long").alias("used"))
    return (
        F.when((cn >= least_context) & context_mean.isNotNull(), out("context", bayesian_mean(cn, context_mean, prior, m), cn))
        .when((gn >= least_global) & global_mean.isNotNull(), out("global", bayesian_mean(gn, global_mean, prior, m), gn))
        .when((gn > 0) | (cn > 0), out("insufficient", F.lit(prior), F.lit(0)))
        .otherwise(out("none", F.lit(prior), F.lit(0)))
    )


def evidence_score(grade: Column, role: Column, source: Column, lab: Column, risk: Column, penalty: Column, strength: Column | None = None) -> Column:
    """strength: an older mark, read where the grade is unknown."""
    known = weight(grade, GRADE, -1.0)
    fallback = F.lit(0.55) if strength is None else weight(strength, STRENGTH, 0.55)
    parts = 0.36 * F.when(known >= 0, known).otherwise(fallback) + 0.22 * weight(role, ROLE, 0.70) + 0.18 * weight(source, SOURCE, 0.70) + 0.14 * weight(lab, LAB, 0.90) + 0.10 * (1 - weight(risk, RISK, 0.08))
    return F.greatest(F.lit(0.05), parts - penalty)


def commercial_score(terms: dict[str, Column], has_budget: Column, added: Column, taken: Column) -> Column:
    """A product's score: the terms named in COMMERCIAL by their weights, plus boosts, less penalties, held to 0 to 1."""
    of = lambda weights: sum((F.lit(v) * terms[k] for k, v in weights.items()), F.lit(0.0))
    return clip(F.when(has_budget, of(COMMERCIAL_BUDGET)).otherwise(of(COMMERCIAL)) + added - taken, 0.0, 1.0)


def exposure(share: Column, slope: float = 3.0, least: float = 0.25, most: float = 0.75) -> Column:
    return F.greatest(F.lit(least), 1 - F.least(F.lit(most), slope * share))


def price_score(p: Column, low: Column, high: Column) -> Column:
    """Of a price against a budget from low to high, either of which may be null; the numbers are fixed values."""
    return (
        F.when(p.isNull() | (p <= 0), 0.65)
        .when(high.isNotNull() & (p > high), F.greatest(F.lit(0.05), 0.4 * (1 - F.least(F.lit(1.0), (p - high) / F.greatest(high, F.lit(1.0))))))
        .when(low.isNotNull() & high.isNotNull(), clip(1 - 0.30 * ((p - low) / F.greatest(high - low, F.lit(1.0))), 0.0, 1.0))
        .when(high.isNotNull(), clip(1 - 0.30 * p / high, 0.30, 1.0))
        .otherwise(clip(1 / (1 + p / 100), 0.05, 1.0))
    )


def stock_score(n: Column, availability: Column) -> Column:
    """Only what says `available` counts by its stock; an unknown stock is .75."""
    there = F.contains(F.lower(F.coalesce(availability, F.lit(""))), F.lit("available"))
    return F.when(~there, 0.25).when(n.isNull(), 0.75).when(n <= 0, 0.40).when(n < 5, 0.75).otherwise(1.0)


def traceability_score(registry: Column, status: Column) -> Column:
    """By whether a registry number is there and what the regulatory status says."""
    has, says = F.length(F.trim(F.coalesce(registry, F.lit("")))) > 0, F.lower(F.coalesce(status, F.lit("")))
    match = F.contains(says, F.lit("match"))
    return F.when(has & (F.contains(says, F.lit("digemid")) | match), 1.0).when(has, 0.85).when(F.contains(says, F.lit("trace")) | match, 0.70).otherwise(0.45)


def shop_score(times: Column) -> Column:
    """Less for a shop that was used before."""
    return F.greatest(F.lit(0.35), 1 - 0.20 * times)


def confidence_of(trace: Column, has_price: Column, is_available: Column, label: Column) -> Column:
    """Trust in a product without a stated one; label: 1 for a verified label, .35 for an inferred one, else 0."""
    return clip(0.50 * trace + F.when(has_price, 0.20).otherwise(0.0) + F.when(is_available, 0.15).otherwise(0.0) + 0.15 * label, 0.0, 1.0)


def quality_score(trace: Column, registered: Column, has_amount: Column, has_price: Column, has_stock: Column, verified_label: Column, unit: Column, confidence: Column) -> Column:
    """Of a catalog entry, from what it states."""
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    stated = add(registered, 0.20) + add(has_amount, 0.12) + add(has_price, 0.12) + add(has_stock, 0.08) + add(verified_label, 0.08) + add(unit >= 0.95, 0.05)
    return clip(0.35 * trace + stated + F.when(confidence >= 0.85, 0.06).when(confidence >= 0.68, 0.03).otherwise(0.0), 0.0, 1.0)


def unit_score(n: Column) -> Column:
    return F.when(n <= 1, 1.0).when(n == 2, 0.78).when(n <= 4, 0.62).otherwise(0.45)


def freshness(days: Column) -> Column:
    return F.when(days.isNull(), 0.70).when(days <= 7, 1.0).when(days <= 30, 0.85).when(days <= 90, 0.65).otherwise(0.45)


def egfr(creatinine: Column, age: Column, female: Column) -> Column:
    """Kidney filtration by the 2021 CKD-EPI formula."""
    k, a = F.when(female, 0.7).otherwise(0.9), F.when(female, -0.241).otherwise(-0.302)
    r = creatinine / k
    return 142 * F.pow(F.least(r, F.lit(1.0)), a) * F.pow(F.greatest(r, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid, half, below = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    none = F.lit(None).cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / below)).otherwise(none), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / below)).otherwise(none)


def pack_key(ids: Column) -> Column:
    return F.concat(F.lit("pack_"), F.substring(F.md5(F.array_join(F.array_sort(ids), "|").cast("binary")), 1, 10))


def context_key(conditions: Column, healthy: str = "healthy", most: int = 3) -> Column:
    """The first distinct conditions in their order, without blank and healthy ones (in any case), sorted and joined by `+`."""
    own = F.filter(F.transform(F.coalesce(conditions, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != "") & (F.upper(c) != healthy.upper()))
    return F.array_join(F.array_sort(F.slice(F.array_distinct(own), 1, most)), "+")


def hash_split(c: Column, percent: int = 50) -> Column:
    """calibration or evaluation, by the first eight digits of the sha-256."""
    return F.when(F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 100 < percent, "calibration").otherwise("evaluation")


def hash_sample(c: Column, ratio: float) -> Column:
    """Whether the first eight bytes of the sha-256, as a share of 2^64, are below the ratio."""
    head = F.conv(F.substring(F.sha2(c.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return head / F.lit(float(1 << 64)) < ratio


def coverage(covered: Column, useful: Column) -> Column:
    return F.when(F.size(useful) > 0, F.size(F.array_intersect(covered, useful)) / F.size(F.array_distinct(useful))).otherwise(0.0)


def status_ladder(value: Column, critical_low: Column, critical_high: Column, low: Column, high: Column, borderline: Column, own_low: Column | None = None, own_high: Column | None = None) -> Column:
    """Status of a laboratory value; borders are normal, and null borders don't count.

    own_low, own_high: the report's own range, which wins over the definition's. Between low and borderline a value is
    borderline, unless the report has a low border of its own.
    """
    of_low = low if own_low is None else F.coalesce(own_low, low)
    of_high = high if own_high is None else F.coalesce(own_high, high)
    near = (value < borderline) & of_low.isNotNull()
    if own_low is not None:
        near = near & own_low.isNull()
    return (
        F.when(value.isNull(), "missing")
        .when(value < critical_low, "critical_low")
        .when(value > critical_high, "critical_high")
        .when(value < of_low, "low")
        .when(value > of_high, "high")
        .when(near, "borderline")
        .otherwise("normal")
    )


def severity(status: Column) -> Column:
    return F.when(status.startswith("critical"), "critical").when(status.isin("low", "high"), "warning").when(status == "borderline", "info").otherwise("normal")


def coverage_status(n: Column, target: int = 3) -> Column:
    return F.when(n >= target, "ready").when(n >= max(1, target - 1), "minimum").when(n > 0, "weak").otherwise("missing")


def executive_status(share: Column, recall: Column, specificity: Column) -> Column:
    return F.when(share < 0.10, "not_evaluable").when((recall >= 0.80) & (specificity >= 0.90), "ready").otherwise("needs_work")


#: Weights of a product's commercial terms, with a budget and without.
BREAKDOWN = {"component_match": (0.24, 0.26), "unit_product_preference": (0.13, 0.14), "price_stock": (0.24, 0.16), "product_reviews": (0.14, 0.20), "catalog_quality": (0.11, 0.12), "pharmacy_diversity": (0.05, 0.06), "freshness": (0.04, 0.04), "exposure": (0.03, 0.03), "verified_reviews": (0.02, 0.03)}


def score_breakdown(terms: dict[str, Column], has_budget: Column, restriction_penalty: Column, safety_penalty: Column) -> Column:
    """Each term's part in a product's score, four decimals, and the penalties below zero; terms by the names of BREAKDOWN, the share of verified reviews 1 at most."""
    parts = [F.round(F.when(has_budget, a).otherwise(b) * (F.least(terms[k], F.lit(1.0)) if k == "verified_reviews" else terms[k]), 4).alias(k) for k, (a, b) in BREAKDOWN.items()]
    return F.struct(*parts, F.round(-restriction_penalty, 4).alias("restriction_penalty"), F.round(-safety_penalty, 4).alias("ingredient_safety_penalty"))


def selection_reasons(m: dict[str, Column], restriction_warnings: Column, preferred: Column, unit: Column, several: Column) -> Column:
    """The first four reasons why a product was chosen, as codes: two restriction warnings at most come first. m: the metrics by name."""
    tests = {
        "preferred": preferred,
        "good_match": m["match"] >= 0.85,
        "unit_component": unit,
        "several_components": ~unit & several,
        "best_price": m["price"] >= 0.70,
        "best_rated": (m["review"] >= 0.75) & (F.coalesce(m["review_count"], F.lit(0)) > 0),
        "traceable": m["traceability"] >= 0.85,
        "reliable": F.coalesce(m["confidence"], F.lit(0.0)) >= 0.85,
        "other_shop": m["shop_diversity"] >= 0.90,
        "shown_often": (m["product_exposure"] < 0.85) | (m["shop_exposure"] < 0.85),
    }
    found = F.concat(F.slice(F.coalesce(restriction_warnings, F.array().cast("array<string>")), 1, 2), F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()])))
    return F.when(F.size(found) > 0, F.slice(found, 1, 4)).otherwise(F.array(F.lit("available")))


def age_hours(at: Column, now: Column) -> Column:
    """Hours from a time in ISO form (`Z`, an offset, or none for the session's zone) to now, two decimals; null for other texts."""
    return F.round((F.unix_micros(now) - F.unix_micros(F.trim(at).try_cast("timestamp"))) / 3_600_000_000, 2)
