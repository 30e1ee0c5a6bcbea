"""Catalog upkeep: diffs, merges, upserts, reject reasons, fan-out, coverage, quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.text import tokens


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in the order given, joined by `;`."""
    return F.concat_ws(";", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str, least_change: float = 0.01) -> DataFrame:
    """(key, change, old_value, new_value, pct): new, removed, changed by at least the share, or same."""
    o, n = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    both = o.withColumn("_o", F.lit(True)).join(n.withColumn("_n", F.lit(True)), key, "full_outer")
    pct = F.when(F.col("old_value") != 0, (F.col("new_value") - F.col("old_value")) / F.col("old_value"))
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(F.abs(pct) >= least_change, "changed").otherwise("same")
    return both.select(key, change.alias("change"), "old_value", "new_value", F.round(pct, 4).alias("pct"))


def filled_merge(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both by key; a new value that isn't blank replaces the old one, nothing is deleted; status added, updated or unchanged."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_o"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_n"))
    fill = {c: F.coalesce(F.when(F.trim(F.col(f"_n_{c}").cast("string")) != "", F.col(f"_n_{c}")), F.col(f"_o_{c}")) for c in columns}
    changed = reduce(lambda a, b: a | b, [~fill[c].eqNullSafe(F.col(f"_o_{c}")) for c in columns])
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNotNull() & changed, "updated").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, *[fill[c].alias(c) for c in columns], status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, state: str, open_state: str = "pending") -> DataFrame:
    """New keys are inserted, open ones refreshed, decided ones skipped; the action tells which."""
    o, n = old.select(key, F.col(value).alias("_ov"), F.col(state).alias("_s")), new.select(key, F.col(value).alias("_nv"), F.lit(True).alias("_n"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_n").isNull(), "keep").when(F.col("_s") == open_state, "refresh").otherwise("skip")
    out = o.join(n, key, "full_outer").withColumn("action", action)
    return out.select(key, F.when(F.col("action").isin("insert", "refresh"), F.col("_nv")).otherwise(F.col("_ov")).alias(value), F.coalesce("_s", F.lit(open_state)).alias(state), "action")


def deactivate_missing(known: DataFrame, seen: DataFrame, key: str, group: str, state: str, active: str = "active") -> DataFrame:
    """Active rows that the new snapshot lacks, of groups that it has."""
    return known.filter(F.col(state) == active).join(seen.select(group).distinct(), group, "left_semi").join(seen.select(key), key, "left_anti")


def fan_out(df: DataFrame, key: str, name: str, most: int) -> DataFrame:
    """(key, n_names): keys with more distinct names than allowed."""
    return df.groupBy(key).agg(F.countDistinct(name).alias("n_names")).filter(F.col("n_names") > most)


def split_by_fan_out(df: DataFrame, key: str, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    bad = fan_out(df, key, name, most)
    return df.join(bad, key, "left_anti"), df.join(bad, key, "left_semi").dropDuplicates([key, name])


def price_changes(snapshots: DataFrame, keys: list[str], at: list[str], price: str, least: float = 0.01) -> DataFrame:
    """Snapshots whose price differs from the one before by at least the share, with `previous` and `pct`."""
    before = F.lag(price).over(Window.partitionBy(*keys).orderBy(*at))
    out = snapshots.withColumn("previous", before).withColumn("pct", (F.col(price) - F.col("previous")) / F.col("previous"))
    return out.filter((F.col("previous") != 0) & (F.abs("pct") >= least))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def gate(df: DataFrame, checks: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """(check, value, status): one pass over df; each check is an aggregate, and the values under which it warns and fails."""
    values = df.agg(*[c.cast("double").alias(n) for n, (c, _, _) in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), F.when(F.col(n) < fail, "error").when(F.col(n) < warn, "warning").otherwise("ok").alias("status")) for n, (_, warn, fail) in checks.items()])
    return values.select(F.explode(rows).alias("_r")).select("_r.*")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that break a reference."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


#: Statuses that a reviewer sets, and those that can't be promoted.
MANUAL_STATUSES = ("approved_verified", "approved_inferred", "manual_rejected", "rejected_no_rs", "rejected_non_oral")
UNPROMOTABLE = ("rejected_no_rs", "rejected_non_oral", "manual_rejected")
TRACED = "true_rs_component"


def candidate_states(candidates: DataFrame, manual: str = "manual_status") -> DataFrame:
    """candidates with catalog_status, promotable and notes.

    candidates: registro_sanitario, component_traceable, match_basis, availability, and the reviewer's status, which wins if
    it is one of MANUAL_STATUSES. Else a candidate without a registration needs one, a traced one is verified, one matched
    by name is to be explained, and the rest is inferred.
    """
    clean = lambda c: F.coalesce(F.trim(c), F.lit(""))
    number, traced, basis, shelf = (clean(F.col(c)) for c in ("registro_sanitario", "component_traceable", "match_basis", "availability"))
    own = F.when(number == "", "candidate_needs_rs").when(traced == TRACED, "approved_verified").when(F.contains(F.lower(basis), F.lit("name")), "candidate_name_match").otherwise("approved_inferred")
    status = F.when(clean(F.col(manual)).isin(*MANUAL_STATUSES), clean(F.col(manual))).otherwise(own)
    promotable = (number != "") & (traced == TRACED) & ~F.col("catalog_status").isin(*UNPROMOTABLE)
    notes = F.array(
        F.when(number != "", "has_registration").otherwise("registration_missing"),
        F.when(traced == TRACED, "component_traced").when(F.contains(traced, F.lit("no_rs")), "matched_without_registration"),
        F.when(F.col("catalog_status") == "candidate_name_match", "match_needs_explanation"),
        F.when((shelf != "") & (shelf != "available"), "availability_not_ideal"),
    )
    return candidates.withColumn("catalog_status", status).withColumn("promotable", promotable).withColumn("notes", F.array_compact(notes))


def cleaning_reasons(rows: DataFrame, registration: str, name: str, registered: str, category: Column, order: str, max_fanout: int) -> DataFrame:
    """rows with `reason` to leave the catalog: category, then a registration that stands for many, then a name that doesn't fit; null if none.

    category: names what isn't a supplement, null for others. A registration stands for many if more than max_fanout
    distinct names use it and its registered name (of its first row, by order) has fewer than two words. A name fits if it
    shares a word with the registered one. Names are counted by registration before they meet the rows.
    """
    key = F.coalesce(F.col(registration), F.lit(""))
    names = rows.groupBy(key.alias("_rs")).agg(F.countDistinct(F.lower(F.coalesce(name, F.lit("")))).alias("_n"), F.min_by(F.coalesce(registered, F.lit("")), order).alias("_first"))
    many = names.filter((F.col("_n") > max_fanout) & (F.size(tokens(F.col("_first"))) < 2))
    both = rows.withColumn("_rs", key).join(many, "_rs", "left")
    fits = F.arrays_overlap(tokens(F.coalesce(name, F.lit(""))), tokens(F.coalesce(registered, F.lit(""))))
    reason = F.when(category.isNotNull(), F.concat(F.lit("category:"), category)).when(F.col("_n").isNotNull(), F.concat(F.lit("fan_out:"), "_rs", F.lit(":"), F.trim("_first"), F.lit(":"), F.col("_n").cast("string"))).when(~fits, F.concat(F.lit("name:"), F.trim(F.coalesce(registered, F.lit("")))))
    return both.withColumn("reason", reason).select(*rows.columns, "reason")
