"""Analysis of a laboratory report: an ordered fold over its biomarkers, then a pattern across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels from harmless to grave.
LEVELS = ("normal", "caution", "medical_review_required")
#: A reading below this confidence is doubtful.
DOUBTFUL = 0.65
#: Biomarkers whose supplement always needs a professional.
ALWAYS_REVIEWED = ("ferritin", "calcium")
#: Of the anemia pattern, one of the first and one of the second are low.
IRON_STORES, BLOOD_COUNT = ("ferritin", "iron"), ("hemoglobin", "hematocrit")
LOW, SUPPLEMENTED = ("low", "critical_low"), ("low", "critical_low", "borderline")

ITEM = "struct<code:string,status:string,severity:string,confidence:double,unit:string,original_unit:string,unit_inferred:boolean,unit_assumed:boolean,safety_condition:string,supplement:string,known:boolean>"
_STATE = "struct<level:int,blocked:boolean,warnings:array<string>,signals:array<struct<code:string,supplement:string,status:string,needs_review:boolean>>>"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _step(state: Column, item: Column) -> Column:
    """The state after one biomarker: what it says about review depends on all before it and itself."""
    status, code = item["status"], item["code"]
    doubtful = _yes((item["confidence"] != 0) & (item["confidence"] < DOUBTFUL))
    inferred = _yes(item["unit_inferred"])
    assumed = ~inferred & _yes(item["unit_assumed"]) & _yes(item["original_unit"] != "")
    critical, grave = _yes(item["severity"] == "critical"), item["safety_condition"].isNotNull() & _yes(status != "normal")
    blocked = state["blocked"] | critical | grave
    level = F.when(critical | grave, 2).when(doubtful | inferred | assumed | _yes(status.isin("low", "high")), 1).otherwise(0)
    said = {"doubtful": doubtful, "unit_inferred": inferred, "unit_assumed": assumed, "critical": critical, "safety_condition": grave}
    warnings = F.array_compact(F.array(*[F.when(test, F.concat(code, F.lit(f":{name}"))) for name, test in said.items()]))
    review = code.isin(*ALWAYS_REVIEWED) | blocked | _yes(status == "critical_low")
    signal = F.struct(code.alias("code"), item["supplement"].alias("supplement"), status.alias("status"), review.alias("needs_review"))
    signals = F.when(item["supplement"].isNotNull() & _yes(status.isin(*SUPPLEMENTED)), F.concat(state["signals"], F.array(signal))).otherwise(state["signals"])
    after = F.struct(F.greatest(state["level"], level).alias("level"), blocked.alias("blocked"), F.concat(state["warnings"], warnings).alias("warnings"), signals.alias("signals"))
    return F.when(item["known"], after).otherwise(state)


def analysed(reports: DataFrame, items: str = "items") -> DataFrame:
    """reports with level, blocked, warnings (`code:kind`, once each), signals and actions.

    items: an array of the report's biomarkers in their order (fields as in ITEM; without `known`, they have no
    definition and count for the anemia pattern alone). A biomarker blocks and raises the level for those after it: a
    signal needs review if anything up to it blocked. The last item of a code stands for it in the anemia pattern. No
    items, or null ones: caution, with a warning. A report is one row, so its items are what one row holds.
    """
    own = F.coalesce(F.col(items).cast(f"array<{ITEM}>"), F.array().cast(f"array<{ITEM}>"))
    start = F.struct(F.lit(0).alias("level"), F.lit(False).alias("blocked"), F.array().cast("array<string>").alias("warnings"), F.array().alias("signals")).cast(_STATE)
    last = lambda code: F.get(F.reverse(F.filter("_items", lambda x: x["code"] == code)), F.lit(0))["status"]
    low = lambda codes: F.array_max(F.array(*[_yes(last(c).isin(*LOW)) for c in codes]))
    out = reports.withColumn("_items", own).withColumn("_state", F.aggregate("_items", start, lambda s, x: _step(s, x).cast(_STATE)))
    out = out.withColumn("_anemia", low(IRON_STORES) & low(BLOOD_COUNT)).withColumn("_none", F.size("_items") == 0)
    blocked, level = F.col("_state.blocked") | F.col("_anemia"), F.when(F.col("_anemia"), 2).otherwise(F.col("_state.level"))
    more = F.array_compact(F.array(F.when(F.col("_anemia"), "anemia_pattern"), F.when(F.col("_none"), "no_biomarkers")))
    actions = F.when(blocked, F.array(F.lit("do_not_buy"), F.lit("ask_a_professional"))).when(level == 1, F.array(F.lit("confirm_first"))).otherwise(F.array().cast("array<string>"))
    named = F.element_at(F.array(*map(F.lit, LEVELS)), F.when(F.col("_none"), 2).otherwise(level + 1))
    return out.select(*reports.columns, named.alias("level"), blocked.alias("blocked"), F.array_distinct(F.concat("_state.warnings", more)).alias("warnings"), F.col("_state.signals").alias("signals"), actions.alias("actions"))
