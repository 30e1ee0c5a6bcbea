"""Safety rules over products: patterns gated by a restriction, with a dose below which a block is a penalty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators.bounds import bounded


def safety_penalties(products: DataFrame, rules: DataFrame, key: str, text: str, restrictions: str, dose: str) -> DataFrame:
    """(key, penalty, blocked, rules). rules is a small dimension: name, pattern, restriction (null: always), action, severity, dose_limit (null: none).

    A block whose product stays below the dose limit counts as a penalty. Penalties: penalize .25 if severe, else .12; warn .05; at most .80.
    """
    gate = F.col("restriction").isNull() | F.array_contains(F.col(restrictions), F.col("restriction"))
    hits = products.join(bounded(rules, 10_000, "safety rules"), F.rlike(F.col(text), F.col("pattern")) & gate, "left")
    mild = (F.col("action") == "block") & F.col("dose_limit").isNotNull() & (F.col(dose) < F.col("dose_limit"))
    action = F.when(mild, "penalize").otherwise(F.col("action"))
    p = F.when(action == "penalize", F.when(F.col("severity") == "high", 0.25).otherwise(0.12)).when(action == "warn", 0.05).otherwise(0.0)
    out = hits.groupBy(key).agg(F.round(F.least(F.lit(0.80), F.sum(p)), 4).alias("penalty"), F.bool_or(F.coalesce(action == "block", F.lit(False))).alias("blocked"), F.array_sort(F.collect_list("name")).alias("rules"))
    return out


def restriction_adjustment(wanted, has, against):
    """Boost of at most .05 for wanted traits that are there, penalty of at most .70 for forbidden ones; arrays in, a number out."""
    boost = F.least(F.lit(0.05), 0.02 * F.size(F.array_intersect(wanted, has)))
    return boost - F.least(F.lit(0.70), 0.35 * F.size(F.array_intersect(against, has)))


#: Conditions that need a professional, and all those with a warning.
HARD = ("embarazo_lactancia", "enfermedad_renal", "enfermedad_hepatica", "inmunosupresion")
WARNED = (*HARD, "problema_tiroideo", "anticoagulantes", "medicacion_cronica", "diabetes_medicada", "sedantes", "hipertension", "insomnio")
#: Restrictions with a warning.
WARNED_RESTRICTIONS = ("alergia_lacteos", "alergia_soya", "alergia_pescado_mariscos", "evita_gelatina", "sin_gluten")
REVIEW, CAUTION, NORMAL = "medical_review_required", "caution", "normal"


def profile_safety(df: DataFrame, key: str) -> DataFrame:
    """(key, safety_level, survey_level, warnings, actions) of survey answers.

    df: age_years, edad_rango, condiciones_seguridad, restricciones, suplementos_actuales, sleep_quality, night_wakeups,
    horas_sueno, and lab_level (null without a laboratory report). A minor (by age, or by its range if there is none) and
    hard conditions need review; other conditions, restrictions or supplements call for caution. The laboratory's level
    can only raise the survey's. warnings are codes, in order and once each; actions follow the survey's level.
    """
    no = F.array().cast("array<string>")
    conditions, restrictions, taken = (F.coalesce(c, no) for c in ("condiciones_seguridad", "restricciones", "suplementos_actuales"))
    minor = F.coalesce(F.when(F.col("age_years").isNotNull(), F.col("age_years").cast("int") < 18).otherwise(F.col("edad_rango") == "menos_18"), F.lit(False))
    sleepless = F.coalesce((F.col("sleep_quality") == "mala"), F.lit(False)) | F.coalesce(F.col("night_wakeups") == "3_o_mas", F.lit(False)) | F.coalesce(F.col("horas_sueno") == "menos_5h", F.lit(False))
    of = lambda names: F.array(*map(F.lit, names))
    level = F.when(minor | F.arrays_overlap(conditions, of(HARD)), REVIEW).when((F.size(conditions) > 0) | (F.size(restrictions) > 0) | (F.size(taken) > 0), CAUTION).otherwise(NORMAL)
    told = F.concat(F.filter(F.array_distinct(F.concat(conditions, F.when(sleepless, of(["insomnio"])).otherwise(no))), lambda c: c.isin(*WARNED)), F.filter(F.array_distinct(restrictions), lambda r: r.isin(*WARNED_RESTRICTIONS)))
    warnings = F.concat(F.when(F.size(taken) > 0, of(["suplementos_actuales"])).otherwise(no), told, F.when(minor, of(["menor_de_edad"])).otherwise(no))
    lab = F.coalesce("lab_level", F.lit(NORMAL))
    both = F.when((lab == REVIEW) | (level == REVIEW), REVIEW).when(lab == CAUTION, CAUTION).otherwise(level)
    actions = F.when(level == NORMAL, no).otherwise(F.concat(F.when(level == REVIEW, of(["validate_with_professional"])).otherwise(no), of(["do_not_start_alone", "check_label_and_dose"])))
    return df.select(key, both.alias("safety_level"), level.alias("survey_level"), warnings.alias("warnings"), actions.alias("actions"))
