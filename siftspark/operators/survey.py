"""Survey answers: checks across fields, normalised fields, derived signals, restriction flags of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators.features import with_defaults

#: Factors of units to kilograms and centimetres.
TO_KG = {"kg": 1.0, "g": 0.001, "lb": 0.45359237, "oz": 0.0283495231, "st": 6.35029318}
#: Units of weight by other names.
WEIGHT_NAMES = {"libra": "lb", "libras": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb", "onza": "oz", "onzas": "oz", "ounce": "oz", "ounces": "oz", "stone": "st", "stones": "st"}
TO_CM = {"cm": 1.0, "m": 100.0, "in": 2.54, "ft": 30.48}
#: Price range of a stated budget.
BUDGETS = {"bajo": (0.0, 80.0), "medio": (80.0, 200.0), "alto": (200.0, 500.0)}
#: Goals that a main goal adds.
GOALS = {
    "energia": ("energia",), "inmunidad": ("inmunidad",), "suenio_estres": ("suenio", "estres"), "rendimiento": ("rendimiento",), "salud_osea": ("salud_osea",), "cabello_piel_unas": ("cabello_piel_unas",), "salud_visual": ("salud_visual",),
    "digestion": ("digestion",), "hidratacion": ("hidratacion",), "salud_cardiovascular": ("salud_cardiovascular",), "salud_cognitiva": ("salud_cognitiva",), "nutricion_general": (),
}


def _by(c: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.lower(F.trim(c)) == k, F.lit(v)).otherwise(out)
    return out


def weight_in_kg(value: Column, unit: Column) -> Column:
    """Kilograms of a weight, to four places; the unit by its sign or another name, in any case and with points. Null for other units."""
    clean = F.replace(F.lower(F.trim(unit)), F.lit("."), F.lit(""))
    named = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in WEIGHT_NAMES.items() for x in kv]), lambda k, _: k == clean)), F.lit(0)), clean)
    return F.round(value.cast("double") * _by(named, TO_KG), 4)


def survey_errors(sexo: str = "sexo") -> Column:
    """Names of the contradictions in a row of answers, in a fixed order; a null answer contradicts nothing."""
    col, n = F.col, F.size
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    listed = F.coalesce(n("suplementos_actuales") > 0, F.lit(False))
    checks = {
        "weight_range": ~col("weight_kg").between(2, 500),
        "height_range": ~col("height_cm").between(40, 260),
        "supplements_missing": (col("toma_suplementos") == "si") & ~listed,
        "supplements_unexpected": (col("toma_suplementos") == "no") & listed,
        "no_restrictions_combined": has("restricciones", "sin_restricciones") & (n("restricciones") > 1),
        "no_safety_condition_combined": has("condiciones_seguridad", "ninguna") & (n("condiciones_seguridad") > 1),
        "pregnancy_of_a_man": (col(sexo) == "masculino") & has("condiciones_seguridad", "embarazo_lactancia"),
        "menstruation_of_a_man": (col(sexo) == "masculino") & (F.coalesce(col("menstruacion_abundante") == "si", F.lit(False)) | F.coalesce(col("parto_ultimo_anio") == "si", F.lit(False))),
        "training_without_days": (col("exercise_days_week") == 0) & (col("training_type") != "no_aplica"),
        "days_without_training": (col("exercise_days_week") > 0) & (col("training_type") == "no_aplica"),
        "dose_missing": (col("toma_suplementos") == "si") & (col("suplementos_dosis_conocida")) & (n(F.array_except("suplementos_actuales", F.map_keys("suplementos_dosis_actual"))) > 0),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))


def normalised_survey(df: DataFrame) -> DataFrame:
    """df with weight_kg, height_cm and bmi out of stated units, goals with those of the main goal (four at most), servings, supplements and budget made consistent."""
    col, when = F.col, F.when
    kg, cm = F.coalesce(col("weight_value") * _by(col("weight_unit"), TO_KG), col("weight_kg")), F.coalesce(col("height_value") * _by(col("height_unit"), TO_CM), col("height_cm"))
    none = F.array().cast("array<string>")
    own = F.coalesce("objetivos", none)
    more = none
    for main, names in GOALS.items():
        more = when(col("objetivo_principal") == main, F.array(*map(F.lit, names)) if names else none).otherwise(more)
    goals = when(F.size(own) >= 4, own).otherwise(F.slice(F.concat(own, F.array_except(more, own)), 1, 4))
    no_meat = F.coalesce(col("no_meat"), F.lit(False))
    red, poultry = (when(no_meat, F.lit(0.0)).otherwise(col(c)) for c in ("red_meat_servings_week", "poultry_servings_week"))
    takes = col("toma_suplementos") == "si"
    dose = when(takes & F.coalesce(col("suplementos_dosis_conocida"), F.lit(False)), F.map_filter("suplementos_dosis_actual", lambda k, _: F.array_contains(F.col("suplementos_actuales"), k)))
    unset = col("presupuesto_min").isNull() & col("presupuesto_max").isNull()
    budget = lambda i, own: when(col("presupuesto") == "sin_preferencia", None).when(unset, _by(col("presupuesto"), {k: v[i] for k, v in BUDGETS.items()})).otherwise(own)
    return df.withColumns({
        "weight_kg": kg, "height_cm": cm, "bmi": F.round(kg / F.pow(cm / 100, F.lit(2.0)), 2), "objetivos": goals, "red_meat_servings_week": red, "poultry_servings_week": poultry,
        "meat_servings_week": F.coalesce(col("meat_servings_week"), red + poultry), "dairy_servings_day": F.coalesce(col("dairy_servings_day"), F.round(col("dairy_servings_week") / 7, 4)),
        "suplementos_dosis_actual": F.coalesce(dose, F.create_map().cast("map<string,double>")), "suplementos_dosis_conocida": when(F.coalesce(takes, F.lit(False)), col("suplementos_dosis_conocida")),
        "anios_dieta_vegetal": when(col("tipo_dieta").isin("vegano", "vegetariano"), col("anios_dieta_vegetal")), "presupuesto_min": budget(0, col("presupuesto_min")), "presupuesto_max": budget(1, col("presupuesto_max")),
    })


def soft_signals(df: DataFrame) -> DataFrame:
    """df with ten signals that single answers don't give; one that df has already, and isn't null, stays."""
    there = set(df.columns)

    def num(name: str, default: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(float(default))) if name in there else F.lit(float(default))

    def is_one(name: str) -> Column:
        return num(name, 0) == 1

    def text_in(name: str, *values: str) -> Column:
        return F.coalesce(F.col(name).isin(*values), F.lit(False)) if name in there else F.lit(False)

    low = ("low", "critical_low")
    active = text_in("nivel_actividad", "activo", "muy_activo")
    fruit_known, fruit = num("fruit_veg_servings_day_reported", 0) != 0, num("fruit_veg_servings_day", -1)
    protein_known, protein = num("protein_g_day_estimate_reported", 0) != 0, num("protein_g_day_estimate", -1)
    gap = F.when(protein_known, F.greatest(F.lit(0.0), num("peso_kg", 70) * F.when(active, 1.2).otherwise(0.85) - protein)).otherwise(F.lit(-1.0))
    screen, fermented, water = num("screen_hours_day", -1), num("fermented_foods_week", -1), num("water_intake_l_day", -1)
    hits = [is_one("meta_belleza"), num("caida_cabello", 0) >= 4, num("piel_seca", 0) >= 4, num("unas_quebradizas", 0) >= 4, text_in("lab_zinc_status", *low), text_in("lab_ferritin_status", *low)]
    fish = num("fish_servings_week", -1)
    flag = lambda c: F.when(c, 1).otherwise(0)
    signals = {
        "vitamin_c_diet_signal": flag(fruit_known & (fruit <= 2) & (is_one("dieta_deficiente") | (num("enfermedad_frecuente", 0) >= 4) | is_one("meta_inmunidad"))),
        "protein_gap_g_day": F.round(gap, 2),
        "protein_insufficient_signal": flag(protein_known & ((protein < 55) | (gap >= 20) | (active & (gap >= 12) & is_one("meta_rendimiento")))),
        "hair_skin_nails_cluster": sum((flag(h) for h in hits), F.lit(0)),
        "visual_strain_signal": flag((is_one("meta_visual") | ((screen >= 0) & (screen >= 6))) & (~fruit_known | (fruit <= 2))),
        "digestive_support_signal": flag(is_one("meta_digestiva") | (num("digestive_discomfort", 1) >= 3) | ((fermented >= 0) & (fermented <= 1) & is_one("dieta_deficiente"))),
        "hydration_electrolyte_signal": flag(is_one("meta_hidratacion") | ((water >= 0) & (water <= 1.2)) | (num("heavy_sweat_days_week", -1) >= 3) | (num("calambres", 1) >= 3)),
        "fatigue_nutrition_signal": flag((num("fatiga_general", 1) >= 4) & (is_one("dieta_deficiente") | text_in("benchmark_diet_b12_status", *low) | text_in("benchmark_diet_protein_status", *low))),
        "cardiovascular_context_signal": flag(is_one("meta_cardiovascular") | text_in("lab_total_cholesterol_status", "high") | text_in("lab_ldl_status", "high") | ((num("edad", 30) >= 50) & fish.between(0, 1))),
        "cognitive_context_signal": flag(is_one("meta_cognitivo") | (num("niebla_mental", 1) >= 3) | ((num("problemas_sueno", 1) >= 4) & (num("fatiga_general", 1) >= 3))),
    }
    return with_defaults(df, signals)


#: What a product's text holds if it is inferred to hold an ingredient or make a claim.
INFERRED = {
    "contains_fish": r"\bfish oil\b|\bpescado\b|\bomega\s*3\b|\bepa\b|\bdha\b|\bkrill\b", "contains_shellfish": r"\bmariscos?\b|\bcrustaceos?\b|\bshellfish\b|\bkrill\b", "contains_gelatin": r"\bcapsulas? blandas?\b|\bsoftgel\b|\bgelatina\b|\bgelatin\b",
    "softgel": r"\bcapsulas? blandas?\b|\bsoftgel\b", "contains_lactose": r"\blactosa\b|\blactose\b", "contains_dairy": r"\bwhey\b|\bsuero de leche\b|\bleche\b|\bcaseina\b|\bcasein\b", "contains_soy": r"\bsoya\b|\bsoy\b|\blecitina de soya\b|\bsoy lecithin\b",
    "gluten_free": r"\bsin gluten\b|\bgluten free\b|\blibre de gluten\b",
}
#: What the official composition, or form, says where it is verified.
VERIFIED = {
    "contains_fish": r"\baceite de pescado\b|\bpescado\b|\bfish oil\b|\bomega\s*3\s+marino\b|\bacidos? grasos? de pescado\b", "contains_shellfish": r"\bmariscos?\b|\bcrustaceos?\b|\bshellfish\b|\bkrill\b", "contains_gelatin": r"\bgelatina\b|\bgelatin\b",
    "contains_lactose": r"\blactosa\b|\blactose\b", "contains_dairy": r"\bleche\b|\bsuero de leche\b|\bwhey\b|\bcaseina\b|\bcasein\b", "contains_soy": r"\bsoya\b|\bsoy\b|\blecitina de soya\b|\bsoy lecithin\b",
}
SOFTGEL = r"\bcapsula blanda\b|\bcapsulas blandas\b|\bsoftgel\b"


def restriction_flags(text: Column, composition: Column, form: Column, gluten_free: Column) -> dict[str, Column]:
    """17 flags by name: eight and a synonym verified by the official composition and form, eight and one inferred from a product's text. Arguments: plain text each; gluten_free: what the source states."""
    held = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    v = {k: held(composition, p) for k, p in VERIFIED.items()}
    soft = held(form, SOFTGEL)
    out = {
        "contains_fish": v["contains_fish"], "contains_shellfish": v["contains_shellfish"], "contains_gelatin": soft | v["contains_gelatin"], "softgel_verified": soft, "contains_dairy": v["contains_lactose"] | v["contains_dairy"],
        "contains_lactose": v["contains_lactose"], "contains_soy": v["contains_soy"], "contains_soya": v["contains_soy"], "gluten_free_verified": F.coalesce(F.lower(F.trim(gluten_free)).isin("1", "true", "yes", "si", "sí", "verified"), F.lit(False)),
    }
    inferred = {f"{k}_inferred": held(text, p) for k, p in INFERRED.items()}
    return {**out, **inferred, "contains_soya_inferred": inferred["contains_soy_inferred"]}


#: Ladders of bins, (comparison, bound, bin) in order, then the last bin.
AGE = ((("<", 18, "menos_18"), ("<=", 30, "18_30"), ("<=", 50, "31_50")), "mas_50")
WEIGHT = ((("<", 50, "menos_50"), ("<=", 65, "50_65"), ("<=", 80, "66_80")), "mas_80")
HEIGHT = ((("<", 155, "menos_155"), ("<=", 165, "155_165"), ("<=", 175, "166_175")), "mas_175")
SLEEP = ((("<", 5, "menos_5h"), ("<", 7, "5_7h"), ("<", 9, "7_9h")), "mas_9h")
SUN = ((("<", 15, "menos_15min"), ("<", 30, "15_30min"), ("<=", 60, "30_60min")), "mas_1h")
STRESS = ((("<=", 3, "bajo"), ("<=", 7, "moderado"), ("<=", 11, "alto")), "muy_alto")
ALCOHOL = ((("<=", 0, "nunca"), ("<", 1, "raro"), ("<=", 7, "ocasional")), "frecuente")
EXERCISE = ((("<=", 0, "casi_nunca"), ("<=", 2, "1_2_semana"), ("<=", 4, "3_4_semana")), "diario")


def bin_of(c: Column, ladder) -> Column:
    """The first bin whose bound the value keeps, null for a null value."""
    steps, out = ladder[0], F.when(c.isNotNull(), ladder[1])
    for sign, bound, name in reversed(steps):
        out = F.when(c < bound if sign == "<" else c <= bound, name).otherwise(out)
    return out


def sleep_bin(hours: Column) -> Column:
    return bin_of(F.when(hours <= 24, hours), SLEEP)


def sun_bin(workday: Column, freeday: Column) -> Column:
    """Minutes a day over a week of five working days; one kind of day stands for the other if that is null."""
    return bin_of((5 * F.coalesce(workday, freeday) + 2 * F.coalesce(freeday, workday)) / 7, SUN)


def stress_bin(*items: Column) -> Column:
    """Of the sum of all items; null if one is."""
    return bin_of(sum(items[1:], items[0]), STRESS)


def exercise_days(vigorous: Column, vigorous_days: Column, moderate: Column, moderate_days: Column) -> Column:
    """The more days of both kinds, seven at most; a kind that is answered with no counts none, one without an answer leaves it unknown. Greater codes than seven are no answers."""
    days = lambda yes, n: F.when(yes.isin(7, 9), None).when(yes == 1, F.when(~n.isin(77, 99), n)).when(yes.isNotNull(), 0)
    v, m = days(vigorous, vigorous_days), days(moderate, moderate_days)
    return F.when(v.isNotNull() & m.isNotNull(), F.least(F.lit(7), F.greatest(v, m)).cast("int"))


#: Restrictions by a second name.
RESTRICTION_NAMES = {"alergia_pescado_mariscos": "pescado_mariscos", "alergia_lacteos": "lacteos", "alergia_soya": "soya"}


def with_aliases(values: Column, names: dict[str, str] | None = None) -> Column:
    """The distinct values with the second names of those that have one; null is none."""
    own = F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))
    known = F.create_map(*[F.lit(x) for kv in (names or RESTRICTION_NAMES).items() for x in kv])
    return F.array_union(own, F.array_compact(F.transform(own, lambda v: F.get(F.map_values(F.map_filter(known, lambda k, _: k == v)), F.lit(0)))))
