"""A survey's answers as the features of a model: maps, bonuses, caps, implied zeros, diet states and context flags.

The features are built in stages, each of columns that the ones before it made, so that every expression stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores of closed answers.
AGE = {"menos_18": 17, "18_30": 24, "31_50": 40, "mas_50": 60}
SLEEP = {"menos_5h": 5, "5_7h": 4, "7_9h": 1, "mas_9h": 2}
EXERCISE = {"casi_nunca": "sedentario", "1_2_semana": "moderado", "3_4_semana": "activo", "diario": "muy_activo"}
FATIGUE = {"siempre": 5, "a_menudo": 4, "a_veces": 3, "casi_nunca": 1}
SUN = {"menos_15min": "baja", "15_30min": "media", "30_60min": "media", "mas_1h": "alta"}
ILLNESS = {"muy_seguido": 5, "3_4_anio": 4, "1_2_anio": 2, "casi_nunca": 1}
STRESS = {"muy_alto": 5, "alto": 4, "moderado": 3, "bajo": 1}
ALCOHOL = {"frecuente": 2, "ocasional": 1, "raro": 0, "nunca": 0}
SEVERITY = {"nunca": 1, "leve": 2, "moderado": 3, "frecuente": 4, "severo": 5}
WEIGHT = {"menos_50": 47.0, "50_65": 57.5, "66_80": 73.0, "mas_80": 88.0}
HEIGHT = {"menos_155": 152.0, "155_165": 160.0, "166_175": 170.0, "mas_175": 180.0}
SLEEP_QUALITY, WAKEUPS = {"buena": 1, "regular": 3, "mala": 5}, {"nunca": 1, "1_2": 3, "3_o_mas": 5}
CAFFEINE, RECOVERY = {"no": 0, "a_veces": 1, "si": 2}, {"no": 1, "leve": 2, "moderada": 4, "alta": 5}
#: Food groups that a diet excludes: none of them is eaten, though not asked.
EXCLUDED = {"vegano": ("red_meat", "poultry", "fish", "eggs", "dairy"), "vegetariano": ("red_meat", "poultry", "fish"), "pescetariano": ("red_meat", "poultry")}
#: Grams of protein a serving, of food that isn't asked for, and of a powder without a stated dose.
PROTEIN = {"red_meat_servings_week": 25.0, "poultry_servings_week": 25.0, "fish_servings_week": 22.0, "eggs_servings_week": 6.0, "legume_servings_week": 12.0, "dairy_servings_week": 8.0}
PROTEIN_OTHER, PROTEIN_POWDER = 15.0, 20.0
SYMPTOMS = ("dolor_muscular", "dolor_articular", "niebla_mental", "caida_cabello", "piel_seca", "unas_quebradizas", "calambres")
QUANTITIES = ("fermented_foods_week", "water_intake_l_day", "screen_hours_day", "heavy_sweat_days_week", "headache_days_week", "fatigue_days_week", "alcohol_drinks_week", "caffeine_servings_day", "exercise_days_week")


def _map(c: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _falling(value: Column, low: float, critical: float) -> Column:
    return F.when(value.isNull(), "missing").when(value <= critical, "critical_low").when(value <= low, "low").otherwise("normal")


def payload(df: DataFrame, key: str) -> DataFrame:
    """key and a model's features from a row of answers. An answer that the table lacks counts as not given.

    Numbers that weren't given are -1. A diet counts as deficient if it is little varied, if anemia is known, or if two of
    the states that come from stated amounts are low.
    """
    there = set(df.columns)

    def a(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in there else F.lit(None).cast(kind)

    num = lambda name: a(name, "double")
    yes = lambda c: F.coalesce(c, F.lit(False))
    flag = lambda c: F.when(yes(c), 1).otherwise(0)
    supplements = F.coalesce(F.col("suplementos_actuales"), F.array().cast("array<string>")) if "suplementos_actuales" in there else F.array().cast("array<string>")
    medicines = F.size(F.coalesce(F.col("medicamentos_b12"), F.array().cast("array<string>"))) if "medicamentos_b12" in there else F.lit(0)
    drinks, caffeine = num("alcohol_drinks_week"), num("caffeine_servings_day")
    base = df.withColumns({
        "_edad": F.coalesce(num("age_years").cast("int"), _map(a("edad_rango"), AGE)), "_sol": _map(a("exposicion_solar"), SUN), "_enf": _map(a("frecuencia_enfermedad"), ILLNESS), "_irr": _map(a("estres"), STRESS), "_fat": _map(a("fatiga"), FATIGUE),
        "_alc": F.greatest(_map(a("alcohol"), ALCOHOL, 0), F.when(drinks >= 14, 2).when(drinks >= 4, 1).otherwise(0)), "_dieta": F.coalesce(a("tipo_dieta"), F.lit("omnivoro")), "_def": yes(a("dieta") == "poco_variada"),
        **{f"_{s}": _map(F.coalesce(a(s), F.lit("leve")), SEVERITY) for s in SYMPTOMS}, "_digestive": _map(F.coalesce(a("digestive_discomfort"), F.lit("nunca")), SEVERITY), "_kg": F.coalesce(num("weight_kg"), _map(a("peso_rango"), WEIGHT), F.lit(60.0)), "_cm": F.coalesce(num("height_cm"), _map(a("talla_rango"), HEIGHT), F.lit(165.0)),
    })
    days = num("exercise_days_week")
    sleep = F.when((F.col("_edad") < 18) & (a("horas_sueno") == "5_7h"), SLEEP["menos_5h"]).otherwise(_map(a("horas_sueno"), SLEEP))
    cup = _map(a("caffeine_after_3pm"), CAFFEINE, 0)
    excluded = lambda group: F.col("_dieta").isin(*[d for d, g in EXCLUDED.items() if group in g])
    food = lambda name, group: F.when(num(name).isNull() & excluded(group), 0.0).otherwise(num(name))
    second = base.withColumns({
        "_act": F.when(days == 0, "sedentario").when(days <= 2, "moderado").when(days <= 4, "activo").when(days > 4, "muy_activo").otherwise(_map(a("frecuencia_ejercicio"), EXERCISE)),
        "_sue": F.least(F.lit(5), F.greatest(sleep, _map(a("sleep_quality"), SLEEP_QUALITY, 0), _map(a("night_wakeups"), WAKEUPS, 0)) + cup), "_irr": F.least(F.lit(5), F.col("_irr") + cup), "_dolor_muscular": F.greatest("_dolor_muscular", _map(a("recovery_difficulty"), RECOVERY, 0)),
        "_fish": food("fish_servings_week", "fish"), "_red": food("red_meat_servings_week", "red_meat"), "_poultry": food("poultry_servings_week", "poultry"), "_eggs": food("eggs_servings_week", "eggs"), "_legume": num("legume_servings_week"), "_fruit": num("fruit_veg_servings_day"),
        "_dairy_w": F.coalesce(food("dairy_servings_week", "dairy"), num("dairy_servings_day") * 7), "_fat": F.greatest("_fat", F.when(num("fatigue_days_week") >= 5, 5).when(num("fatigue_days_week") >= 3, 4).when(num("fatigue_days_week") >= 1, 3).otherwise(0)),
    })
    grams = sum((F.col(c) * PROTEIN[n] for c, n in zip(("_red", "_poultry", "_fish", "_eggs", "_legume", "_dairy_w"), PROTEIN, strict=True)), F.lit(0.0))
    dose = F.col("suplementos_dosis_actual")["proteina"] if "suplementos_dosis_actual" in there else F.lit(None).cast("double")
    powder = F.when(F.array_contains(supplements, "proteina"), F.coalesce(dose, F.lit(PROTEIN_POWDER))).otherwise(0.0)
    many = caffeine >= 3
    third = second.withColumns({
        "_meat": F.coalesce(num("meat_servings_week"), F.col("_red") + F.col("_poultry")), "_dairy_d": F.coalesce(num("dairy_servings_day"), F.round(F.col("_dairy_w") / 7, 4)), "_protein": F.coalesce(num("protein_g_day_estimate"), F.round(F.round(grams / 7 + PROTEIN_OTHER, 2) + powder, 2)),
        "_fat": F.when(yes(a("fatiga_duracion") == "menos_2_semanas") | yes((a("fatiga_mejora_descanso") == "si") & (F.col("_sue") >= 4)), F.least(F.col("_fat"), F.lit(3))).otherwise(F.col("_fat")),
        "_irr": F.when(many, F.greatest("_irr", F.lit(4))).otherwise(F.col("_irr")), "_sue": F.when(many, F.greatest("_sue", F.lit(3))).otherwise(F.col("_sue")),
    })
    plant = F.col("_dieta").isin("vegano", "vegetariano")
    meat, legume, fruit = F.col("_meat"), F.col("_legume"), F.col("_fruit")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    covered = F.arrays_overlap(supplements, F.array(F.lit("vitamina_b12"), F.lit("multivitaminico"))) | yes(a("alimentos_fortificados_b12") == "si")
    b12 = F.when(F.col("_dieta") == "vegano", "critical_low").when(F.col("_dieta") == "vegetariano", "low").otherwise(_falling(meat, 2, 0.5))
    folate = F.when(legume.isNull() & fruit.isNull(), "missing").when((zero(legume) <= 1) & (zero(fruit) <= 1), "critical_low").when((zero(legume) <= 2) & (zero(fruit) <= 2), "low").otherwise("normal")
    zinc = (
        F.when(meat.isNull() & ~plant, "missing").when(legume.isNull() & (plant | (meat <= 2)), "missing").when(plant & (zero(legume) < 3), "low").when((zero(meat) <= 0.5) & (zero(legume) <= 1), "critical_low").when((zero(meat) <= 2) & (zero(legume) <= 2), "low").otherwise("normal")
    )
    per_kg = F.col("_protein") / F.greatest(F.col("_kg"), F.lit(1.0))
    anemia = yes(a("iron_anemia_history") == "si")
    states = {
        "b12": F.when(covered, "normal").when(yes((F.col("_dieta") == "vegano") & (a("anios_dieta_vegetal") == "menos_1")), "low").otherwise(b12), "vitamin_c": _falling(fruit, 2, 1), "zinc": zinc, "magnesium": _falling(legume, 2, 0.5), "calcium": _falling(F.col("_dairy_d"), 1, 0.25),
        "folate": F.when(anemia & (folate == "normal"), "low").otherwise(folate), "protein": F.when(per_kg.isNull(), "missing").when(per_kg < 0.55, "critical_low").when(per_kg < 0.8, "low").otherwise("normal"), "omega3": _falling(F.col("_fish"), 1, 0.25),
    }
    fourth = third.withColumns({f"benchmark_diet_{k}_status": v for k, v in states.items()})
    low = lambda k: F.when(F.col(f"benchmark_diet_{k}_status").isin("low", "critical_low"), 1).otherwise(0)
    lows = sum((low(k) for k in ("calcium", "vitamin_c", "magnesium", "folate", "zinc", "protein")), F.lit(0)) + F.when(num("fish_servings_week").isNotNull(), low("omega3")).otherwise(0) + F.when(~plant, low("b12")).otherwise(0)
    fifth = fourth.withColumn("_def", F.col("_def") | anemia | (lows >= 2))

    def counted(*flags: Column) -> Column:
        return F.when(F.coalesce(*flags).isNull(), -1).otherwise(sum((flag(f) for f in flags), F.lit(0)))

    years, screen, sweat = a("anios_dieta_vegetal"), num("screen_hours_day"), num("heavy_sweat_days_week")
    given = lambda c: F.coalesce(c, F.lit(-1.0))
    col = F.col
    out = {
        "sexo": _map(a("sexo"), {"femenino": "F", "masculino": "M"}, "F"), "tipo_dieta": col("_dieta"), "exposicion_solar": col("_sol"), "nivel_actividad": col("_act"), "edad": col("_edad"), "peso_kg": col("_kg"), "altura_cm": col("_cm"), "bmi": F.coalesce(num("bmi"), F.round(col("_kg") / F.pow(col("_cm") / 100, F.lit(2.0)), 1)),
        "fish_servings_week": given(col("_fish")), "dairy_servings_day": given(col("_dairy_d")), "legume_servings_week": given(legume), "meat_servings_week": given(meat), "red_meat_servings_week": given(col("_red")), "poultry_servings_week": given(col("_poultry")), "eggs_servings_week": given(col("_eggs")),
        "fruit_veg_servings_day": given(fruit), "protein_g_day_estimate": given(col("_protein")), **{q: given(num(q)) for q in QUANTITIES}, "fatiga_general": col("_fat"), **{s: col(f"_{s}") for s in SYMPTOMS}, "niebla_mental": F.greatest("_niebla_mental", F.when(col("_irr") >= 4, 3).otherwise(1)),
        "problemas_sueno": col("_sue"), "enfermedad_frecuente": F.least(F.lit(5), col("_enf") + col("_alc")), "irritabilidad": col("_irr"), "digestive_discomfort": col("_digestive"), "dieta_deficiente": flag(col("_def")), "estres_alto": flag(col("_irr") >= 4),
        "meta_energia": flag((col("_fat") >= 3) | (col("_sue") >= 4) | col("_def")), "meta_inmunidad": flag((col("_enf") >= 3) | (col("_alc") >= 1)), "meta_belleza": flag(F.greatest("_caida_cabello", "_piel_seca", "_unas_quebradizas") >= 3), "meta_rendimiento": flag(col("_act").isin("activo", "muy_activo")),
        "meta_salud_osea": flag((col("_sol") == "baja") | (col("_edad") >= 50) | col("_def")), "meta_cognitivo": flag((col("_irr") >= 4) | (col("_sue") >= 4)), "meta_visual": flag(screen >= 6), "meta_digestiva": flag(col("_digestive") >= 3),
        "meta_hidratacion": flag(yes(col("_calambres") >= 3) | yes(num("headache_days_week") >= 3) | yes(sweat >= 3)), "meta_cardiovascular": flag(col("_edad") >= 50), **{f"benchmark_diet_{k}_status": col(f"benchmark_diet_{k}_status") for k in states},
        "iron_loss_risk": counted(a("menstruacion_abundante") == "si", a("parto_ultimo_anio") == "si", a("dona_sangre") == "2_o_mas_al_anio"), "vitamin_d_sun_barrier": counted(a("piel_expuesta") == "cara_manos"),
        "b12_absorption_risk": F.when((medicines > 0) | years.isNotNull() | a("alimentos_fortificados_b12").isNotNull(), medicines + flag((years == "mas_3") & ~covered)).otherwise(-1),
    }
    return fifth.select(key, *[c.alias(n) for n, c in out.items()])
