"""Known answers of scalar functions and rule scoring."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftspark.functions import scores as S
from siftspark.functions import text as X
from siftspark.operators import catalog, rules


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    fields = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column.alias("x")).first().x


@pytest.mark.parametrize(("rating", "want"), [(1.0, 0.0), (2.0, 0.25), (3.0, 0.5), (4.0, 0.75), (5.0, 1.0)])
def test_reward_of_a_rating_alone(spark, rating, want):
    no = F.lit(None).cast("boolean")
    assert one(spark, S.reward(F.col("r"), no, no, F.lit(None).cast("string")), r=rating) == want


def test_reward_without_purchase(spark):
    assert one(spark, S.reward(F.col("r"), F.col("p"), F.lit(None).cast("boolean"), F.lit(None).cast("string")), r=5.0, p=False) == pytest.approx(0.4)


def test_wilson(spark):
    low, high = S.wilson(F.col("k"), F.col("n"))
    assert round(one(spark, low, k=5.0, n=10.0), 4) == 0.2366
    assert round(one(spark, high, k=5.0, n=10.0), 4) == 0.7634
    assert one(spark, low, k=0.0, n=0.0) is None


@pytest.mark.parametrize(("raw", "want"), [("DE-1230", "DE1230"), (" de 1230 ", "DE1230"), (None, "")])
def test_registry_key(spark, raw, want):
    assert one(spark, X.registry_key(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("R.S. N° DE-04606", "DE04606"), ("Nutricion completa", ""), (None, "")])
def test_registry_code(spark, raw, want):
    assert one(spark, X.registry_code(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1.000,5", 1000.5), ("4,000.00", 4000.0), ("2 000", 2000.0), ("12,5", 12.5), ("1.234", 1234.0), ("abc", None), (None, None)])
def test_locale_number(spark, raw, want):
    assert one(spark, X.locale_number(F.col("c")), c=raw) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Compra aquí https://example.com te cura garantizado", {"contains_url", "medical_claim"}), ("bueno bueno bueno bueno bueno bueno bueno bueno", {"repeated_words"}), ("bueno, (bueno) bueno bueno bueno bueno bueno", set()),
        ("muy buenooooooooo", {"repeated_characters"}), ("escribe a a@b.pe o WhatsApp", {"contains_contact", "personal_data"}), ("duplicar dosis y 5 mg/kg", {"unsafe_dosing"}), ("a calm and useful review of it all", set()), ("   ", set()), (None, set()),
    ],
)
def test_spam_flags(spark, text, want):
    assert set(one(spark, X.spam_flags(F.col("c")), c=text)) == want


@pytest.mark.parametrize(("rating", "purchased", "still", "benefit", "want"), [(None, True, None, None, 0.20), (7.0, True, None, None, 0.60), (0.0, None, None, None, 0.0), (9.0, None, None, None, 1.0), (5.0, True, True, "claro", 1.0), (3.0, None, None, "ninguno", 0.2), (5.0, False, None, " LEVE", 0.45), (None, None, None, None, 0.0), (1.0, False, False, None, 0.0)])
def test_reward_with_outcomes(spark, rating, purchased, still, benefit, want):
    r = S.reward(F.lit(rating).cast("double"), F.lit(purchased).cast("boolean"), F.lit(still).cast("boolean"), F.lit(benefit).cast("string"))
    assert one(spark, r, c="") == pytest.approx(want)


@pytest.mark.parametrize(
    ("context", "everywhere", "level", "used", "side"),
    [((0.9, 5), (0.2, 40), "context", 5, 1), ((0.9, 4), (0.2, 40), "global", 40, -1), ((0.9, 4), (0.2, 9), "insufficient", 0, 0), ((0.9, 3), (None, 0), "insufficient", 0, 0), ((None, 0), (None, 0), "none", 0, 0)],
)
def test_signal_choice(spark, context, everywhere, level, used, side):
    x = one(spark, S.chosen_signal(F.lit(context[1]), F.lit(context[0]).cast("double"), F.lit(everywhere[1]), F.lit(everywhere[0]).cast("double")), c="")
    assert (x.level, x.used) == (level, used)
    assert (x.value > 0.70, x.value < 0.70) == (side > 0, side < 0)


def test_stock_price_and_ladder(spark):
    val = lambda c: one(spark, c, c="")
    none = F.lit(None).cast("double")
    assert [val(S.stock_score(F.lit(n).cast("int"), F.lit(a))) for n, a in ((5, "Available"), (4, "available"), (0, "available"), (None, "available"), (9, "sold out"), (9, None))] == [1.0, 0.75, 0.40, 0.75, 0.25, 0.25]
    assert val(S.price_score(F.lit(10.5), F.lit(10.0), F.lit(10.2))) == pytest.approx(0.4 * (1 - 0.3 / 10.2))
    assert val(S.price_score(F.lit(10.1), F.lit(10.0), F.lit(10.2))) == pytest.approx(0.97)
    assert val(S.price_score(F.lit(0.9), none, F.lit(0.5))) == pytest.approx(0.4 * 0.6)
    assert val(S.price_score(F.lit(5.0), F.lit(20.0), F.lit(50.0))) == 1.0
    ladder = lambda v, own=None: val(S.status_ladder(F.lit(float(v)), F.lit(10.0), F.lit(150.0), F.lit(20.0), F.lit(100.0), F.lit(30.0), F.lit(own).cast("double"), none))
    assert [ladder(v) for v in (9, 10, 19.9, 20, 29.9, 30, 100, 100.1, 150, 151)] == ["critical_low", "low", "low", "borderline", "borderline", "normal", "normal", "high", "high", "critical_high"]
    assert (ladder(25, 22.0), ladder(25, 26.0)) == ("normal", "low")


def test_evidence_falls_back_to_strength(spark):
    of = lambda g, s: one(spark, S.evidence_score(F.lit(g), F.lit("primary"), F.lit("official_fact_sheet"), F.lit("no"), F.lit("low"), F.lit(0.0), F.lit(s)), c="")
    assert of("none", "strong_with_lab") == pytest.approx(0.36 * 0.96 + 0.64)
    assert of("low", "high") == pytest.approx(0.36 * 0.72 + 0.64)
    assert of("none", "none") == pytest.approx(0.36 * 0.55 + 0.64)


def test_pack_key_ignores_order(spark):
    a = one(spark, S.pack_key(F.array(F.lit("b"), F.lit("a"))), c="")
    assert a == one(spark, S.pack_key(F.array(F.lit("a"), F.lit("b"))), c="")
    assert a.startswith("pack_")
    assert len(a) == 15


def test_context_key(spark):
    assert one(spark, S.context_key(F.array(*map(F.lit, ["z", "healthy", "b", "z", "a", "q"]))), c="") == "a+b+z"


#: Fields, their families and the components of proxies, as the known answers name them.
FAMILIES = [
    ("fruit_veg_servings_day", "fruit_veg", False), ("benchmark_diet_vitamin_c_status", "fruit_veg", False), ("enfermedad_frecuente", "illness", False), ("iron_loss_risk", "iron_loss", False), ("fatiga_general", "fatigue", False),
    ("problemas_sueno", "sleep", False), ("sun_hours", "sun", False), ("age_years", "age", False), ("lab_vitamin_d_status", "lab_vitamin_d_status", True),
]
DIET = ["fruit_veg", "fish", "dairy", "diet_general"]
PROXIES = [("vitamin_c_diet_signal", ["fruit_veg", "illness", *DIET]), ("dieta_deficiente", DIET), ("meta_cognitivo", ["sleep", "stress"]), ("cognitive_context_signal", ["sleep", "stress", "brain_fog", "fatigue"])]


@pytest.mark.parametrize(
    ("matched", "score", "families", "corroborated", "plain_sum"),
    [
        ([("fruit_veg_servings_day", 0.22), ("vitamin_c_diet_signal", 0.20), ("benchmark_diet_vitamin_c_status", 0.42), ("enfermedad_frecuente", 0.16)], 0.58, 2, True, 1.00), ([("iron_loss_risk", 0.20), ("iron_loss_risk", 0.15)], 0.35, 1, False, 0.35),
        ([("dieta_deficiente", 0.28), ("fruit_veg_servings_day", 0.22)], 0.22, 1, False, 0.50), ([("dieta_deficiente", 0.28), ("fatiga_general", 0.24)], 0.52, 2, True, 0.52), ([("meta_cognitivo", 0.18), ("problemas_sueno", 0.18), ("cognitive_context_signal", 0.24)], 0.18, 1, False, 0.60),
        ([("lab_vitamin_d_status", 0.6)], 0.6, 1, True, 0.6), ([("sun_hours", 0.3), ("age_years", 0.12)], 0.42, 2, True, 0.42), ([("meta_cognitivo", 0.18), ("cognitive_context_signal", 0.24)], 0.24, 1, False, 0.42),
    ],
)
def test_one_score_by_family(spark, matched, score, families, corroborated, plain_sum):
    hits = spark.createDataFrame([(1, "c", f, w) for f, w in matched], "id long, cond string, field string, weight double")
    fam = spark.createDataFrame(FAMILIES, "field string, family string, is_lab boolean")
    prox = spark.createDataFrame(PROXIES, "field string, components array<string>")
    got = rules.family_scores(hits, "id", fam, prox).first()
    assert (got.score, got.n_families, got.corroborated) == (pytest.approx(score), families, corroborated)
    assert rules.sum_scores(hits, "id").first().score == pytest.approx(plain_sum)


def test_thresholds(spark):
    fam = spark.createDataFrame(FAMILIES, "field string, family string, is_lab boolean")
    prox = spark.createDataFrame(PROXIES, "field string, components array<string>")
    own = [
        ("a", "fruit_veg_servings_day", "lt", 0.22), ("a", "vitamin_c_diet_signal", "eq", 0.20), ("a", "benchmark_diet_vitamin_c_status", "eq", 0.42), ("a", "enfermedad_frecuente", "eq", 0.16), ("a", "lab_vitamin_d_status", "eq", 0.9),
        ("b", "iron_loss_risk", "gte", 0.20), ("b", "iron_loss_risk", "gte", 0.15), ("b", "fatiga_general", "eq", 0.1), ("b", "fatiga_general", "in", 0.3),
    ]
    got = rules.thresholds(spark.createDataFrame(own, "cond string, field string, op string, weight double"), fam, prox, spark.createDataFrame([("a", 0.80), ("b", 0.60), ("c", 0.5)], "cond string, threshold double"))
    got = {r.cond: (r.family_max, r.sum_max, r.threshold) for r in got.collect()}
    assert got == {"a": (0.58, 1.0, 0.58), "b": (0.65, 0.65, 0.6), "c": (0.0, 0.0, 0.5)}


def test_predicates(spark):
    holds = lambda op, have, want: one(spark, rules.holds(F.lit(op), F.lit(have).cast("string"), F.lit(want)), c="")
    assert holds("gte", "5", "5")
    assert not holds("lte", "-1", "5")
    assert holds("eq", "-1", "-1")
    assert holds("in", "b", "a|b")
    assert not holds("lt", "x", "3")
    with pytest.raises(Exception, match="unknown operator"):
        holds("like", "a", "a")


def test_filled_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, " "), (2, "x"), (4, "d")], "k long, v string")
    got = {r.k: (r.v, r.status) for r in catalog.filled_merge(old, new, "k", ["v"]).collect()}
    assert got == {1: ("a", "unchanged"), 2: ("x", "updated"), 3: ("c", "unchanged"), 4: ("d", "added")}


def test_reject_reasons(spark):
    assert one(spark, catalog.reasons(a=F.col("x") > 1, b=F.col("x") > 5, c=F.col("x") > 2), x=3) == "a;c"
