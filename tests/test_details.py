"""Stated cases of smaller functions."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from siftspark.functions import scores as S
from siftspark.functions import text as X
from siftspark.operators import catalog, evaluation, features, ranking, survey


def column(spark, values, kind, f):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_bins(spark):
    assert column(spark, [17, 18, 30, 31, 50, 51, None], "int", lambda c: survey.bin_of(c, survey.AGE)) == ["menos_18", "18_30", "18_30", "31_50", "31_50", "mas_50", None]
    assert column(spark, [4.9, 5.0, 7.0, 9.0, 24.0, 25.0, None], "double", survey.sleep_bin) == ["menos_5h", "5_7h", "7_9h", "mas_9h", "mas_9h", None, None]
    assert column(spark, [0.0, 0.5, 7.0, 7.5], "double", lambda c: survey.bin_of(c, survey.ALCOHOL)) == ["nunca", "raro", "ocasional", "frecuente"]
    df = spark.createDataFrame([(1, 10.0, None), (2, None, 100.0), (3, 10.0, 40.0), (4, None, None)], "i int, w double, f double")
    assert [r.s for r in df.orderBy("i").select(survey.sun_bin(F.col("w"), F.col("f")).alias("s")).collect()] == ["menos_15min", "mas_1h", "15_30min", None]
    cases = {(1, 3, 1, 5): 5, (2, None, 2, None): 0, (1, 77, 2, None): None, (7, 3, 1, 5): None, (None, 1, 1, 5): None, (1, 9, 2, None): 7}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, a int, b int, c int, d int")
    assert [r.s for r in df.orderBy("i").select(survey.exercise_days(*map(F.col, "abcd")).alias("s")).collect()] == list(cases.values())
    df = spark.createDataFrame([(1, 2, 1), (4, 4, 4), (1, None, 1)], "a int, b int, c int")
    assert [r.s for r in df.select(survey.stress_bin(*map(F.col, "abc")).alias("s")).collect()] == ["moderado", "muy_alto", None]


def test_units_and_aliases(spark):
    df = spark.createDataFrame([(100.0, "Lbs."), (2.0, " stone"), (3.0, "ONZAS"), (500.0, "g"), (1.0, "mile"), (1.0, None)], "v double, u string")
    assert [r.k for r in df.select(survey.weight_in_kg(F.col("v"), F.col("u")).alias("k")).collect()] == [45.3592, 12.7006, 0.085, 0.5, None, None]
    assert column(spark, [["alergia_soya", "x", "x"], None, []], "array<string>", survey.with_aliases) == [["alergia_soya", "x", "soya"], [], []]


def test_context_keys_and_ages(spark):
    assert column(spark, [["b", " a ", "b", "SALUDABLE", "saludable", "", None, "d", "c"], [], None], "array<string>", lambda c: S.context_key(c, "SALUDABLE")) == ["a+b+d", "", ""]
    now = F.lit(datetime.datetime(2024, 1, 2, 0, 0))
    assert column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01 12:30:00", "2024-01-01", "soon", "", None], "string", lambda c: S.age_hours(c, now)) == [24.0, 26.0, 11.5, 24.0, None, None, None]


def test_reports_are_redacted(spark):
    texts = ["Paciente: Ana\nGlucosa 90\n  DNI 12345678\nllame al 987654321 o 12345678, a@b.com", "Drama\ndra. X\nFecha de nacimiento 1\nHC-1", None, "E-mail: a@b.com"]
    assert column(spark, texts, "string", X.redact_report) == ["[LINE]\nGlucosa 90\n[LINE]\nllame al [PHONE] o [ID], [EMAIL]", "Drama\n[LINE]\n[LINE]\n[LINE]", None, "[LINE]"]
    assert X.personal_columns(["source_case_id", "Nombre_completo", "iron", " Phone"]) == ["Nombre_completo", " Phone"]
    df = spark.createDataFrame([("a@b.com 999 999 999", "999999999", 999999999), ("no", None, 1)], "a string, b string, n long")
    assert [r.f for r in df.select(X.personal_values(["a", "b", "n", "source_case_id"], ("n",)).alias("f")).collect()] == [["a:email", "b:phone_like"], []]


def test_images(spark):
    html = "<img src='/x/logo.png'><img data-src=\"p/1.JPG?x=1\"><img src='http://facebook.com/f.png'><a href='z.png'></a> https://c.io/a.webp <img src='/no.gif'><img src='//d.io/q?format=png'>"
    df = spark.createDataFrame([(html, "https://s.pe/cat/p"), (None, "https://s.pe"), ("<p>", None)], "h string, b string")
    rows = df.select(X.image_urls(F.col("h"), F.col("b")).alias("u")).select("u", X.first_image(F.col("u")).alias("f")).collect()
    assert rows[0].u == ["https://s.pe/x/logo.png", "https://s.pe/p/1.JPG?x=1", "http://facebook.com/f.png", "https://d.io/q?format=png", "https://c.io/a.webp"]
    assert rows[0].f == "https://s.pe/p/1.JPG?x=1" and rows[1].f == rows[2].f == ""


def test_prepared_features(spark):
    df = spark.createDataFrame([(1, "low", None, 0.0, 4, 5), (2, "missing", "normal", None, None, 3)], "id int, lab_iron_status string, lab_zinc_status string, fish double, s1 int, s2 int")
    got = features.prepared(df, "id", ["fish", "meat"], ["lab_iron_status", "lab_zinc_status", "lab_tsh_status"], ["s1", "s2", "s3"]).orderBy("id").collect()
    assert [(r.fish_reported, r.meat_reported, r.diet_quantity_missing_count, r.lab_iron_observed, r.lab_zinc_age_days, r.lab_tsh_age_days, r.observed_lab_count, r.missing_lab_count, r.symptom_burden_score, r.high_symptom_count) for r in got] == [(1, 0, 1, 1, 999, 999, 1, 2, 3.0, 2), (0, 0, 2, 0, 30, 999, 1, 2, 1.0, 0)]


def test_candidates_and_cleaning(spark):
    rows = [(1, " ", "true_rs_component", "rs", "available", None), (2, "N1", "true_rs_component", "rs", "available", None), (3, "N1", "no_rs_match", "Name", "unknown", None), (4, "N1", None, None, None, "other"), (5, "N1", "true_rs_component", "rs", None, "manual_rejected")]
    df = spark.createDataFrame(rows, "id int, registro_sanitario string, component_traceable string, match_basis string, availability string, manual_status string")
    got = [(r.catalog_status, r.promotable, r.notes) for r in catalog.candidate_states(df).orderBy("id").collect()]
    assert got == [
        ("candidate_needs_rs", False, ["registration_missing", "component_traced"]), ("approved_verified", True, ["has_registration", "component_traced"]), ("candidate_name_match", False, ["has_registration", "matched_without_registration", "match_needs_explanation", "availability_not_ideal"]),
        ("approved_inferred", False, ["has_registration"]), ("manual_rejected", False, ["has_registration", "component_traced"]),
    ]
    rows = [(1, "R1", "Zinc plus", "ZINC", None), (2, "R1", "Iron", "IRON", None), (3, "R1", "Calcium", "X", None), (4, "R2", "Omega fish", "omega tres", None), (5, "R2", "Soap", "omega tres", "soap"), (6, "R3", "Magnesium", "omega tres", None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, rs string, name string, reg string, cat string")
    got = [r.reason for r in catalog.cleaning_reasons(df, "rs", "name", "reg", F.col("cat"), "id", 2).orderBy("id").collect()]
    assert got == ["fan_out:R1:ZINC:3", "fan_out:R1:ZINC:3", "fan_out:R1:ZINC:3", None, "category:soap", "name:omega tres", "name:"]


def test_paired_truth(spark):
    items = [(1, "tsh", "normal", 0), (1, "tsh", "high", 1), (1, "tsh", "low", 2), (1, "iron", "", 3), (2, "iron", "low", 0), (2, "hb", "normal", 1), (3, "iron", "high", 0), (4, "other", "low", 0)]
    found = evaluation.statuses(spark.createDataFrame(items, "k int, code string, status string, at int"), "k", "code", "status", ["at"])
    assert {(r.k, r.code): r.status for r in found.collect()} == {(1, "tsh"): "high", (2, "iron"): "low", (2, "hb"): "normal", (3, "iron"): "high", (4, "other"): "low"}
    targets = spark.createDataFrame([("anemia", "iron", ["low"]), ("anemia", "hb", ["low"]), ("thyroid", "tsh", ["low", "high"])], "condition string, code string, directions array<string>")
    truth = evaluation.lab_truth(found, "k", "code", targets)
    assert {(r.k, r.condition): r.truth for r in truth.collect()} == {(1, "thyroid"): True, (2, "anemia"): True, (3, "anemia"): False}
    said = spark.createDataFrame([(1, "m", "thyroid"), (3, "m", "anemia"), (2, "r", "anemia"), (4, "m", "anemia")], "k int, predictor string, condition string")
    got = {(r.condition, r.predictor): (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) for r in evaluation.paired(truth, said, "k").collect()}
    assert got == {("anemia", "m"): (0, 1, 1, 0, 0.0, 0.0), ("anemia", "r"): (1, 0, 0, 1, 1.0, 1.0), ("thyroid", "m"): (1, 0, 0, 0, 1.0, 1.0), ("thyroid", "r"): (0, 0, 1, 0, None, 0.0)}


def test_packs_are_reranked_and_counted(spark):
    pack = "array<struct<component: string, score: double, condition: string>>"
    packs = spark.createDataFrame([(1, 1, [("a", 0.9, "x"), ("b", None, "x")]), (1, 2, [("c", 0.5, "y"), ("d", 0.0, "soporte_funcional")]), (2, 1, [("a", 0.2, None)])], f"k int, pack_no int, items {pack}")
    useful = spark.createDataFrame([(1, ["x", "y", "SALUDABLE"]), (2, ["SALUDABLE"])], "k int, conditions array<string>")
    key = {r.pack_no: r.id for r in packs.filter("k = 1").select("pack_no", S.pack_key(F.transform("items", lambda x: x["component"])).alias("id")).collect()}
    stats = spark.createDataFrame([(key[2], 12, 1.0)], "pack_id string, n long, avg_score double")
    got = {(r.k, r.pack_id): r for r in ranking.reranked(packs, "k", "items", useful, stats).collect()}
    a, b = got[1, key[1]], got[1, key[2]]
    assert (a.score_gnn, a.score_coverage, a.score_feedback) == (pytest.approx(0.8), 0.5, 0.7)
    assert (b.score_gnn, b.score_coverage, b.feedback_count) == (pytest.approx(0.6), 0.5, 12) and b.score_feedback == pytest.approx((12 + 5.6) / 20)
    assert (a.rank, b.rank) == (1, 2) and [r.score_coverage for k, r in got.items() if k[0] == 2] == [1.0]
    events = spark.createDataFrame([("p", None, 1.0, 1), (None, ["b", "a"], 0.5, 2), (None, ["a", "b"], 1.0, 3), (None, [], 1.0, 4), ("p", None, None, 9)], "pack string, parts array<string>, s double, at int")
    n = {r.pack_id: (r.n, r.avg_score, r.avg_rating, r.last_feedback_at) for r in ranking.pack_stats(events, "pack", "parts", F.col("s"), "at").collect()}
    assert sorted(n.values()) == [(1, 1.0, 5.0, 1), (2, 0.75, 4.0, 3)]


def test_reasons_and_breakdown(spark):
    lit = {k: F.lit(v) for k, v in {"match": 0.9, "price": 0.7, "review": 0.8, "review_count": 0, "traceability": 0.9, "confidence": 0.1, "shop_diversity": 1.0, "product_exposure": 1.0, "shop_exposure": 0.5}.items()}
    df = spark.range(1)
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(S.selection_reasons(lit, F.array(F.lit("w1"), F.lit("w2"), F.lit("w3")), F.lit(False), F.lit(True), F.lit(True))) == ["w1", "w2", "good_match", "unit_component"]
    low = {k: F.lit(1.0 if "exposure" in k else 0.0) for k in lit}
    assert one(S.selection_reasons(low, F.lit(None).cast("array<string>"), F.lit(False), F.lit(False), F.lit(False))) == ["available"]
    parts = one(S.score_breakdown({k: F.lit(2.0) for k in S.BREAKDOWN}, F.lit(False), F.lit(0.1), F.lit(0.0)))
    assert (parts.component_match, parts.verified_reviews, parts.restriction_penalty) == (0.52, 0.03, -0.1)


def test_ablation(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "case int, condition string")
    without = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 2, "c"), ("r", 1, "a"), ("r", 1, "b"), ("r", 2, "a")], "question string, case int, condition string")
    qs = spark.createDataFrame([("q",), ("r",), ("s",)], "question string")
    got = {r.question: (r.cases_changed, r.share_changed, r.lost, r.gained) for r in evaluation.ablation(base, without, "question", "case", "condition", qs, 4).collect()}
    assert got == {"q": (2, 0.5, 1, 1), "r": (0, 0.0, 0, 0), "s": (2, 0.5, 3, 0)}


def test_entities(spark):
    import html

    texts = ["a &amp; b &lt;c&gt; &eacute;&ntilde; &copy;&middot;", "&#65;&#x42;&#x1F600; &#8364;", "&amp;lt; &nope; &; & &#xZZ; &apos;", "none", "", None, "&#0; &#xD800; end&"]
    got = column(spark, texts, "string", X.unescaped)
    assert got[:2] == [html.unescape(t) for t in texts[:2]]
    assert got[2:] == ["&lt; &nope; &; & &#xZZ; '", "none", "", None, "\ufffd \ufffd end&"]


def test_tables_of_pages(spark, tmp_path):
    from siftspark.sources import readers

    small, large = "<table><tr><td>x</td></tr></table>", "<TABLE class=a><thead><tr><th>Name<th>RS &amp; co</tr></thead><tr><td>Zinc <b>plus</b></td><td> </td></tr>\n<tr><td>Iron</td><td>N&eacute;1</td><td>more</td></tr></TABLE>"
    (tmp_path / "a.html").write_text(f"<html>{small}<p>{large}</html>")
    got = readers.read_table(spark, f"{tmp_path}/a.html")
    assert got.columns == ["Name", "RS & co"] and sorted(map(tuple, got.collect())) == [("Iron", "N\u00e91"), ("Zinc plus", None)]
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/a.html", ["RS & co", "none"]).filter("`RS & co` IS NOT NULL").collect()] == [("N\u00e91", None)]
    (tmp_path / "b.htm").write_text("<p>nothing</p>")
    with pytest.raises(ValueError, match="no table"):
        readers.read_table(spark, f"{tmp_path}/b.htm")


def test_searches_and_parser_reports(spark):
    df = spark.createDataFrame([("iron OR  ferrous", "fatigue", "deficiency_low"), ("iron AND zinc", "a OR b", None), ("", "x", "use"), (None, "x", "use")], "t string, o string, c string")
    got = [r.q for r in df.select(X.search_query(F.col("t"), F.col("o"), F.col("c"), "rct[pt]", "[ti]").alias("q")).collect()]
    assert got == ["(iron[ti] OR ferrous[ti]) AND (fatigue[tiab]) AND (supplement*[tiab] OR repletion[tiab] OR treatment[tiab]) AND rct[pt]", "(iron AND zinc) AND (a[tiab] OR b[tiab]) AND rct[pt]", None, None]
    original, parsed = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "a")], "k int, i string")
    assert tuple(evaluation.parser_report(original, parsed, "k", "i").select("total_products", "products_with_ingredient", "total_ingredients", "unique_ingredients", "coverage_rate").first()) == (3, 2, 3, 2, 0.6667)
    assert evaluation.parser_report(original.limit(0), parsed.limit(0), "k", "i").first().coverage_rate == 0.0
