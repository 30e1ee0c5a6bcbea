"""Ordered folds, name resolution and labels by rule, against plain versions."""

from __future__ import annotations

import itertools
import random

import pytest

from siftspark.operators import aliases, label_rules, labs, matching, recommend
from siftspark.plans.cases import BIOMARKERS


def report(spark, key, rows):
    """rows: (code, status, severity, confidence, original_unit, inferred, assumed)."""
    known = {c: (s, p) for c, s, p in BIOMARKERS}
    items = [(c, st, sev, conf, "mg", unit, inf, ass, *known.get(c, (None, None)), c in known) for c, st, sev, conf, unit, inf, ass in rows]
    return spark.createDataFrame([(key, items)], f"id int, items array<{labs.ITEM}>")


def plain_item(code, status="normal", severity="none", confidence=0.9):
    return (code, status, severity, confidence, None, None, None)


def one(df):
    return labs.analysed(df).first()


def test_a_signal_needs_review_by_what_came_before(spark):
    low, grave = plain_item("vitamin_d", "low"), plain_item("tsh", "high")
    first, second = one(report(spark, 1, [low, grave])), one(report(spark, 1, [grave, low]))
    assert [s.needs_review for s in first.signals] == [False] and [s.needs_review for s in second.signals] == [True]
    for r in (first, second):
        assert (r.level, r.blocked, r.actions) == ("medical_review_required", True, ["do_not_buy", "ask_a_professional"])
    assert one(report(spark, 1, [plain_item("ferritin", "low")])).signals[0].needs_review
    assert one(report(spark, 1, [plain_item("vitamin_d", "critical_low")])).signals[0].needs_review


def test_levels_warnings_and_anemia(spark):
    assert one(report(spark, 1, [plain_item("iron")])).level == "normal"
    doubtful = one(report(spark, 1, [plain_item("iron", confidence=0.5), plain_item("iron", confidence=0.5)]))
    assert (doubtful.level, doubtful.warnings, doubtful.actions) == ("caution", ["iron:doubtful"], ["confirm_first"])
    assert one(report(spark, 1, [plain_item("iron", confidence=0.0)])).warnings == []
    units = one(report(spark, 1, [("iron", "normal", "none", None, "g", True, True), ("calcium", "normal", "none", None, "g", False, True), ("calcium", "normal", "none", None, None, False, True)]))
    assert units.warnings == ["iron:unit_inferred", "calcium:unit_assumed"]
    anemia = one(report(spark, 1, [plain_item("ferritin", "low"), plain_item("hematocrit", "critical_low")]))
    assert anemia.blocked and anemia.level == "medical_review_required" and anemia.warnings[-1] == "anemia_pattern"
    later = one(report(spark, 1, [plain_item("ferritin", "low"), plain_item("hemoglobin", "low"), plain_item("hemoglobin", "normal")]))
    assert not later.blocked  # the last item of a code counts
    critical = one(report(spark, 1, [plain_item("iron", "high", "critical")]))
    assert critical.warnings == ["iron:critical"] and critical.blocked
    unknown = one(report(spark, 1, [plain_item("other", "critical_low", "critical", 0.1)]))
    assert (unknown.level, unknown.blocked, unknown.warnings) == ("normal", False, [])
    none = [labs.analysed(spark.createDataFrame([(1, x)], f"id int, items array<{labs.ITEM}>")).first() for x in ([], None)]
    assert all((r.level, r.warnings, r.actions) == ("caution", ["no_biomarkers"], []) for r in none)


def names_of(rng, n):
    words = ["VITAMINA", "C", "D3", "ACIDO", "FOLICO", "DE", "HIERRO", "B12", "OMEGA", "3", "MAGNESIO"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def test_trie_and_joins_find_the_longest_alias(spark):
    rng = random.Random(1)
    keys, names = sorted(set(names_of(rng, 60))), sorted(set(names_of(rng, 200)))
    inside = {n: min([k for k in keys if f" {k} " in f" {n} "], key=lambda k: (-len(k), k), default=None) for n in names}
    trie = aliases.AliasTrie(keys)
    assert {n: trie.longest(n) for n in names} == inside
    df, al = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "key string")
    want = {(n, k) for n, k in inside.items() if k}
    for way in (aliases.contained_by_trie, aliases.contained_by_join):
        assert {tuple(r) for r in way(df, "name", al).collect()} == want


ALIASES = [
    ("Vitamina C", "c1", "manual_alias", 0, "Ascorbic"), ("vitamina c", "c9", "knowledge_alias", 1, "Ascorbic"), ("Hierro", "c2", "exact_translated", 2, "Iron"), ("Iron", "c2", "exact_master", 3, "Iron"), ("Vitamina", "c4", "manual_alias", 4, "x"),
    ("Piridoxina", "c5", "exact_translated", 5, "Vitamin B6"), ("Zinc", "c6", "exact_master", 6, "Copper"), ("DE", "c7", "manual_alias", 7, "x"), ("Magnesio", None, "manual_alias", 8, "x"), ("Omega", "c8", "other_source", 9, "x"),
]


@pytest.mark.parametrize("trie_aliases", [100, 0])
def test_precedence(spark, trie_aliases):
    table = aliases.alias_table(spark.createDataFrame(ALIASES, "alias string, target string, method string, place int, canonical string"))
    cases = [
        ("VITAMINA  c (ácido)", None, "c1", "manual_alias", 100.0), ("Selenio de cromo", None, "p", "nutrient_pattern", 99.0), ("Clorhidrato de vitamina C 500", None, "c1", "manual_alias", 100.0), ("polvo", "sal de VITAMINA C", "c1", "manual_alias", 100.0),
        ("hierro", None, "c2", "contains_alias", 90.0), ("IRON", None, "c2", "exact_master", 95.0), ("zinc", None, "", "unmapped", 0.0), ("sal de vitamina C y hierro", None, "c1", "contains_alias", 90.0), ("la piridoxina pura", None, "c5", "contains_alias", 90.0),
        ("de", None, "c7", "manual_alias", 100.0), ("polvo de arroz", None, "", "unmapped", 0.0), ("magnesio", None, "", "unmapped", 0.0), ("omega", None, "", "unmapped", 0.0), (None, None, "", "unmapped", 0.0), ("", None, "", "unmapped", 0.0), ("hierro", None, "c2", "contains_alias", 90.0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "id int, name string, salt string")
    got = aliases.resolved(df, "name", table, [(r"\bCROMO\b", "p")], ("CLORHIDRATO", "DE", "SAL"), "salt", trie_aliases)
    assert {r.id: (r.target, r.method, r.score) for r in got.collect()} == {i: tuple(c[2:]) for i, c in enumerate(cases)}


def plain_find(q, names):
    from siftspark.functions.text import ACCENTED, PLAIN

    clean = lambda s: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower().translate(str.maketrans(ACCENTED, PLAIN))).split())
    q, names = clean(q), [(clean(n), t) for n, t in names if n is not None]
    words = [w for w in q.split() if len(w) >= 3]
    for tier, test in enumerate((lambda n: n == q, lambda n: q in n, lambda n: words and all(w in n for w in words)), 1):
        hit = [t for n, t in names if test(n)]
        if q and hit:
            return hit[0], tier
    return None, None


@pytest.mark.parametrize("part", [1000, 3])
def test_find_names_is_a_nested_loop(spark, monkeypatch, part):
    monkeypatch.setattr(matching, "GRAM_PART", part)
    rng = random.Random(2)
    names = [("".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 9))), i) for i in range(120)] + [(None, 500), ("Vitamina C (ácido ascórbico)", 501), ("ácido fólico", 502), ("x", 503)]
    asked = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 6))) for _ in range(150)] + [None, "", "ascorbico acido", "fol", "CIDO", "acido zzz", "x", "no", "vitamina c acido ascorbico"]
    q = spark.createDataFrame(list(enumerate(asked)), "id int, asked string")
    n = spark.createDataFrame([(a, b, b) for a, b in names], "name string, target int, place int")
    got = {r.id: (r.target, r.tier) for r in matching.find_names(q, "asked", n, "name", "target", "place").collect()}
    assert got == {i: plain_find(a, names) for i, a in enumerate(asked)}


def plain_seeds(conditions, seeds, taken):
    taken, out = set(taken), []
    for _, w, _, cond in sorted((-(p or 0.6), p or 0.6, place, c) for c, p, place, covered in conditions if not covered):
        free = next((s for s in seeds.get(cond, []) if s is not None and s not in taken), None)
        if free:
            taken.add(free)
            out.append((cond, free, round(w * 0.58, 4)))
    return out


def test_seeds_depend_on_the_order_of_conditions(spark):
    seeds = {"a": ["x", "y"], "b": [None, "x"], "c": ["x", "y", "z"], "d": [None]}
    rows = [(c, s, i) for c, own in seeds.items() for i, s in enumerate(own)]
    sd = spark.createDataFrame(rows, "condition string, component string, place int")
    cases = {1: [("a", 0.9, 0, False), ("b", 0.5, 1, False)], 2: [("a", 0.5, 0, False), ("b", 0.9, 1, False)], 3: [("c", None, 0, False), ("b", 0.0, 1, None), ("a", None, 2, False)], 4: [("a", 0.9, 0, True), ("d", 0.9, 1, False)], 5: [("c", 0.7, 0, False)]}
    taken = {5: ["x", "y"], 3: ["y"]}
    df = spark.createDataFrame([(k, *c) for k, own in cases.items() for c in own], "key int, condition string, probability double, place int, covered boolean")
    ch = spark.createDataFrame([(k, c) for k, own in taken.items() for c in own], "key int, component string")
    got = recommend.seed_fallback(df, "key", sd, ch).orderBy("key", "place").collect()
    want = [(k, *r, i + 1) for k, own in cases.items() for i, r in enumerate(plain_seeds(own, seeds, taken.get(k, [])))]
    assert [tuple(r) for r in got] == want
    assert [r[1:3] for r in want if r[0] == 1] == [("a", "x")] and [r[1:3] for r in want if r[0] == 2] == [("b", "x"), ("a", "y")]


def interpreted(case, c):
    """A condition's label by walking its rules."""
    value = lambda f: case.get(f) or "missing"
    ok = lambda f, test: value(f) not in label_rules.STATUSES["abnormal"] if test == "clear" else value(f) in label_rules.STATUSES[test]
    for r in c.rules:
        if all(sum(ok(*t) for t in tests) >= need for need, tests in r.clauses):
            fields = [f for f, test in dict.fromkeys(t for _, tests in r.clauses for t in tests) if test not in ("missing", "clear") and ok(f, test)]
            return r.state, r.source, r.confidence, list(dict.fromkeys(fields))
    return "unknown", c.otherwise, 0.0, list(c.fields)


def test_labels_are_interpreted_rules(spark):
    fields = sorted({r[7] for r in label_rules.rule_rows()})
    rng = random.Random(3)
    statuses = ["low", "critical_low", "normal", "normal", "high", "critical_high", "missing", None, "not_labelable"]
    cases = [{f: rng.choice(statuses) for f in fields} for _ in range(150)]
    iron = list(itertools.product(statuses, repeat=2))
    cases += [{"lab_ferritin_status": a, "lab_hemoglobin_status": b} for a, b in iron]
    df = spark.createDataFrame([(i, *[c.get(f) for f in fields]) for i, c in enumerate(cases)], "id int, " + ", ".join(f"{f} string" for f in fields))
    got = {(r.id, r.condition): (r.state, r.label_source, r.confidence, r.evidence_fields) for r in label_rules.labels(df, "id").collect()}
    assert got == {(i, c.name): interpreted(case, c) for i, case in enumerate(cases) for c in label_rules.CONDITIONS}
    assert len(label_rules.CONDITIONS) >= 12 and {v[0] for v in got.values()} == {"positive", "negative", "unknown"}


def test_labels_of_stated_cases(spark):
    df = spark.createDataFrame([(1, None, "low", "high", "normal", "low"), (2, "normal", "normal", "normal", "normal", "normal"), (3, "high", "normal", "low", None, "missing")], "id int, lab_ferritin_status string, lab_hemoglobin_status string, lab_ldl_status string, lab_b12_status string, benchmark_diet_b12_status string")
    got = {(r.id, r.condition): (r.state, r.evidence_group, r.confidence) for r in label_rules.labels(df, "id").collect()}
    assert got[1, "DEFICIT_HIERRO"] == ("positive", "surrogate", 0.65)
    assert got[2, "DEFICIT_HIERRO"] == ("negative", "lab_only", 0.9)
    assert got[3, "DEFICIT_HIERRO"] == ("unknown", "unknown", 0.0)
    assert got[1, "RIESGO_DISLIPIDEMIA"] == ("positive", "lab_only", 0.9)
    assert got[1, "DEFICIT_B12"] == ("negative", "lab_only", 0.9)
    assert got[3, "DEFICIT_B12"] == ("unknown", "unknown", 0.0)
    assert got[2, "SAFETY_RENAL"][0] == "unknown"


def test_a_profile_is_as_grave_as_its_gravest_part(spark):
    from siftspark.operators import safety

    fields = "id int, age_years int, edad_rango string, condiciones_seguridad array<string>, restricciones array<string>, suplementos_actuales array<string>, sleep_quality string, night_wakeups string, horas_sueno string, lab_level string"
    rows = [
        (1, None, None, None, None, None, None, None, None, None),
        (2, 17, None, [], [], [], None, None, None, None),
        (3, 30, "menos_18", [], [], [], None, None, None, None),
        (4, None, "menos_18", [], [], [], None, None, None, "normal"),
        (5, 40, None, ["hipertension", "hipertension", "otra"], ["sin_gluten", "vegano"], ["zinc"], "mala", None, None, None),
        (6, 40, None, ["embarazo_lactancia"], [], [], None, "3_o_mas", None, "caution"),
        (7, 40, None, [], [], [], None, None, "menos_5h", "medical_review_required"),
        (8, 40, None, [], [], [], None, None, None, "caution"),
    ]
    got = {r.id: (r.safety_level, r.survey_level, r.warnings, len(r.actions)) for r in safety.profile_safety(spark.createDataFrame(rows, fields), "id").collect()}
    review = "medical_review_required"
    assert got == {
        1: ("normal", "normal", [], 0), 2: (review, review, ["menor_de_edad"], 3), 3: ("normal", "normal", [], 0), 4: (review, review, ["menor_de_edad"], 3),
        5: ("caution", "caution", ["suplementos_actuales", "hipertension", "insomnio", "sin_gluten"], 2), 6: (review, review, ["embarazo_lactancia", "insomnio"], 3), 7: (review, "normal", ["insomnio"], 0), 8: ("caution", "normal", [], 0),
    }


def test_selection_respects_blocks_and_limits(spark):
    from siftspark.operators import ranking

    rows = [(1, 1, 10, 1, 0.9, False), (1, 1, 11, 1, 0.8, True), (1, 1, 12, 2, 0.7, None), (1, 1, 13, 1, 0.69, False), (1, 2, 10, 1, 0.9, False), (1, 2, 14, 1, 0.70, False), (1, 2, 15, 3, 0.68, False), (2, 1, 11, 1, 0.8, True)]
    df = spark.createDataFrame(rows, "pack int, slot int, product int, shop int, score double, blocked boolean")
    got = sorted((r.slot, r["product"]) for r in ranking.greedy_selection(df, "pack", "slot", "product", "shop", "score", per_slot=2, blocked="blocked").collect())
    assert got == [(1, 10), (1, 12), (2, 14), (2, 15)]
    one = sorted((r.slot, r["product"]) for r in ranking.greedy_selection(df, "pack", "slot", "product", "shop", "score", shop_weight=0.5, blocked="blocked").collect())
    assert one == [(1, 10), (2, 15)]  # the shop of the first slot counts less in the second


def test_a_taken_supplement_suppresses_unless_a_laboratory_says_so(spark):
    from pyspark.sql import functions as F

    from siftspark.operators import rules

    rows = [(0.9, 0.0, True, False, []), (0.9, 0.0, True, False, ["zinc", "iron"]), (0.9, 0.0, True, True, ["iron"]), (0.9, 0.0, False, False, []), (0.1, 0.6, True, False, []), (0.1, 0.6, False, False, []), (0.31, 0.0, True, False, [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, p double, s double, ok boolean, lab boolean, taken array<string>")
    d = rules.decision(F.col("p"), F.col("s"), F.lit(0.5), F.lit(0.2), F.col("ok"), F.col("lab"), F.col("taken"))
    got = [tuple(r) for r in df.select("id", d.alias("d")).orderBy("id").select("d.*").collect()]
    assert got == [(0.9, True, None, "model"), (0.9, False, "iron", "model"), (0.9, True, None, "model"), (0.9, False, None, "model"), (0.42, True, None, "model+rules"), (0.1, False, None, "model"), (0.31, True, None, "model")]


def test_accents_of_whole_texts(spark, sf_dir):
    import unicodedata

    from siftspark.plans import registry

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for i, t in docs.items()}
    assert {r.doc_id: r.plain for r in registry.QUERIES["x4_without_accents"](spark, sf_dir).collect()} == want


def test_thresholds_follow_from_rules_that_nobody_meets(spark):
    from siftspark.operators import rules

    r = spark.createDataFrame([("a", "x", "eq", 0.6), ("a", "y", "eq", 0.3)], "cond string, field string, op string, weight double")
    f = spark.createDataFrame([], "field string, family string, is_lab boolean")
    p = spark.createDataFrame([], "field string, components array<string>")
    got = rules.thresholds(r, f, p, spark.createDataFrame([("a", 0.95), ("b", 0.2)], "cond string, threshold double")).collect()
    assert {x.cond: x.threshold for x in got} == {"a": 0.95, "b": 0.2}
