"""More queries: features, safety, extraction, fallbacks, metrics, upkeep, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.functions import scores as S
from siftspark.functions import text as X
from siftspark.operators import catalog, evaluation, extraction, features, models, multilabel, ranking, rules, safety
from siftspark.plans.analytics import _HITS, BASE, FIELDS, _fold, _hits, _rows
from siftspark.plans.core import query

_SAFE = [("metal", "BRASS|STEEL", None, "warn", "low", None), ("promo", "^PROMO", "small", "block", "high", 10.0), ("economy", "ECONOMY", None, "penalize", "high", None), ("standard", "STANDARD", "large", "penalize", "low", None)]
_SAFE_SQL = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _SAFE)


@query(f"""WITH r(name, pattern, restriction, action, severity, lim) AS (VALUES {_SAFE_SQL}), h AS (SELECT p_partkey, name, severity, CASE WHEN action = 'block' AND lim IS NOT NULL AND p_retailprice / 100 < lim THEN 'penalize' ELSE action END AS a
  FROM part LEFT JOIN r ON regexp_matches(p_type, pattern) AND (restriction IS NULL OR restriction = CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END))
SELECT p_partkey, round(least(0.80, sum(CASE a WHEN 'penalize' THEN CASE WHEN severity = 'high' THEN 0.25 ELSE 0.12 END WHEN 'warn' THEN 0.05 ELSE 0 END)), 4)::DOUBLE AS penalty, bool_or(coalesce(a = 'block', false)) AS blocked,
  coalesce(list(name ORDER BY name) FILTER (WHERE name IS NOT NULL), []) AS rules FROM h GROUP BY 1""")
def d21_safety_rules(t):
    p = t("part").select("p_partkey", "p_type", F.array(F.when(F.col("p_size") < 20, "small").otherwise("large")).alias("have"), (F.col("p_retailprice") / 100).alias("dose"))
    r = p.sparkSession.createDataFrame(_SAFE, "name string, pattern string, restriction string, action string, severity string, dose_limit double")
    return safety.safety_penalties(p, r, "p_partkey", "p_type", "have", "dose")


@query("""SELECT c_custkey, round(least(0.05, 0.02 * len(list_intersect(['a', 'b', 'c'], h))) - least(0.70, 0.35 * len(list_intersect(['x', 'y'], h))), 4)::DOUBLE AS adjustment
  FROM (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'a' END, CASE WHEN c_custkey % 3 = 0 THEN 'b' END, CASE WHEN c_custkey % 5 = 0 THEN 'x' END, CASE WHEN c_custkey % 7 = 0 THEN 'y' END], lambda v: v IS NOT NULL) AS h FROM customer)""")
def d23_restriction_adjustment(t):
    k = F.col("c_custkey")
    have = F.array_compact(F.array(*[F.when(k % m == 0, v) for m, v in ((2, "a"), (3, "b"), (5, "x"), (7, "y"))]))
    names = lambda *v: F.array(*map(F.lit, v))
    return t("customer").select("c_custkey", F.round(safety.restriction_adjustment(names("a", "b", "c"), have, names("x", "y")), 4).alias("adjustment"))


_COMP = "(p_name || ' ' || p_size || ' mg, Zinc (sulfate) ' || (p_size * 2) || ' mcg, Vitamin D ' || (p_size * 100) || ' IU')"


@query("""WITH p AS (SELECT p_partkey, upper(p_name) AS n, p_size AS z, p_partkey % 4 AS k FROM part), x AS (
SELECT p_partkey, 0 AS place, n AS ingredient, NULL AS salt_form, z::DOUBLE AS amount, 'mg' AS unit, z::DOUBLE AS amount_mg FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 1, 'VITAMINA D3', NULL, 2000 + z, 'ui', NULL FROM p WHERE k = 0
UNION ALL SELECT p_partkey, 0, n, 'COMO SULFATO DE ZINC', z + 0.5, 'g', (z + 0.5) * 1000 FROM p WHERE k = 1
UNION ALL SELECT p_partkey, 0, n || ' (EPA)', 'EQUIVALENTE A ' || z || ' MG DE SAL', z * 1000, 'mcg', z * 1000 * 0.001 FROM p WHERE k = 2
UNION ALL SELECT p_partkey, 1, 'OMEGA 3', NULL, 500, 'mg', 500 FROM p WHERE k = 2
UNION ALL SELECT p_partkey, 0, 'LACTOBACILLUS', NULL, z * 1e6, 'UFC', NULL FROM p WHERE k = 3
UNION ALL SELECT p_partkey, 1, n, NULL, 1000.5, 'kg', NULL FROM p WHERE k = 3)
SELECT p_partkey, place::INT AS place, ingredient, salt_form, amount::DOUBLE AS amount, unit, round(amount_mg, 6)::DOUBLE AS amount_mg FROM x""")
def x1_compositions(t):
    """Names and sizes of the parts in the shapes that compositions take."""
    n, z, k = F.col("p_name"), F.col("p_size"), F.col("p_partkey") % 4
    c = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    d = lambda x: x.cast("string")
    text = (
        F.when(k == 0, c("POR DOSIS 15.00 mL - ", n, " ", d(z), ".000000 mg VITAMINA D3 ", F.format_string("%,d", z + 2000), ".000000 UI"))
        .when(k == 1, c(n, " (COMO SULFATO DE ZINC) ", d(z), ",5 g"))
        .when(k == 2, c(n, " (EPA) ", d(z), " 000 mcg (equivalente a ", d(z), " mg de sal) OMEGA 3 500 mg"))
        .otherwise(c("Lactobacillus ", d(z), " x 10^6 CFU, ", n, " 1.000,5 kg"))
    )
    return extraction.compositions(t("part").select("p_partkey", text.alias("text")), "text", ["p_partkey"]).withColumn("amount_mg", F.round("amount_mg", 6))


@query("""WITH c AS (SELECT c_custkey, c_nationkey * 10 + 1 AS g, c_custkey % 9 + 1 AS h, c_custkey % 4 AS k FROM customer)
SELECT c_custkey, 'glucose' AS code, g::DOUBLE AS value, 'mg/dL' AS unit, CASE WHEN k IN (0, 2) THEN 70 END::DOUBLE AS low, CASE WHEN k < 3 THEN 100 END::DOUBLE AS high, k = 2 AS next_line FROM c
UNION ALL SELECT c_custkey, 'calcium', h + 0.5, 'mg/dL', CASE WHEN k = 1 THEN 2 WHEN k <> 3 THEN 8.5 END, CASE WHEN k <> 1 AND k <> 3 THEN 10.5 END, false FROM c""")
def x2_lab_lines(t):
    """Reports of customers' numbers: a range on the line, one-sided ones, a vertical block, none."""
    g, h, k = (F.col("c_nationkey") * 10 + 1).cast("string"), (F.col("c_custkey") % 9 + 1).cast("string"), F.col("c_custkey") % 4
    lit = F.lit
    glucose = (
        F.when(k == 0, F.concat(lit("Glucosa en Ayunas: "), g, lit(" mg / dl 70 - 100")))
        .when(k == 1, F.concat(lit("GLUCOSA "), g, lit(" mg/dl (VN < 100)")))
        .when(k == 2, F.concat(lit("Glucosa\nResultado: "), g, lit(" mg/dL\nReferencia 70 a 100")))
        .otherwise(F.concat(lit("Glucosa|"), g, lit(" mg/dl")))
    )
    calcium = F.concat(lit("Calcio "), h, lit(",5 mg/dl"), F.when(k == 1, " > 2").when(k == 3, "").otherwise(" 8,5 hasta 10,5"))
    text = F.concat(glucose, lit("\n\n"), calcium, lit("\nCalcio 99 mg/dl"))
    c = t("customer").select("c_custkey", "c_nationkey")
    c = c.repartition(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # a small file is one split, reports are long work
    aliases = c.sparkSession.createDataFrame([("glucosa", "glucose"), ("glucosa en ayunas", "glucose"), ("calcio", "calcium")], "alias string, code string")
    return extraction.lab_values(c.select("c_custkey", text.alias("text")), "text", ["c_custkey"], aliases).drop("confidence")


@query("""SELECT p_partkey, round(p_size * CASE p_partkey % 5 WHEN 0 THEN 0.000025 WHEN 1 THEN 0.67 WHEN 2 THEN 0.45 WHEN 3 THEN 0.0003 ELSE 1000 END, 8)::DOUBLE AS mg FROM part""")
def f12_milligrams(t):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "Colecalciferol").when(k == 1, "Vitamina E").when(k == 2, "Vitamina E dl-alfa").when(k == 3, "Retinol").otherwise(F.col("p_name"))
    mg = extraction.in_milligrams(F.col("p_size").cast("double"), F.when(k == 4, "g").otherwise("UI"), name)
    return t("part").select("p_partkey", F.round(mg, 8).alias("mg"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 100 END::DOUBLE AS amount, CASE WHEN p_partkey % 2 = 0 THEN 'mcg' ELSE 'mg' END AS unit, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE NULL END AS declared_mcg, p_size AS units FROM part""")
def f13_doses_in_names(t):
    """An amount near a word, the declared dose of an ingredient, and the pack's size, out of names made of the parts' fields."""
    even = F.col("p_partkey") % 2 == 0
    size = F.col("p_size").cast("string")
    name = F.concat(F.lit("Frasco 100 mg "), F.lit("." * 60), F.when(even, F.lit(" magnesio ")).otherwise(F.lit(" otro ")), size, F.lit(" mcg"), F.lit(" " * 50), F.lit("x "), size, F.lit(" tabletas"))
    p = t("part").select("p_partkey", name.alias("name"))
    near, pack = extraction.amount_near(F.col("name"), F.array(F.lit("Magnesio"))), extraction.pack_size(F.col("name"))
    return p.select("p_partkey", near["amount"].alias("amount"), near["unit"].alias("unit"), extraction.declared_micrograms(F.col("name"), "magnesio").alias("declared_mcg"), pack["units"].alias("units"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'blue%' THEN 'blue' WHEN p_name LIKE 'red%' THEN 'red' WHEN split_part(p_name, ' ', 1) <> 'green' THEN split_part(p_name, ' ', 1) ELSE '' END AS brand,
  CASE WHEN p_name LIKE 'blue%' OR p_name LIKE 'red%' THEN 'high' WHEN split_part(p_name, ' ', 1) <> 'green' THEN 'medium' END AS brand_confidence FROM part""")
def f14_brands(t):
    p = t("part")
    brands = p.sparkSession.createDataFrame([("blue",), ("red",)], "brand string")
    return extraction.brand_of(p.select("p_partkey", "p_name"), "p_name", brands, ("green",)).drop("p_name")


@query("""SELECT c_custkey, round(CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal * 18 ELSE c_acctbal END, 6) AS value, 'mg/dL' AS unit, CASE WHEN c_nationkey % 3 = 0 THEN 72 ELSE 4 END::DOUBLE AS low, c_nationkey % 3 = 0 AS converted, c_nationkey % 3 = 2 AS unit_assumed FROM customer""")
def m16_canonical_units(t):
    c = t("customer")
    unit = F.when(F.col("c_nationkey") % 3 == 0, "mmol/L").when(F.col("c_nationkey") % 3 == 1, "mg/dl")
    v = c.select("c_custkey", F.lit("glucose").alias("code"), F.col("c_acctbal").alias("value"), unit.alias("unit"), F.lit(4.0).alias("low"), F.lit(None).cast("double").alias("high"))
    d = c.sparkSession.createDataFrame([("glucose", "mg/dL")], "code string, canonical string")
    k = c.sparkSession.createDataFrame([("glucose", "mmol/l", 18.0)], "code string, from_unit string, factor double")
    return extraction.in_canonical_unit(v, d, k).select("c_custkey", "value", "unit", "low", "converted", "unit_assumed")


@query("""SELECT p_partkey, round(least(0.96, greatest(0.35, 0.62 + CASE WHEN length(p_name) >= 10 THEN 0.12 WHEN length(p_name) >= 6 THEN 0.08 ELSE -0.08 END + CASE WHEN p_size > 10 THEN 0.08 ELSE -0.08 END
  + CASE WHEN p_size > 20 THEN 0.08 ELSE 0 END - CASE WHEN p_size > 45 THEN 0.08 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 0.03 ELSE 0 END)), 4)::DOUBLE AS confidence FROM part""")
def m15_confidence(t):
    s = F.col("p_size")
    return t("part").select("p_partkey", F.round(extraction.confidence(F.length("p_name"), s > 10, s > 20, s > 45, F.col("p_partkey") % 2 == 0), 4).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'mmol' WHEN p_size BETWEEN 21 AND 50 THEN 'mg' END AS unit FROM part")
def m17_unit_inference(t):
    return t("part").select("p_partkey", extraction.alternative_unit(F.col("p_size"), {"mmol": (1, 20), "g": (10, 20), "mg": (21, 50)}).alias("unit"))


@query("""SELECT c_custkey, coalesce(c_mktsegment, 'missing') AS c_mktsegment, 'missing' AS diet, coalesce(nullif(c_nationkey, 3), -1)::DOUBLE AS nation, -1.0::DOUBLE AS sleep, (c_nationkey <> 3)::INT AS nation_reported, 0 AS sleep_reported FROM customer""")
def d7_feature_contract(t):
    c = t("customer").withColumn("nation", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")))
    return features.contract(c, "c_custkey", ["c_mktsegment", "diet"], ["nation", "sleep"])


@query("""SELECT p_partkey, coalesce(list_position(['SMALL', 'MEDIUM', 'LARGE'], split_part(p_type, ' ', 1)), 0)::INT - 1 AS size_order, round(((p_size > 10)::INT * p_size + 3) / ((p_size > 10)::INT + 1), 3)::DOUBLE AS burden FROM part""")
def d6_derived_signals(t):
    b = features.burden([F.when(F.col("p_size") > 10, F.col("p_size").cast("double")), F.lit(3.0), F.lit(-1.0)])
    return t("part").select("p_partkey", features.ordinal(F.split("p_type", " ")[0], ["SMALL", "MEDIUM", "LARGE"]).alias("size_order"), b.alias("burden"))


@query("""WITH m(cond, field, w) AS (VALUES ('a', 'x', 0.4), ('a', 'y', 0.3), ('b', 'z', 0.2)) SELECT o_orderpriority, cond, count(*) AS n, round(sum(w * (o_orderkey % 3)::INT), 3)::DOUBLE AS total FROM orders, m WHERE (field = 'x' AND o_orderstatus = 'F') OR (field = 'y' AND o_totalprice > 200000) OR (field = 'z' AND o_orderkey % 2 = 0) GROUP BY 1, 2""")
def d10_signal_groups(t):
    o = t("orders")
    hits = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("a").alias("cond"), F.lit(0.4).alias("w"))), F.when(F.col("o_totalprice") > 200000, F.struct(F.lit("a").alias("cond"), F.lit(0.3).alias("w"))), F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit("b").alias("cond"), F.lit(0.2).alias("w")))))
    e = o.select("o_orderpriority", "o_orderkey", F.explode(hits).alias("h"))
    return e.groupBy("o_orderpriority", F.col("h.cond").alias("cond")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("h.w") * (F.col("o_orderkey") % 3)), 3).alias("total"))


@query("""WITH p AS (SELECT c_custkey, c_nationkey, abs(c_acctbal) / 10000 AS p FROM customer) SELECT c_custkey, CASE WHEN p >= 0.5 THEN 'positive' WHEN p >= 0.35 AND c_nationkey < 5 THEN 'complementary' WHEN p >= 0.35 THEN 'borderline' ELSE 'negative' END AS opinion FROM p""")
def d11_second_opinion(t):
    p = F.abs("c_acctbal") / 10000
    return t("customer").select("c_custkey", F.when(p >= 0.5, "positive").when((p >= 0.35) & (F.col("c_nationkey") < 5), "complementary").when(p >= 0.35, "borderline").otherwise("negative").alias("opinion"))


@query("""WITH v AS (SELECT l_orderkey, avg(l_quantity / 50) AS model, count(DISTINCT l_suppkey) / count(*) AS diversity, avg((l_returnflag = 'A')::INT) AS feedback, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(0.30 * model + 0.20 * least(1, n / 7) + 0.15 * 1.0 + 0.15 * (n * feedback + 8 * 0.7) / (n + 8) + 0.10 * 0.7 + 0.05 * greatest(0.25, 1 - 3 * n / 1000) + 0.05 * diversity, 9)::DOUBLE AS score FROM v""")
def d18_pack_metrics(t):
    v = t("lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_quantity") / 50).alias("model"), F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "A").cast("int")).alias("feedback"), F.size(F.collect_set("l_suppkey")).alias("k"))
    n = F.col("n")
    score = 0.30 * F.col("model") + 0.20 * F.least(F.lit(1.0), n / 7) + 0.15 + 0.15 * S.bayesian_mean(n, F.col("feedback")) + 0.10 * 0.7 + 0.05 * S.exposure(n / 1000) + 0.05 * (F.col("k") / n)
    return v.select("l_orderkey", F.round(score, 9).alias("score"))


@query("""WITH m AS (SELECT p_partkey, p_size / 50.0 AS a, (p_partkey % 10) / 10.0 AS b, (p_partkey % 7) / 6.0 AS c, p_size % 5 AS n, p_type = 'PROMO' AS pref, p_size % 2 = 0 AS unit, p_partkey % 3 = 0 AS budget, CASE WHEN p_size % 6 = 0 THEN ['w1', 'w2', 'w3'] ELSE [] END AS w FROM part),
f AS (SELECT *, w[1:2] || list_filter([CASE WHEN pref THEN 'preferred' END, CASE WHEN a >= 0.85 THEN 'good_match' END, CASE WHEN unit THEN 'unit_component' ELSE 'several_components' END, CASE WHEN b >= 0.70 THEN 'best_price' END, CASE WHEN c >= 0.75 AND n > 0 THEN 'best_rated' END, CASE WHEN a >= 0.85 THEN 'traceable' END, CASE WHEN b >= 0.85 THEN 'reliable' END, CASE WHEN c >= 0.90 THEN 'other_shop' END, CASE WHEN a < 0.85 OR b < 0.85 THEN 'shown_often' END], lambda x: x IS NOT NULL) AS r FROM m)
SELECT p_partkey, array_to_string(r[1:4], ' ') AS reasons, round((CASE WHEN budget THEN 0.24 ELSE 0.26 END * a)::DECIMAL(18, 9), 4)::DOUBLE AS component_match, round((CASE WHEN budget THEN 0.24 ELSE 0.16 END * (b + c) / 2)::DECIMAL(18, 9), 4)::DOUBLE AS price_stock, round((CASE WHEN budget THEN 0.02 ELSE 0.03 END * least(1, 2 * b))::DECIMAL(18, 9), 4)::DOUBLE AS verified_reviews, round(-c::DECIMAL(18, 9), 4)::DOUBLE AS restriction_penalty FROM f""")
def d24_selection_reasons(t):
    """Parts as products: reasons and the parts of the score."""
    s, k = F.col("p_size"), F.col("p_partkey")
    a, b, c = s / 50.0, (k % 10) / 10.0, (k % 7) / 6.0
    m = {"match": a, "price": b, "review": c, "review_count": s % 5, "traceability": a, "confidence": b, "shop_diversity": c, "product_exposure": a, "shop_exposure": b}
    warnings = F.when(s % 6 == 0, F.array(*map(F.lit, ("w1", "w2", "w3"))))
    reasons = S.selection_reasons(m, warnings, F.col("p_type") == "PROMO", s % 2 == 0, s % 2 == 1)
    terms = {"component_match": a, "unit_product_preference": b, "price_stock": (b + c) / 2, "product_reviews": c, "catalog_quality": a, "pharmacy_diversity": c, "freshness": b, "exposure": a, "verified_reviews": 2 * b}
    parts = S.score_breakdown(terms, k % 3 == 0, c, b)
    return t("part").select("p_partkey", F.array_join(reasons, " ").alias("reasons"), parts.alias("_b")).select("p_partkey", "reasons", *[f"_b.{x}" for x in ("component_match", "price_stock", "verified_reviews", "restriction_penalty")])


@query("""SELECT o_orderkey, bool_or(o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS blocked_so_far FROM orders""")
def d25_running_or(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t("orders").select("o_orderkey", F.bool_or(F.col("o_orderpriority") == "1-URGENT").over(w).alias("blocked_so_far"))


@query("""WITH d(code, lo, hi, seg) AS (VALUES ('any', -9999, 99999, NULL), ('mid', 0, 5000, NULL), ('seg', 0, 5000, 'BUILDING'))
SELECT c_custkey, arg_max(code, (seg IS NOT NULL)::INT * 2 + (hi < 99999)::INT) AS definition FROM customer JOIN d ON c_acctbal BETWEEN lo AND hi AND (seg IS NULL OR seg = c_mktsegment) GROUP BY 1""")
def d26_definition_choice(t):
    c = t("customer")
    d = c.sparkSession.createDataFrame([("any", -9999, 99999, None), ("mid", 0, 5000, None), ("seg", 0, 5000, "BUILDING")], "code string, lo int, hi int, seg string")
    j = c.join(F.broadcast(d), F.col("c_acctbal").between(F.col("lo"), F.col("hi")) & (F.col("seg").isNull() | (F.col("seg") == F.col("c_mktsegment"))))
    rank = F.col("seg").isNotNull().cast("int") * 2 + (F.col("hi") < 99999).cast("int")
    return j.groupBy("c_custkey").agg(F.max_by("code", rank).alias("definition"))


@query("SELECT l_partkey, CASE WHEN q IS NULL OR q = 0 THEN 'none' WHEN q < 0.5 * goal THEN 'low' WHEN q <= 1.5 * goal THEN 'covered' ELSE 'high' END AS dose_status FROM (SELECT l_partkey, sum(l_quantity) AS q, 800 AS goal FROM lineitem GROUP BY 1)")
def d28_dose_status(t):
    q = F.col("q")
    return t("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).select("l_partkey", F.when(q.isNull() | (q == 0), "none").when(q < 400, "low").when(q <= 1200, "covered").otherwise("high").alias("dose_status"))


@query("""WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size > 40), b AS (SELECT DISTINCT p_name FROM part WHERE p_size < 3) SELECT p_name, 'first' AS origin, NULL::DOUBLE AS score FROM a UNION ALL SELECT p_name, 'lab', 0.88 FROM b WHERE p_name NOT IN (SELECT p_name FROM a)""")
def d30_signal_merge(t):
    a = t("part").filter("p_size > 40").select("p_name").distinct()
    b = t("part").filter("p_size < 3").select("p_name").distinct().join(a, "p_name", "left_anti")
    return a.select("p_name", F.lit("first").alias("origin"), F.lit(None).cast("double").alias("score")).unionByName(b.select("p_name", F.lit("lab").alias("origin"), F.lit(0.88).alias("score")))


@query("""WITH c AS (SELECT source, avg((quality IS NOT NULL)::INT) AS share, avg((n_chars > 500)::INT) FILTER (WHERE quality = 1) AS recall, avg((n_chars <= 500)::INT) FILTER (WHERE quality = 0) AS spec FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, CASE WHEN share < 0.10 THEN 'not_evaluable' WHEN recall >= 0.80 AND spec >= 0.90 THEN 'ready' ELSE 'needs_work' END AS status FROM c""")
def d41_executive_status(t):
    j = t("documents").join(t("labels"), "doc_id", "left")
    big = (F.col("n_chars") > 500).cast("int")
    c = j.groupBy("source").agg(F.avg(F.col("quality").isNotNull().cast("int")).alias("share"), F.avg(F.when(F.col("quality") == 1, big)).alias("recall"), F.avg(F.when(F.col("quality") == 0, 1 - big)).alias("spec"))
    return c.select("source", S.executive_status(F.col("share"), F.col("recall"), F.col("spec")).alias("status"))


@query("""SELECT p_type, count(DISTINCT s_suppkey) AS suppliers, round(avg(s_acctbal), 2) AS mean_balance FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def j24_exposure(t):
    j = t("lineitem").select("l_partkey", "l_suppkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey")
    return j.groupBy("p_type").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.avg("s_acctbal"), 2).alias("mean_balance"))


@query("""SELECT c_custkey, n.n AS orders, u.n AS urgent, p.n AS pending FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u ON u.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) p ON p.o_custkey = c_custkey""")
def j6_left_join_chain(t):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    out = t("customer").select("c_custkey")
    for name, rows in (("orders", o), ("urgent", o.filter("o_orderpriority = '1-URGENT'")), ("pending", o.filter("o_orderstatus = 'P'"))):
        out = out.join(rows.groupBy("c_custkey").agg(F.count("*").alias(name)), "c_custkey", "left")
    return out


@query("""SELECT conv_id, turn, role, next_role FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE role = 'user'""")
def j16_shown_and_ignored(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role")).filter("role = 'user'")


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS code, CASE WHEN a.p_partkey IS NULL THEN 'unexpected' WHEN b.p_partkey IS NULL THEN 'missed' WHEN a.p_size <> b.p_size THEN 'value' ELSE 'right' END AS outcome
  FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 2 = 0) b USING (p_partkey)""")
def j21_predicted_expected(t):
    a = t("part").filter("p_partkey % 3 != 0").select(F.col("p_partkey").alias("code"), F.col("p_size").alias("a"))
    b = t("part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("code"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("b"))
    return a.join(b, "code", "full_outer").select("code", F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missed").when(F.col("a") != F.col("b"), "value").otherwise("right").alias("outcome"))


@query("""WITH p AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS parts FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
e AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN 'pack_' || (o_custkey % 50) ELSE CASE WHEN parts IS NOT NULL THEN 'pack_' || substr(md5(array_to_string(parts, '|')), 1, 10) END END AS pack_id, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 5) / 4 END AS score, o_orderdate FROM orders LEFT JOIN p ON l_orderkey = o_orderkey)
SELECT pack_id, count(*) AS n, round(avg(score), 6) AS avg_score, max(o_orderdate) AS last_feedback_at FROM e WHERE pack_id IS NOT NULL AND score IS NOT NULL GROUP BY 1""")
def a3_weighted_merge(t):
    """Orders as feedback: every third has no pack's key, only its parts."""
    parts = t("lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("parts"))
    k = F.col("o_orderkey")
    own = t("orders").join(parts, "o_orderkey", "left").withColumn("pack", F.when(k % 3 > 0, F.concat(F.lit("pack_"), (F.col("o_custkey") % 50).cast("string"))))
    return ranking.pack_stats(own, "pack", "parts", F.when(k % 7 > 0, (k % 5) / 4), "o_orderdate").select("pack_id", "n", F.round("avg_score", 6).alias("avg_score"), "last_feedback_at")


@query("SELECT event_type, count_if(value > 50)::BIGINT AS high, count_if(value <= 50)::BIGINT AS low, count(*) AS n FROM events GROUP BY 1")
def a6_conditional_counts(t):
    return t("events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), F.count("*").alias("n"))


@query("""SELECT l_partkey, count(*) AS shown, round(count(*) / (SELECT count(*) FROM lineitem), 8) AS share FROM lineitem GROUP BY 1""")
def a7_exposure_share(t):
    n = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("shown"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("shown").alias("_all")))).select("l_partkey", "shown", F.round(F.col("shown") / F.col("_all"), 8).alias("share"))


@query("SELECT n_name, round((k / n + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n), 4) AS low, round((k / n + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n), 4) AS high FROM (SELECT n_name, count(*) AS n, count_if(c_acctbal > 0) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def a13_wilson(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return j.select("n_name", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query(_HITS + f""", qs(q) AS (SELECT unnest({FIELDS})), base(cond, threshold) AS (VALUES {_rows(BASE)}), pf AS (SELECT '|' || c_custkey AS k, cond, field, sum(weight) AS w FROM h GROUP BY ALL UNION ALL SELECT q || '|' || c_custkey, cond, field, sum(weight) FROM h, qs WHERE field <> q GROUP BY ALL),
s AS (WITH {_fold("pf", "k")} SELECT split_part(k, '|', 1) AS q, split_part(k, '|', 2) AS c, cond FROM scored JOIN base USING (cond) WHERE score >= 0.7 * threshold),
b AS (SELECT qs.q, c, cond FROM s, qs WHERE s.q = ''), a AS (SELECT * FROM s WHERE q <> ''), f AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.c, b.c) AS c, count(*) FILTER (WHERE a.c IS NULL) AS lost, count(*) FILTER (WHERE b.c IS NULL) AS gained FROM a FULL JOIN b ON a.q = b.q AND a.c = b.c AND a.cond = b.cond GROUP BY 1, 2)
SELECT qs.q AS question, count(*) FILTER (WHERE lost > 0 OR gained > 0) AS cases_changed, round(count(*) FILTER (WHERE lost > 0 OR gained > 0) / (SELECT count(*) FROM customer), 3) AS share_changed, coalesce(sum(lost), 0)::BIGINT AS lost, coalesce(sum(gained), 0)::BIGINT AS gained FROM qs LEFT JOIN f ON f.q = qs.q GROUP BY 1""")
def a26_ablation(t):
    """What customers' scores by family detect without each field; without a family, its proxy may count."""
    h, _, f, p = _hits(t)
    spark = h.sparkSession
    questions = spark.createDataFrame([(q,) for q in FIELDS], "question string")
    asked = h.withColumn("question", F.explode(F.array(F.lit(""), *map(F.lit, FIELDS)))).filter("question != field").withColumn("_k", F.concat_ws("|", "question", "c_custkey"))
    scores = rules.family_scores(asked.select("_k", "cond", "field", "op", "weight"), "_k", f, p).join(spark.createDataFrame(BASE, "cond string, threshold double"), "cond").filter(F.col("score") >= 0.7 * F.col("threshold"))
    found = scores.select(F.split_part("_k", F.lit("|"), F.lit(1)).alias("question"), F.split_part("_k", F.lit("|"), F.lit(2)).alias("case"), "cond")
    return evaluation.ablation(found.filter("question = ''"), found.filter("question != ''"), "question", "case", "cond", questions, t("customer").count())


@query("""SELECT count(*) AS products, count_if(p_size > 10)::BIGINT AS sized, round(count_if(p_retailprice > 1000) / count(*), 4) AS dear_share, count(DISTINCT p_brand) AS brands, CASE WHEN count_if(p_size <= 2) / count(*) > 0.01 THEN 'small_sizes' ELSE '' END AS warnings FROM part""")
def a28_catalog_summary(t):
    warn = F.when(F.count_if(F.col("p_size") <= 2) / F.count("*") > 0.01, "small_sizes").otherwise("")
    return t("part").agg(F.count("*").alias("products"), F.count_if(F.col("p_size") > 10).alias("sized"), F.round(F.count_if(F.col("p_retailprice") > 1000) / F.count("*"), 4).alias("dear_share"), F.countDistinct("p_brand").alias("brands"), warn.alias("warnings"))


@query("""SELECT p_brand, p_type, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS price FROM part GROUP BY 1, 2""")
def a30_cheapest_per_key(t):
    return t("part").groupBy("p_brand", "p_type").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"), F.min("p_retailprice").alias("price"))


@query("SELECT round(avg(m), 5) AS mean_of_means, round(avg(h), 5) AS hit FROM (SELECT l_orderkey, avg(l_discount) AS m, max((l_returnflag = 'A')::INT) AS h FROM lineitem GROUP BY 1)")
def a31_mean_of_means(t):
    per = t("lineitem").groupBy("l_orderkey").agg(F.avg("l_discount").alias("m"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("h"))
    return per.agg(F.round(F.avg("m"), 5).alias("mean_of_means"), F.round(F.avg("h"), 5).alias("hit"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def w8_top_per_group(t):
    return ranking.best_per_key(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderstatus = 'F' DESC, o_orderdate, o_orderkey) AS place FROM orders")
def w15_goal_order(t):
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderpriority") == "1-URGENT").desc(), (F.col("o_orderstatus") == "F").desc(), "o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("SELECT p_name, stage, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY stage, p_partkey) AS rn FROM (SELECT p_name, p_partkey, 1 AS stage FROM part WHERE p_size > 45 UNION ALL SELECT p_name, p_partkey, 2 FROM part WHERE p_size < 30)) WHERE rn = 1")
def u7_stage_concat(t):
    both = t("part").filter("p_size > 45").select("p_name", "p_partkey", F.lit(1).alias("stage")).unionByName(t("part").filter("p_size < 30").select("p_name", "p_partkey", F.lit(2).alias("stage")))
    return catalog.first_rows(both, ["p_name"], [F.col("stage"), F.col("p_partkey")])


@query(r"SELECT c_custkey, translate(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), '01358', 'oiesb') AS scan_key FROM customer")
def f27_scan_key(t):
    return t("customer").select("c_custkey", X.scan_key(F.col("c_name")).alias("scan_key"))


@query("SELECT p_partkey, contains(' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' blue ') AS blue FROM part")
def f8_phrase(t):
    return t("part").select("p_partkey", X.holds_phrase(F.col("p_name"), F.lit("Blue")).alias("blue"))


@query("SELECT p_partkey, regexp_matches(p_type, 'STEEL|BRASS') AS metal, regexp_matches(p_type, '^PROMO') AS promo, regexp_matches(p_name, 'blue|green') AS coloured, p_size <= 5 AS tiny FROM part")
def f15_flags(t):
    return t("part").select("p_partkey", F.col("p_type").rlike("STEEL|BRASS").alias("metal"), F.col("p_type").rlike("^PROMO").alias("promo"), F.col("p_name").rlike("blue|green").alias("coloured"), (F.col("p_size") <= 5).alias("tiny"))


@query("""SELECT p_partkey, round(CASE WHEN p_retailprice > h THEN greatest(0.05, 0.4 * (1 - least(1.0, (p_retailprice - h) / greatest(h, 1)))) WHEN l IS NULL THEN greatest(0.30, 1 - 0.30 * p_retailprice / h) ELSE least(1, greatest(0, 1 - 0.30 * ((p_retailprice - l) / greatest(h - l, 1)))) END, 5)::DOUBLE AS price_score
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 1300 ELSE 1500 END AS h, CASE WHEN p_size % 3 = 0 THEN 1299.5 WHEN p_size % 3 = 1 THEN 1000 END AS l FROM part)""")
def m8_price_score(t):
    k = F.col("p_size") % 3
    return t("part").select("p_partkey", F.round(S.price_score(F.col("p_retailprice"), F.when(k == 0, 1299.5).when(k == 1, 1000.0), F.when(k == 0, 1300.0).otherwise(1500.0)), 5).alias("price_score"))


@query("""SELECT o_custkey, round(CASE WHEN len(u) > 0 THEN len(list_intersect(c, u)) / len(u) ELSE 0 END, 5)::DOUBLE AS coverage FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS c, ['1-URGENT', '2-HIGH', '5-LOW'] AS u FROM orders GROUP BY 1)""")
def m25_coverage(t):
    useful = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "5-LOW"]))
    return t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("c")).select("o_custkey", F.round(S.coverage(F.col("c"), useful), 5).alias("coverage"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_type(json_extract(props, '$.k')) IS NOT NULL AS has_k, json_extract_string(props, '$.none') AS none FROM events")
def m29_json_access(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.get_json_object("props", "$.none").alias("none"))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS text, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE date_diff('hour', d, TIMESTAMP '2001-09-01 12:00:00') + CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 0 END END::DOUBLE AS hours,
  CASE WHEN o_orderkey % 4 = 3 THEN 0.45 WHEN date_diff('day', d, TIMESTAMP '2001-09-01 12:00:00') <= 7 THEN 1.0 WHEN date_diff('day', d, TIMESTAMP '2001-09-01 12:00:00') <= 30 THEN 0.85 WHEN date_diff('day', d, TIMESTAMP '2001-09-01 12:00:00') <= 90 THEN 0.65 ELSE 0.45 END::DOUBLE AS freshness FROM o""")
def m28_age(t):
    """Order dates as texts in three ISO forms and one that is none; their age in hours and freshness in days."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    form = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(form, F.lit("Z"))).when(k == 1, F.concat(form, F.lit("+02:00"))).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("n/a")
    hours = S.age_hours(text, F.lit("2001-09-01 12:00:00").cast("timestamp"))
    return t("orders").select("o_orderkey", hours.alias("hours"), S.freshness(F.coalesce(F.floor((hours - F.when(k == 1, 2).otherwise(0)) / 24), F.lit(999))).alias("freshness"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 'rejected' ELSE 'accepted' END AS state, concat_ws(';', CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') THEN 'mail' END, CASE WHEN length(text) < 100 THEN 'short' END) AS reasons FROM documents")
def g6_ingestion_gate(t):
    c = F.col("text")
    why = catalog.reasons(mail=c.rlike(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), short=F.length(c) < 100)
    return t("documents").select("doc_id", F.when(F.length(c) == 0, "rejected").otherwise("accepted").alias("state"), why.alias("reasons"))


@query()
def l2_target_model(t):
    """A fitted model isn't SQL: quality by length and its logarithm, with the held-out probability of each document."""
    d = t("documents").select("doc_id", "n_chars", F.log1p("n_chars").alias("log_chars")).join(t("labels"), "doc_id")
    numbers = ["n_chars", "log_chars"]
    model = models.fit_target(d.filter("doc_id % 5 != 0"), numbers, "quality")
    return models.predict(model, d, numbers).select("doc_id", "probability")


@query()
def l1_one_vs_rest(t):
    """Two labels fitted together on numbers and a category; a fitted model isn't SQL."""
    d = t("documents").select("doc_id", "lang", "n_chars", F.log1p("n_chars").alias("log_chars")).join(t("labels"), "doc_id")
    model = multilabel.fit_labels(d, ["n_chars", "log_chars"], ["lang"], ["quality", "toxic"])
    return model.predict(d).select("doc_id", "p_quality", "p_toxic")


@query()
def l6_recalibration(t):
    d = t("documents").join(t("labels"), "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"), "quality")
    return models.recalibrated(d, "p", "quality").select("doc_id", "p", "calibrated")


_LABS, _DIET, _SYMPTOMS = ["lab_iron_status", "lab_zinc_status", "lab_none_status"], ["fish", "meat", "fruit"], ["s1", "s2", "s3"]


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'low' WHEN c_custkey % 3 = 1 THEN 'missing' END AS iron, CASE WHEN c_nationkey > 9 THEN 'normal' END AS zinc, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS fish, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE 2 END AS meat, c_custkey % 6 AS s1, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey % 6 END AS s2 FROM customer),
d AS (SELECT *, (coalesce(iron, 'missing') <> 'missing')::INT AS i, (zinc IS NOT NULL)::INT AS z, (coalesce(fish, -1) >= 0)::INT AS f, (meat >= 0)::INT AS m FROM c)
SELECT c_custkey, f AS fish_reported, i AS lab_iron_observed, CASE WHEN z = 1 THEN 30 ELSE 999 END AS lab_zinc_age_days, 0 AS lab_none_observed, 3 - f - m AS diet_quantity_missing_count, i + z AS observed_lab_count, 3 - i - z AS missing_lab_count, round((s1 + coalesce(s2, 0)) / 3, 3) AS symptom_burden_score, (s1 >= 4)::INT + (coalesce(s2, 0) >= 4)::INT AS high_symptom_count FROM d""")
def d7_prepared_features(t):
    """Customers' fields as answers; one laboratory, one quantity and one symptom aren't in the table."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    own = t("customer").select("c_custkey", F.when(k % 3 == 0, "low").when(k % 3 == 1, "missing").alias("lab_iron_status"), F.when(n > 9, "normal").alias("lab_zinc_status"), F.when(k % 4 > 0, n).alias("fish"), F.when(k % 5 == 0, -1).otherwise(2).alias("meat"), (k % 6).alias("s1"), F.when(k % 2 == 0, n % 6).alias("s2"))
    out = features.prepared(own, "c_custkey", _DIET, _LABS, _SYMPTOMS)
    return out.select("c_custkey", "fish_reported", "lab_iron_observed", "lab_zinc_age_days", "lab_none_observed", "diet_quantity_missing_count", "observed_lab_count", "missing_lab_count", "symptom_burden_score", "high_symptom_count")


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<img src="/a/Logo.png"><img data-src=''b/' || page_id || '.JPG''> http://cdn.x.io/z.webp?q' WHEN 1 THEN '<img src="//cdn.io/p?fm=jpg&i=' || page_id || '">' ELSE '' END || html AS html, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS root FROM pages),
u AS (SELECT page_id, root, regexp_extract_all(html, '(?i)(?:data-)?src\s*=\s*["'']([^"'']+)["'']', 1) || regexp_extract_all(html, '(?i)(https?://[^\s"''<>]+\.(?:jpg|jpeg|png|webp))', 1) AS u FROM p),
w AS (SELECT page_id, list_distinct(list_filter(list_transform(u, lambda x: CASE WHEN regexp_matches(lower(trim(x)), '^https?://') THEN trim(x) WHEN starts_with(trim(x), '//') THEN 'https:' || trim(x) WHEN starts_with(trim(x), '/') THEN root || trim(x) ELSE root || '/' || trim(x) END), lambda x: length(x) <= 500 AND (regexp_matches(lower(split_part(split_part(x, '#', 1), '?', 1)), '\.(jpg|jpeg|png|webp)$') OR regexp_matches(lower(x), '\?[^#]*(format=jpg|format=jpeg|format=png|format=webp|fm=jpg|fm=webp)')))) AS w FROM u)
SELECT page_id, array_to_string(list_sort(w), ' ') AS images, coalesce(CASE page_id % 5 WHEN 0 THEN list_filter(w, lambda x: NOT contains(lower(x), 'logo') AND contains(x, '.JPG'))[1] ELSE list_filter(w, lambda x: contains(x, 'cdn.io'))[1] END, '') AS first_image FROM w""")
def f19_images(t):
    """Image addresses of pages, of which two in five get some before their own markup."""
    i, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    more = F.when(i == 0, F.concat(F.lit('<img src="/a/Logo.png"><img data-src=\'b/'), n, F.lit(".JPG'> http://cdn.x.io/z.webp?q"))).when(i == 1, F.concat(F.lit('<img src="//cdn.io/p?fm=jpg&i='), n, F.lit('">'))).otherwise("")
    urls = X.image_urls(F.concat(more, "html"), F.col("url"))
    return t("pages").select("page_id", urls.alias("u")).select("page_id", F.array_join(F.array_sort("u"), " ").alias("images"), X.first_image(F.col("u")).alias("first_image"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'Paciente: ' || lang || chr(10) || ' DR. X' || chr(10) ELSE 'Drama y ' END || text, '(?im)^[ 	]*(?:paciente|nombres?|apellidos?|dni|documento|ci|c\.i\.?|pasaporte|historia\s+cl[ií]nica|hc|fecha\s+de\s+nacimiento|f\s+nac|f\.\s+nac|f\.?nac|direcci[oó]n|tel[eé]fono|celular|correo|e-?mail|m[eé]dico|dra?\.?)(?:[^\pL0-9_
].*)?$', '[LINE]', 'g'),
  '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '9[0-9]{8}', '[PHONE]', 'g'), '[0-9]{8}', '[ID]', 'g') AS text FROM documents""")
def f21_redact_report(t):
    """Whole documents as reports, of which every third begins with lines about a person."""
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Paciente: "), "lang", F.lit("\n DR. X\n"))).otherwise("Drama y ")
    return t("documents").select("doc_id", X.redact_report(F.concat(head, "text")).alias("text"))


@query(r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') THEN 'text:email' WHEN regexp_matches(text, '(^|[^0-9])([0-9][ \-]?){8,}[0-9]([^0-9]|$)') THEN 'text:phone_like' END], lambda x: x IS NOT NULL), ' ') AS findings, 'c_name' AS personal_columns FROM documents")
def f22_personal_columns(t):
    """Values of documents, and the columns of customers whose names tell of persons."""
    d = t("documents")
    found = F.array_join(X.personal_values(["doc_id", "text", "lang", "n_chars"], ("doc_id", "n_chars")), " ")
    return d.select("doc_id", found.alias("findings"), F.lit(" ".join(X.personal_columns(t("customer").columns))).alias("personal_columns"))
