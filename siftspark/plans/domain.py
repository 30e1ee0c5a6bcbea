"""Queries of the recommendation chain, component registries, names, JSON and model checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.operators import decisions, evaluation, matching, models, payload, ranking, recommend, registry, survey
from siftspark.operators.bounds import bounded
from siftspark.plans.analytics import _HITS, _hits
from siftspark.plans.core import query

#: A small dimension of links: place, condition, component, grade, strength, role, source, lab, risk, penalty, commercial.
LINKS = [
    (0, "TRUCK", "c1", "high", "strong", "primary", "official_fact_sheet", "no", "low", 0.0, 1), (1, "TRUCK", "c2", "none", "strong_with_lab", "supportive", "internal_rules", "required", "moderate", 0.1, 1), (2, "MAIL", "c1", "low", "none", "safety_context", "medical_reference", "optional", "high", 0.05, 0),
    (3, "MAIL", "c3", "moderate", "none", "primary_with_lab", "other", "preferred", "none", 0.0, 1), (4, "SHIP", "c3", "high", "none", "primary", "official_consumer_fact_sheet", "no", "low_moderate", 0.02, 1), (5, "RAIL", "c4", "expert_opinion", "none", "safety_context", "official_fact_sheet", "no", "low", 0.9, 0),
    (6, "SHIP", "c4", "very_low", "none", "supportive_with_lab", "official_health_resource", "optional", "moderate_high", 0.0, 1),
]
_LINK_FIELDS = "place int, condition string, component string, grade string, strength string, role string, source string, lab string, risk string, penalty double, commercial int"


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)


def _detected(t):
    """Ship modes of an order as its conditions; every third order has no scores."""
    li = t("lineitem").select("l_orderkey", (F.col("l_linenumber") % 5).alias("m"), "l_discount")
    mode = F.element_at(F.array(*map(F.lit, ["TRUCK", "MAIL", "SHIP", "RAIL", "AIR"])), (F.col("m") + 1).cast("int"))
    return li.select("l_orderkey", mode.alias("condition"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount") * 9).alias("p")).groupBy("l_orderkey", "condition").agg(F.max("p").alias("probability"))


_DETECTED = "d AS (SELECT l_orderkey, ['TRUCK', 'MAIL', 'SHIP', 'RAIL', 'AIR'][l_linenumber % 5 + 1] AS condition, max(CASE WHEN l_orderkey % 3 <> 0 THEN l_discount * 9 END)::DOUBLE AS probability FROM lineitem GROUP BY 1, 2)"


def _case(column, weights, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END"


_EVIDENCE = f"""greatest(0.05::DOUBLE, 0.36::DOUBLE * CASE grade WHEN 'high' THEN 1.0 WHEN 'moderate' THEN 0.82 WHEN 'low' THEN 0.72 WHEN 'very_low' THEN 0.62 WHEN 'expert_opinion' THEN 0.58 ELSE {_case("strength", {"high": 1.0, "strong": 1.0, "strong_with_lab": 0.96, "moderate": 0.82, "low_moderate": 0.72, "contextual": 0.66}, 0.55)} END
  + 0.22::DOUBLE * {_case("role", {"primary": 1.0, "primary_with_lab": 0.96, "supportive": 0.74, "supportive_with_lab": 0.68, "safety_context": 0.22}, 0.70)} + 0.18::DOUBLE * {_case("source", {"official_fact_sheet": 1.0, "official_consumer_fact_sheet": 0.92, "official_health_resource": 0.90, "medical_reference": 0.86, "internal_rules": 0.70}, 0.70)}
  + 0.14::DOUBLE * {_case("lab", {"no": 1.0, "optional": 0.95, "preferred": 0.90, "required": 0.72}, 0.90)} + 0.10::DOUBLE * (1 - {_case("risk", {"low": 0.0, "low_moderate": 0.03, "moderate": 0.07, "moderate_high": 0.14, "high": 0.25}, 0.08)}) - CASE WHEN scored THEN penalty ELSE 0 END)"""


@query(f"""WITH {_DETECTED}, links(place, condition, component, grade, strength, role, source, lab, risk, penalty, commercial) AS (VALUES {_values(LINKS)}),
s AS (SELECT *, count(probability) OVER (PARTITION BY l_orderkey) > 0 AS scored FROM d), j AS (SELECT s.*, links.* EXCLUDE (condition), CASE WHEN scored THEN coalesce(probability, 0.60) ELSE 0.65 END::DOUBLE AS p FROM s JOIN links USING (condition)),
e AS (SELECT *, {_EVIDENCE} AS ev FROM j), r AS (SELECT *, round(greatest(0.05::DOUBLE, p) * ev, 4) AS score FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, component ORDER BY commercial DESC, role = 'safety_context', score DESC, place) AS rn FROM r)
SELECT l_orderkey, component, condition, round(p, 6) AS probability, round(ev, 4) AS evidence, score, commercial, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, condition, component) AS rank FROM b WHERE rn = 1""")
def j8_evidence_recommendations(t):
    d = _detected(t)
    return recommend.evidence_recommendations(d, "l_orderkey", d.sparkSession.createDataFrame(LINKS, _LINK_FIELDS))


_VECTORS = "v AS (SELECT 'c' || vec_id AS component, embedding::DOUBLE[] AS e FROM embeddings), seeds AS (SELECT DISTINCT o_custkey AS k, 'c' || (l_partkey % 500) AS component FROM lineitem JOIN orders ON o_orderkey = l_orderkey), edges AS (SELECT DISTINCT 'c' || (l_partkey % 500) AS a, 'c' || (l_suppkey * 5 % 500) AS b FROM lineitem WHERE l_quantity > 45)"


@query(f"""WITH {_VECTORS}, own AS (SELECT k, component, e FROM seeds JOIN v USING (component)),
cm AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS m FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM own) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT cm.k, v.component, list_dot_product(v.e, c) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(c, c)) + 1e-8) AS sim FROM cm, v),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sim DESC, component) AS rk FROM p WHERE sim >= 0.1 AND NOT EXISTS (SELECT 1 FROM own WHERE own.k = p.k AND own.component = p.component) QUALIFY rk <= 20),
s AS (SELECT DISTINCT n.* FROM n JOIN own ON own.k = n.k JOIN edges ON (edges.a = n.component AND edges.b = own.component) OR (edges.b = n.component AND edges.a = own.component)),
q AS (SELECT s.*, CASE WHEN component LIKE '%5' THEN 'c_five' ELSE component END AS canonical FROM s), o AS (SELECT DISTINCT k, CASE WHEN component LIKE '%5' THEN 'c_five' ELSE component END AS canonical FROM own),
u AS (SELECT *, row_number() OVER (PARTITION BY k, canonical ORDER BY rk) AS rn FROM q WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = q.k AND o.canonical = q.canonical)),
z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rk) AS place FROM u WHERE rn = 1)
SELECT k, component, round(sim, 4) AS similarity, round(sim * 0.45, 4) AS score, place FROM z WHERE place <= 3""")
def d16_similar_components(t):
    """Customers' parts are seeds, all embeddings the components."""
    name = lambda c: F.concat(F.lit("c"), (c % 500).cast("string"))
    li = t("lineitem")
    seeds = li.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")), "l_orderkey").select("k", name(F.col("l_partkey")).alias("component"))
    vectors = t("embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("component"), F.col("embedding").cast("array<double>").alias("embedding"))
    edges = li.filter("l_quantity > 45").select(name(F.col("l_partkey")).alias("a"), name(F.col("l_suppkey") * 5).alias("b")).distinct()
    equivalents = vectors.filter("component LIKE '%5'").select("component", F.lit("c_five").alias("canonical"))
    return recommend.similar_components(seeds, "k", vectors, edges, equivalents, least=0.1)


_ITEM_VOTES = "vt AS (SELECT l_partkey AS item, l_returnflag AS context, CASE WHEN l_quantity > 25 THEN l_discount * 10 ELSE l_tax * 10 END::DOUBLE AS reward, (l_linenumber % 5 + 1)::DOUBLE AS rating FROM lineitem)"


@query(f"""WITH {_ITEM_VOTES}, i AS (SELECT l_orderkey AS pack, l_linenumber * 1000000 + l_partkey AS position, l_partkey AS item, min(l_returnflag) AS context, min(l_linestatus) AS tier FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1, 2, 3),
c AS (SELECT item, context, avg(reward) AS cr, avg(rating) AS cs, count(*) AS cn FROM vt GROUP BY 1, 2), g AS (SELECT item, avg(reward) AS gr, avg(rating) AS gs, count(*) AS gn FROM vt GROUP BY 1),
r AS (SELECT i.*, CASE WHEN cn >= 10 THEN 'context' WHEN gn >= 10 THEN 'global' ELSE 'insufficient' END AS level, round(CASE WHEN cn >= 10 THEN (cn * cr + 14.0::DOUBLE) / (cn + 20) WHEN gn >= 10 THEN (gn * gr + 14.0::DOUBLE) / (gn + 20) ELSE 0.70 END, 4)::DOUBLE AS score, round(CASE WHEN cn >= 10 THEN cs WHEN gn >= 10 THEN gs END, 1) AS stars
  FROM i LEFT JOIN c ON c.item = i.item AND c.context = i.context LEFT JOIN g ON g.item = i.item),
s AS (SELECT pack, tier, position, row_number() OVER (PARTITION BY pack, tier ORDER BY position) AS slot FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY pack, tier ORDER BY score DESC, position) AS slot FROM r)
SELECT k.pack, k.item, k.level AS rating_level, k.score AS rating_score, k.stars, s.position AS new_position FROM k JOIN s USING (pack, tier, slot)""")
def d19_item_ratings(t):
    """Rewards are added in the table's order, as its SQL does when one thread reads the table."""
    li = t("lineitem")
    votes = li.select(F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"), F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("context"), F.when(F.col("l_quantity") > 25, F.col("l_discount") * 10).otherwise(F.col("l_tax") * 10).alias("reward"), (F.col("l_linenumber") % 5 + 1).cast("double").alias("rating"))
    position = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    items = li.filter("l_orderkey % 4 = 0").groupBy(F.col("l_orderkey").alias("pack"), position.alias("position"), F.col("l_partkey").alias("item")).agg(F.min("l_returnflag").alias("context"), F.min("l_linestatus").alias("tier"))
    rated = recommend.item_ratings(items, votes, "item", "context", "reward", "rating", order=["_file", "_at"])
    return ranking.rerank_in_tiers(rated, ["pack"], "tier", "position", F.col("rating_score")).select("pack", "item", "rating_level", "rating_score", "stars", "new_position")


KINDS = [("TRUCK", "nutrition_risk", "diet_or_lab"), ("MAIL", "safety_flag", "safety_only"), ("SHIP", "wellness_priority", "survey_wellness"), ("RAIL", "biomedical_risk", "lab_only")]


@query(f"""WITH {_DETECTED}, k(condition, kind, own_group) AS (VALUES {_values(KINDS)}),
r AS (SELECT l_orderkey, d.condition, coalesce(kind, 'context') AS kind, probability AS p, coalesce(CASE WHEN l_orderkey % 5 = 0 THEN 'observed_lab' END, own_group, 'unknown') AS g FROM (SELECT * REPLACE (coalesce(probability, 0.6) AS probability) FROM d) d LEFT JOIN k USING (condition))
SELECT l_orderkey, condition, kind, round(p, 6) AS probability, g AS evidence_group, CASE WHEN kind = 'wellness_priority' THEN CASE WHEN p >= 0.80 THEN 'media' ELSE 'baja' END WHEN g IN ('lab_only', 'lab_or_diet', 'diet_or_lab', 'safety_only') AND p >= 0.70 THEN 'alta' WHEN p >= 0.55 THEN 'media' ELSE 'baja' END AS confidence,
  CASE WHEN kind = 'safety_flag' THEN 'bloqueada' WHEN kind IN ('context', 'wellness_priority') THEN 'no_convertir' WHEN p >= 0.75 THEN 'alta' WHEN p >= 0.55 THEN 'media' ELSE 'baja' END AS strength, kind NOT IN ('safety_flag', 'wellness_priority') AS allowed,
  CASE kind WHEN 'wellness_priority' THEN 'not_evaluable_with_nhanes_use_survey_golden_cases' WHEN 'context' THEN 'not_evaluated' ELSE 'evaluated_with_nhanes_when_data_available' END AS checked,
  CASE kind WHEN 'wellness_priority' THEN 'survey_rules_and_future_golden_cases' WHEN 'nutrition_risk' THEN 'nhanes_multi_cycle_diet_lab_rules' WHEN 'context' THEN 'internal_rules' ELSE 'nhanes_multi_cycle_lab_rules' END AS source,
  CASE kind WHEN 'wellness_priority' THEN 'wellness' WHEN 'safety_flag' THEN 'safety' ELSE 'conditions' END AS output FROM r""")
def d29_condition_results(t):
    d = _detected(t).withColumn("probability", F.coalesce("probability", F.lit(0.6))).withColumn("evidence_group", F.when(F.col("l_orderkey") % 5 == 0, "observed_lab"))
    return recommend.condition_results(d, "l_orderkey", d.sparkSession.createDataFrame(KINDS, "condition string, kind string, own_group string")).withColumn("probability", F.round("probability", 6))


@query(f"WITH {_DETECTED} SELECT l_orderkey, condition, round(probability, 6) AS probability, row_number() OVER (PARTITION BY l_orderkey ORDER BY probability DESC NULLS LAST, condition) AS place FROM d")
def t6_conditions_by_probability(t):
    return ranking.best_per_key(_detected(t), ["l_orderkey"], [F.desc_nulls_last("probability"), F.col("condition")], 99, "place").withColumn("probability", F.round("probability", 6))


ALIASES = [("almond antique", "AA", "Almond"), ("blue", "B", "Blue"), ("red rose", "RR", "Rose"), ("rose red", "RR", "Rosa"), ("small", "SM", "Small"), ("promo brushed", "PB", "Brushed")]


@query(f"""WITH a(alias, component, display) AS (VALUES {_values(ALIASES)}), p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS h FROM part)
SELECT p_partkey, component, min(display) AS display FROM p, a WHERE contains(' ' || h || ' ', ' ' || alias || ' ') OR len(list_filter(string_split(alias, ' '), lambda w: NOT list_contains(string_split(h, ' '), w))) = 0 GROUP BY 1, 2""")
def j12_detected_components(t):
    p = t("part")
    return registry.detected_components(p, "p_partkey", F.concat_ws(" ", "p_name", "p_type"), p.sparkSession.createDataFrame(ALIASES, "alias string, component string, display string"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'DE' || (1000 + p_size) END AS own, CASE WHEN p_size % 7 = 0 THEN 'EN' || p_size ELSE '' END AS inf, contains(h, ' blue ') OR contains(h, ' small ') AS found FROM (SELECT *, ' ' || trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) || ' ' AS h FROM part)),
k AS (SELECT DISTINCT 'DE' || (1000 + p_size) AS r FROM part WHERE p_size < 40), m AS (SELECT DISTINCT 'DE' || (1000 + p_size) AS r FROM part WHERE p_size < 20),
x AS (SELECT p.*, own <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.r = own) AS refused FROM p), y AS (SELECT *, CASE WHEN NOT refused AND own <> '' THEN own ELSE inf END AS registry FROM x),
z AS (SELECT *, CASE WHEN registry <> '' AND EXISTS (SELECT 1 FROM m WHERE m.r = registry) THEN 'true_rs_component' WHEN found AND registry <> '' THEN 'true_component_name_with_rs_unmapped' WHEN found THEN 'true_component_name_no_rs' WHEN registry <> '' THEN 'false_no_component_match' ELSE 'false_no_registro_sanitario' END AS traceable FROM y)
SELECT p_partkey, registry, CASE WHEN registry = '' THEN NULL WHEN refused OR own = '' THEN 'digemid_name_match' ELSE 'source' END AS source, traceable, CASE WHEN refused THEN 'rs_no_en_digemid:' || own WHEN traceable = 'false_no_component_match' THEN 'rs_sin_component_map' WHEN traceable = 'false_no_registro_sanitario' THEN 'sin_rs_y_sin_component_match' END AS rejection FROM z""")
def d34_registry_states(t):
    p = t("part")
    number = F.concat(F.lit("DE"), (F.col("p_size") + 1000).cast("string"))
    products = p.select("p_partkey", F.when(F.col("p_size") % 5 != 0, number).alias("own"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("en-"), F.col("p_size").cast("string"))).alias("inferred"))
    found = registry.detected_components(p, "p_partkey", F.concat_ws(" ", "p_name", "p_type"), p.sparkSession.createDataFrame([("blue", "B", "Blue"), ("small", "SM", "Small")], "alias string, component string, display string"))
    of = lambda n: p.filter(F.col("p_size") < n).select(number.alias("registry")).distinct()
    return registry.registry_states(products, "p_partkey", "own", "inferred", of(40), of(20), found)


@query("""WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias, 'k_' || split_part(p_name, ' ', 1) AS component FROM part), n AS (SELECT p_partkey AS node, split_part(p_name, ' ', 1) AS w, p_partkey % 6 AS k FROM part)
SELECT node::VARCHAR AS node, component, CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'salt_form' WHEN 2 THEN 'qualified' WHEN 3 THEN 'source_page' END AS rule, alias FROM n JOIN a ON a.alias = n.w WHERE k <= 3 AND length(alias) >= 4""")
def d33_node_equivalences(t):
    first = F.split("p_name", " ")[0]
    k = F.col("p_partkey") % 6
    name = F.initcap(first)
    shaped = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit(" Citrate"))).when(k == 2, F.concat(name, F.lit(" (unspecified)"))).when(k == 3, F.concat(name, F.lit(" - QuickFacts ODS"))).when(k == 4, F.concat(name, F.lit(" in combination citrate"))).otherwise(F.concat(name, F.lit(" something")))
    nodes = t("part").select(F.col("p_partkey").cast("string").alias("node"), shaped.alias("name"))
    aliases = t("part").select(first.alias("alias"), F.concat(F.lit("k_"), first).alias("component")).distinct()
    return registry.node_equivalences(nodes, aliases)


@query("""WITH w(component, name) AS (VALUES ('Brand#12', 'steel'), ('Brand#23', 'promo brushed'), ('Brand#34', 'tin')), p AS (SELECT p_partkey, p_brand, ' ' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x FROM part)
SELECT p_partkey, component, min(CASE WHEN p_brand = component THEN 'id' ELSE 'text' END) AS "by" FROM p JOIN w ON p_brand = component OR contains(x, ' ' || name || ' ') GROUP BY 1, 2""")
def d36_rotation_candidates(t):
    p = t("part")
    wanted = p.sparkSession.createDataFrame([("Brand#12", "steel"), ("Brand#23", "promo brushed"), ("Brand#34", "tin")], "component string, name string")
    return registry.rotation_candidates(p, "p_partkey", "p_brand", F.col("p_type"), wanted)


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['MAGNESIUM', 'VITAMIN'] ELSE ['B12', 'ZN'] END AS c, split_part(upper(p_name), ' ', 1) AS f, p_size FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(c || [f, '10000'], lambda w: w NOT IN ('UN', 'CON')))), ' ') AS words, p_size % 2 = 0 AS agree FROM n""")
def f6_comparable_names(t):
    even = F.col("p_size") % 2 == 0
    name = F.concat(F.when(even, "Vitamina Magnésio con ").otherwise("Zinc B-12 x caps "), F.split("p_name", " ")[0], F.lit(" 10,000 UI"))
    return t("part").select("p_partkey", F.array_join(X.comparable_tokens(name), " ").alias("words"), X.names_agree(F.when(even, "VITAMINS").otherwise("calcio"), name).alias("agree"))


@query("SELECT p_partkey, array_to_string(list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)], lambda w: w <> ''), '|') AS words FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' ')[1:2], lambda w: upper(w[1]) || w[2:]), ' ') AS p_name FROM part)")
def f9_camel_words(t):
    two = F.slice(F.split("p_name", " "), 1, 2)
    return t("part").select("p_partkey", F.array_join(X.camel_words(F.array_join(F.transform(two, lambda w: F.initcap(w)), "")), "|").alias("words"))


@query("""SELECT event_id, event_type || ' ' || json_extract_string(props, '$.k') || ' a b' AS flat FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 0""")
def f20_json_text(t):
    """Nested values made of the events' own; every third isn't JSON."""
    whole = F.to_json(F.struct(F.col("event_type").alias("name"), F.lit("x").alias("imageUrl"), F.struct(F.get_json_object("props", "$.k").alias("k"), F.array(F.lit(" a "), F.lit("b")).alias("list")).alias("inner")))
    return t("events").select("event_id", X.json_text(F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(whole)).alias("flat"))


@query()
def x4_without_accents(t):
    """Whole texts of all documents."""
    return t("documents").select("doc_id", X.without_accents(F.col("text")).alias("plain"))


@query("SELECT conv_id, json_array_length(j)::INT AS n, json_type(j) AS kind FROM (SELECT conv_id, to_json(list(role ORDER BY turn)) AS j FROM conversations GROUP BY 1)")
def m30_json_lengths(t):
    j = t("conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("j"))
    kind = F.when(F.json_array_length("j").isNotNull(), "ARRAY").otherwise("OBJECT")
    return j.select("conv_id", F.json_array_length("j").alias("n"), kind.alias("kind"))


def searched_products(products, pharmacies, components=None, component=None):
    """Products with their shop; the join over components is part of the plan only if one is asked for."""
    out = products.join(pharmacies, "shop")
    return out if component is None else out.join(components.filter(F.col("component") == component).select("product").distinct(), "product", "left_semi")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS product, l_suppkey AS shop FROM lineitem) SELECT product, shop, s_name, false AS filtered FROM p JOIN supplier ON s_suppkey = shop
UNION ALL SELECT product, shop, s_name, true FROM p JOIN supplier ON s_suppkey = shop WHERE product IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#12')""")
def j2_conditional_bridge(t):
    p = t("lineitem").select(F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("shop")).distinct()
    s, c = t("supplier").select(F.col("s_suppkey").alias("shop"), "s_name"), t("part").select(F.col("p_partkey").alias("product"), F.col("p_brand").alias("component"))
    both = [searched_products(p, s).withColumn("filtered", F.lit(False)), searched_products(p, s, c, "Brand#12").withColumn("filtered", F.lit(True))]
    return both[0].unionByName(both[1]).select("product", "shop", "s_name", "filtered")


def _labelled(t):
    return t("documents").select("doc_id", "n_chars", F.log1p("n_chars").alias("log_chars"), (F.col("n_chars") > 2000).alias("long"), (F.col("lang") == "en").alias("english")).join(t("labels"), "doc_id")


@query()
def l7_odds_ratios(t):
    """Cross-validated probabilities, and each indicator's odds ratio beside them; a fitted model isn't SQL."""
    d = _labelled(t)
    ratios = models.odds_ratios(d, ["long", "english"], "quality")
    return models.cross_validated(d, "doc_id", ["n_chars", "log_chars"], "quality").select("doc_id", "probability", *[F.lit(v).alias(f"odds_{k}") for k, v in ratios.items()])


@query()
def l1_calibrated(t):
    """Sigmoid-calibrated probabilities; a fitted model isn't SQL."""
    return models.platt(_labelled(t), "doc_id", ["n_chars", "log_chars"], "quality").select("doc_id", "probability")


@query()
def l10_external_validation(t):
    """A model of the English documents on all others; a fitted model isn't SQL."""
    d, numbers = _labelled(t), ["n_chars", "log_chars"]
    return models.external_validation(models.fit_target(d.filter("english"), numbers, "quality"), d.filter("NOT english"), numbers, "quality")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::DOUBLE ELSE 'nan'::DOUBLE END AS age, c_acctbal * 1000 AS dose, 'nan'::DOUBLE AS unasked FROM customer")
def d12_mapped_features(t):
    answers = t("customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("n/a").alias("edad"), F.col("c_acctbal").alias("gramos"))
    return models.mapped_features(answers, "c_custkey", {"age": "edad", "dose": "gramos", "unasked": "otra"}, {"dose": 1000.0})


@query()
def d13_target_risks(t):
    """Probabilities of two targets by the same features; fitted models aren't SQL."""
    d, numbers = _labelled(t), ["n_chars", "log_chars"]
    fitted = {y: models.fit_target(d, numbers, y) for y in ("quality", "toxic")}
    return models.target_risks(d, "doc_id", fitted, numbers, "1", "1", excluded=("none",))


def _answers(t):
    """A survey made of customers' fields: every answer comes from a column, so contradictions occur."""
    c = t("customer")
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n % len(v) + 1).cast("int"))
    some = lambda m, c: F.when(k % m != 0, c)
    lists = lambda n, *v: F.element_at(F.array(*[F.array(*[F.lit(y) for y in x]) if x else F.array().cast("array<string>") for x in v]), (k % n % len(v) + 1).cast("int"))
    return c.select(
        "c_custkey", pick(2, "masculino", "femenino").alias("sexo"), (b / 50).alias("weight_value"), pick(3, "kg", "LB", "g").alias("weight_unit"), F.lit(70.0).alias("weight_kg"), (F.col("c_nationkey") / 10 + 0.3).alias("height_value"), pick(4, "m", "ft", "xx", "cm").alias("height_unit"),
        some(5, F.lit(170.0)).alias("height_cm"), pick(3, "si", "no").alias("toma_suplementos"), lists(4, [], ["zinc"], ["zinc", "iron"]).alias("suplementos_actuales"), (k % 5 == 0).alias("suplementos_dosis_conocida"), F.create_map(F.lit("zinc"), F.lit(10.0)).alias("suplementos_dosis_actual"),
        lists(5, ["sin_restricciones"], ["sin_restricciones", "soya"], ["soya"]).alias("restricciones"), lists(7, ["ninguna"], ["ninguna", "renal"], ["embarazo_lactancia"], []).alias("condiciones_seguridad"), pick(6, "si", "no").alias("menstruacion_abundante"), some(3, F.lit("no")).alias("parto_ultimo_anio"),
        (k % 4).alias("exercise_days_week"), pick(5, "no_aplica", "fuerza").alias("training_type"), pick(9, "suenio_estres", "energia", "nutricion_general").alias("objetivo_principal"), lists(6, ["a", "b", "c"], ["suenio"], []).alias("objetivos"), (k % 3 == 0).alias("no_meat"),
        some(4, F.lit(2.0)).alias("red_meat_servings_week"), F.lit(1.5).alias("poultry_servings_week"), F.lit(None).cast("double").alias("meat_servings_week"), F.lit(None).cast("double").alias("dairy_servings_day"), (k % 15).alias("dairy_servings_week"), pick(4, "vegano", "mixto").alias("tipo_dieta"),
        F.lit(3).alias("anios_dieta_vegetal"), pick(8, "bajo", "medio", "alto", "sin_preferencia").alias("presupuesto"), some(2, F.lit(5.0)).alias("presupuesto_min"), F.lit(None).cast("double").alias("presupuesto_max"),
    )


def _pick(n, *v):
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else "[" + ", ".join(f"'{y}'" for y in x) + "]::VARCHAR[]" for x in v) + f"][c_custkey % {n} % {len(v)} + 1]"


_ANSWERS = f"""a AS (SELECT c_custkey, {_pick(2, "masculino", "femenino")} AS sexo, c_acctbal / 50 AS wv, {_pick(3, "kg", "LB", "g")} AS wu, c_nationkey / 10 + 0.3::DOUBLE AS hv, {_pick(4, "m", "ft", "xx", "cm")} AS hu, CASE WHEN c_custkey % 5 <> 0 THEN 170.0 END AS hc, {_pick(3, "si", "no")} AS ts,
  {_pick(4, [], ["zinc"], ["zinc", "iron"])} AS sa, c_custkey % 5 = 0 AS dk, {_pick(5, ["sin_restricciones"], ["sin_restricciones", "soya"], ["soya"])} AS re, {_pick(7, ["ninguna"], ["ninguna", "renal"], ["embarazo_lactancia"], [])} AS cs, {_pick(6, "si", "no")} AS ma, c_custkey % 4 AS ex, {_pick(5, "no_aplica", "fuerza")} AS tt,
  {_pick(9, "suenio_estres", "energia", "nutricion_general")} AS op, {_pick(6, ["a", "b", "c"], ["suenio"], [])} AS ob, c_custkey % 3 = 0 AS nm, CASE WHEN c_custkey % 4 <> 0 THEN 2.0 END AS rm, c_custkey % 15 AS dw, {_pick(4, "vegano", "mixto")} AS td, {_pick(8, "bajo", "medio", "alto", "sin_preferencia")} AS bu, CASE WHEN c_custkey % 2 <> 0 THEN 5.0 END AS bm FROM customer),
b AS (SELECT *, wv * CASE lower(wu) WHEN 'kg' THEN 1 WHEN 'lb' THEN 0.45359237 ELSE 0.001 END::DOUBLE AS kg, coalesce(hv * CASE hu WHEN 'm' THEN 100 WHEN 'ft' THEN 30.48 WHEN 'cm' THEN 1 END::DOUBLE, hc)::DOUBLE AS cm FROM a)"""


@query(f"""WITH {_ANSWERS} SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT kg BETWEEN 2 AND 500 THEN 'weight_range' END, CASE WHEN NOT cm BETWEEN 40 AND 260 THEN 'height_range' END, CASE WHEN ts = 'si' AND len(sa) = 0 THEN 'supplements_missing' END, CASE WHEN ts = 'no' AND len(sa) > 0 THEN 'supplements_unexpected' END,
  CASE WHEN list_contains(re, 'sin_restricciones') AND len(re) > 1 THEN 'no_restrictions_combined' END, CASE WHEN list_contains(cs, 'ninguna') AND len(cs) > 1 THEN 'no_safety_condition_combined' END, CASE WHEN sexo = 'masculino' AND list_contains(cs, 'embarazo_lactancia') THEN 'pregnancy_of_a_man' END,
  CASE WHEN sexo = 'masculino' AND ma = 'si' THEN 'menstruation_of_a_man' END, CASE WHEN ex = 0 AND tt <> 'no_aplica' THEN 'training_without_days' END, CASE WHEN ex > 0 AND tt = 'no_aplica' THEN 'days_without_training' END, CASE WHEN ts = 'si' AND dk AND list_contains(sa, 'iron') THEN 'dose_missing' END], lambda e: e IS NOT NULL), ';') AS errors FROM b""")
def p17_survey_errors(t):
    return survey.normalised_survey(_answers(t)).withColumn("suplementos_dosis_actual", F.create_map(F.lit("zinc"), F.lit(10.0))).select("c_custkey", F.array_join(survey.survey_errors(), ";").alias("errors"))


@query(f"""WITH {_ANSWERS} SELECT c_custkey, round(kg, 6) AS weight_kg, round(cm, 6) AS height_cm, round(kg / ((cm / 100) * (cm / 100)), 2) + 0::DOUBLE AS bmi, array_to_string(CASE op WHEN 'energia' THEN CASE WHEN len(ob) < 4 THEN ob || ['energia'] ELSE ob END WHEN 'suenio_estres' THEN CASE WHEN ob = ['a', 'b', 'c'] THEN ob || ['suenio'] WHEN ob = ['suenio'] THEN ob || ['estres'] ELSE ['suenio', 'estres'] END ELSE ob END, '|') AS objetivos,
  CASE WHEN nm THEN 0 ELSE rm + 1.5 END::DOUBLE AS meat_servings_week, round(dw / 7, 4)::DOUBLE AS dairy_servings_day, CASE WHEN td = 'vegano' THEN 3 END AS anios_dieta_vegetal, CASE WHEN bu = 'sin_preferencia' THEN NULL WHEN bm IS NOT NULL THEN bm WHEN bu = 'bajo' THEN 0 WHEN bu = 'medio' THEN 80 ELSE 200 END::DOUBLE AS presupuesto_min,
  CASE WHEN bu = 'sin_preferencia' OR bm IS NOT NULL THEN NULL WHEN bu = 'bajo' THEN 80 WHEN bu = 'medio' THEN 200 ELSE 500 END::DOUBLE AS presupuesto_max, (ts = 'si' AND dk AND list_contains(sa, 'zinc'))::INT AS doses FROM b""")
def d8_normalised_survey(t):
    out = survey.normalised_survey(_answers(t))
    return out.select(
        "c_custkey", F.round("weight_kg", 6).alias("weight_kg"), F.round("height_cm", 6).alias("height_cm"), (F.col("bmi") + F.lit(0.0)).alias("bmi"), F.array_join("objetivos", "|").alias("objetivos"), "meat_servings_week", "dairy_servings_day", "anios_dieta_vegetal", "presupuesto_min", "presupuesto_max", F.size("suplementos_dosis_actual").alias("doses")
    )


_SOFT = ("fruit_veg_servings_day", "fruit_veg_servings_day_reported", "dieta_deficiente", "enfermedad_frecuente", "meta_inmunidad", "protein_g_day_estimate", "protein_g_day_estimate_reported", "peso_kg", "meta_rendimiento", "caida_cabello", "screen_hours_day", "fermented_foods_week", "water_intake_l_day", "fatiga_general", "fish_servings_week", "edad", "niebla_mental", "problemas_sueno", "calambres", "digestive_discomfort")
#: Each answer's number of values and its least one.
_RANGE = dict(zip(_SOFT, ((6, -1), (2, 0), (2, 0), (6, 0), (2, 0), (120, 20), (2, 0), (60, 40), (2, 0), (6, 0), (12, -1), (5, -1), (4, -1), (6, 1), (4, -1), (60, 20), (4, 1), (6, 1), (5, 1), (5, 1)), strict=True))


@query("WITH f AS (SELECT c_custkey, " + ", ".join(f"(c_custkey * {7 + 2 * i} % {n} + {low})::DOUBLE AS {name}" for i, (name, (n, low)) in enumerate(_RANGE.items())) + """, CASE WHEN c_nationkey % 3 = 0 THEN 'activo' ELSE 'bajo' END AS act, CASE c_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS st FROM customer),
g AS (SELECT *, CASE WHEN protein_g_day_estimate_reported = 1 THEN greatest(0, peso_kg * CASE WHEN act = 'activo' THEN 1.2 ELSE 0.85 END - protein_g_day_estimate) ELSE -1 END::DOUBLE AS gap FROM f)
SELECT c_custkey, (fruit_veg_servings_day_reported = 1 AND fruit_veg_servings_day <= 2 AND (dieta_deficiente = 1 OR enfermedad_frecuente >= 4 OR meta_inmunidad = 1))::INT AS vitamin_c_diet_signal, round(gap, 2) AS protein_gap_g_day,
  (protein_g_day_estimate_reported = 1 AND (protein_g_day_estimate < 55 OR gap >= 20 OR (act = 'activo' AND gap >= 12 AND meta_rendimiento = 1)))::INT AS protein_insufficient_signal, (caida_cabello >= 4)::INT + coalesce(st = 'low', false)::INT AS hair_skin_nails_cluster,
  (screen_hours_day >= 6 AND (fruit_veg_servings_day_reported <> 1 OR fruit_veg_servings_day <= 2))::INT AS visual_strain_signal, (digestive_discomfort >= 3 OR (fermented_foods_week BETWEEN 0 AND 1 AND dieta_deficiente = 1))::INT AS digestive_support_signal,
  (water_intake_l_day BETWEEN 0 AND 1.2 OR calambres >= 3)::INT AS hydration_electrolyte_signal, (fatiga_general >= 4 AND dieta_deficiente = 1)::INT AS fatigue_nutrition_signal, (coalesce(st = 'high', false) OR (edad >= 50 AND fish_servings_week BETWEEN 0 AND 1))::INT AS cardiovascular_context_signal,
  (niebla_mental >= 3 OR (problemas_sueno >= 4 AND fatiga_general >= 3))::INT AS cognitive_context_signal FROM g""")
def d6_soft_signals(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    answers = [(k * (7 + 2 * i) % m + low).cast("double").alias(name) for i, (name, (m, low)) in enumerate(_RANGE.items())]
    state = F.when(n % 4 == 0, "low").when(n % 4 == 1, "high")
    c = t("customer").select("c_custkey", *answers, F.when(n % 3 == 0, "activo").otherwise("bajo").alias("nivel_actividad"), state.alias("lab_zinc_status"), state.alias("lab_ldl_status"))
    return survey.soft_signals(c).select("c_custkey", *list(survey.soft_signals(c).columns)[len(c.columns) :])


@query("""WITH p AS (SELECT p_partkey, p_size % 8 AS k, p_size % 5 AS j FROM part) SELECT p_partkey, k IN (0) AS contains_fish_inferred, k IN (1) AS contains_shellfish_inferred, k IN (2, 3) AS contains_gelatin_inferred, k = 2 AS softgel_inferred, k = 4 AS contains_lactose_inferred, k = 5 AS contains_dairy_inferred, k = 6 AS contains_soy_inferred, k = 6 AS contains_soya_inferred, k = 7 AS gluten_free_inferred,
  j = 0 AS contains_fish, j = 1 AS contains_shellfish, j IN (2, 4) AS contains_gelatin, j = 4 AS softgel_verified, j = 3 AS contains_dairy, j = 3 AS contains_lactose, false AS contains_soy, false AS contains_soya, j = 2 AS gluten_free_verified FROM p""")
def f15_restriction_flags(t):
    k, j = F.col("p_size") % 8, F.col("p_size") % 5
    at = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    text = F.concat(F.col("p_name"), F.lit(" "), at(k, "omega 3 epa", "mariscos", "capsulas blandas", "gelatina", "lactosa", "suero de leche", "lecitina de soya", "libre de gluten"))
    flags = survey.restriction_flags(text, at(j, "aceite de pescado", "crustaceos", "gelatin", "lactose", "soybean"), F.when(j == 4, "softgel"), F.when(j == 2, "Verified"))
    return t("part").select("p_partkey", *[c.alias(name) for name, c in flags.items()])


@query("""WITH s AS (SELECT doc_id, lang, least(1, n_chars / 4000.0::DOUBLE) AS p, quality AS y, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 50 AS cal FROM documents JOIN labels USING (doc_id)),
m AS (SELECT lang, cal, g / 100 AS t, count_if(y = 1 AND floor(round(p * 100, 6)) >= g) AS tp, count_if(y = 0 AND floor(round(p * 100, 6)) >= g) AS fp, count_if(y = 1 AND floor(round(p * 100, 6)) < g) AS fn, count_if(y = 0 AND floor(round(p * 100, 6)) < g) AS tn FROM s, range(1, 100) r(g) GROUP BY ALL),
k AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS spec FROM m),
o AS (SELECT * FROM k WHERE t = 0.5), c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, rec DESC, spec DESC, t) AS rn FROM k WHERE cal AND spec >= 0.5),
x AS (SELECT oc.lang, CASE WHEN oc.tp + oc.fn < 10 OR oc.tn + oc.fp < 10 THEN 'insufficient_calibration_labels' WHEN c.t IS NULL THEN 'no_threshold_meets_specificity_floor' WHEN c.f1 <= oc.f1 THEN 'original_threshold_not_worse' ELSE 'candidate' END AS status, c.t AS best FROM o oc LEFT JOIN c ON c.lang = oc.lang AND rn = 1 WHERE oc.cal),
z AS (SELECT x.lang, status, CASE WHEN status = 'candidate' THEN best ELSE 0.5 END AS t FROM x)
SELECT z.lang, status, round(z.t, 2)::DOUBLE AS threshold, status = 'candidate' AND e.f1 >= oe.f1 AND e.spec >= greatest(0.5, oe.spec - 0.02) AND z.t >= 0.05 AS accepted FROM z JOIN k e ON e.lang = z.lang AND NOT e.cal AND e.t = z.t JOIN o oe ON oe.lang = z.lang AND NOT oe.cal""")
def l4_calibrated_thresholds(t):
    d = t("documents").select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p")).join(t("labels").select("doc_id", "quality"), "doc_id")
    return evaluation.calibrated_thresholds(d, "lang", F.col("doc_id").cast("string"), F.col("p"), F.col("quality"), original=0.5, floor=0.5, least=0.05)


@query("""WITH y AS (SELECT doc_id, unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS y, unnest([(n_chars > 1000)::INT, (n_chars > 4000)::INT]) AS z FROM documents JOIN labels USING (doc_id)),
l AS (SELECT label, sum(y * z) AS tp, sum((1 - y) * z) AS fp, sum(y * (1 - z)) AS fn FROM y GROUP BY 1), s AS (SELECT doc_id, sum(y * z) AS tp, sum(y) AS a, sum(z) AS b, min((y = z)::INT) AS same, sum((y <> z)::INT) AS wrong, count(*) AS k FROM y GROUP BY 1)
SELECT (SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) FROM l) AS macro_f1, (SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) FROM l) AS micro_f1, (SELECT round(avg(CASE WHEN a + b > 0 THEN 2 * tp / (a + b) ELSE 0 END), 6) FROM s) AS sample_f1, (SELECT round(avg(same), 6) FROM s) AS exact_match, (SELECT round(sum(wrong) / sum(k), 6) FROM s) AS hamming""")
def a17_multilabel_f1(t):
    j = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id")
    return evaluation.multilabel(j, {"quality": (F.col("quality"), F.col("n_chars") > 1000), "toxic": (F.col("toxic"), F.col("n_chars") > 4000)})


@query("""WITH shown AS (SELECT l_orderkey AS session, l_partkey AS item, min(l_returnflag) AS condition FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey AS session, l_partkey + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS item, max(l_linenumber) AS rating FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2)
SELECT f.session, f.item, rating, condition, condition IS NULL AS ignored FROM f LEFT JOIN shown USING (session, item)""")
def j16_feedback_on_shown(t):
    """Votes on items: the condition is the shown item's, and votes on what wasn't shown are marked as ignored."""
    li = t("lineitem")
    shown = li.groupBy(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("item")).agg(F.min("l_returnflag").alias("condition"))
    item = F.col("l_partkey") + F.when(F.col("l_linenumber") == 3, 1).otherwise(0)
    votes = li.filter("l_linenumber >= 2").groupBy(F.col("l_orderkey").alias("session"), item.alias("item")).agg(F.max("l_linenumber").alias("rating"))
    return votes.join(shown, ["session", "item"], "left").select("session", "item", "rating", "condition", F.col("condition").isNull().alias("ignored"))


GROUPS = [("c_acctbal", "observed_lab"), ("n_orders", "declared_diet"), ("max_price", "self_reported_symptoms"), ("c_mktsegment", "derived_soft_signal")]


@query(_HITS + f""", g(field, grp) AS (VALUES {_values(GROUPS)}), s AS (SELECT c_custkey, cond, coalesce(grp, 'survey_context') AS grp, round(sum(weight), 4) AS weight, count(*) AS n, list_sort(list(DISTINCT h.field)) AS drivers FROM h LEFT JOIN g ON g.field = h.field GROUP BY ALL),
x AS (SELECT *, CASE WHEN grp = 'observed_lab' THEN 'alta' WHEN grp IN ('declared_diet', 'self_reported_symptoms') AND (weight >= 0.30 OR n >= 2) THEN 'media' ELSE 'baja' END AS strength FROM s),
p AS (SELECT c_custkey, cond, arg_min(grp, list_position(['observed_lab', 'medical_safety', 'declared_diet', 'self_reported_symptoms', 'restrictions', 'profile_context', 'survey_context', 'derived_soft_signal'], grp)) AS primary_group, count(*) AS ng, list(grp) AS gs, sum(weight) AS score FROM x GROUP BY 1, 2)
SELECT x.c_custkey, x.cond, grp AS "group", weight::DOUBLE AS weight, n, array_to_string(drivers, '|') AS drivers, strength, primary_group, CASE WHEN primary_group = 'observed_lab' AND x.c_custkey % 2 = 0 THEN 'medical_safety' WHEN primary_group IN ('observed_lab', 'declared_diet', 'self_reported_symptoms') THEN primary_group ELSE 'self_reported' END AS evidence_level,
  CASE WHEN primary_group = 'observed_lab' THEN 'alta' WHEN primary_group IN ('declared_diet', 'self_reported_symptoms') THEN CASE WHEN score >= 0.45 OR ng >= 2 THEN 'media' ELSE 'baja' END WHEN score >= 0.55 THEN 'media' ELSE 'baja' END AS signal_strength FROM x JOIN p ON p.c_custkey = x.c_custkey AND p.cond = x.cond""")
def d10_primary_signals(t):
    h = _hits(t)[0]
    g = decisions.signal_groups(h, "c_custkey", h.sparkSession.createDataFrame(GROUPS, "field string, group string"))
    p = decisions.primary_signals(g, "c_custkey", F.sum("weight"), F.first(F.col("c_custkey") % 2 == 0)).drop("n_groups")
    return g.join(p, ["c_custkey", "cond"]).withColumn("drivers", F.array_join("drivers", "|"))


@query("""WITH d AS (SELECT c_custkey, ['a', 'b'][c_custkey % 2 + 1] AS cond, c_nationkey > 18 AS positive, c_custkey % 11 = 0 AS suppressed, c_custkey % 3 = 0 AS corroborated, round(c_nationkey / 40, 4) AS rs, 0.4 AS rt, round(abs(c_acctbal) / 20000, 8) AS p, CASE WHEN c_custkey % 5 = 0 THEN ['sun', 'x'] ELSE ['x'] END AS fam FROM customer),
o AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN 0.5 END AS est FROM d), r AS (SELECT *, CASE WHEN est IS NOT NULL AND NOT positive AND NOT suppressed AND corroborated AND rs >= 0.25 THEN 'borderline' WHEN est IS NOT NULL AND NOT positive AND NOT suppressed AND cond = 'a' AND list_contains(fam, 'sun') THEN 'complementary_family' END AS reason FROM o)
SELECT c_custkey, cond, positive OR reason IS NOT NULL AS positive, CASE WHEN reason IS NOT NULL THEN greatest(p, est) ELSE p END::DOUBLE AS probability, reason FROM r""")
def d11_second_opinions(t):
    k = F.col("c_custkey")
    cond = F.when(k % 2 == 0, "a").otherwise("b")
    families = F.when(k % 5 == 0, F.array(F.lit("sun"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    d = t("customer").select("c_custkey", cond.alias("cond"), (F.col("c_nationkey") > 18).alias("positive"), (k % 11 == 0).alias("suppressed"), (k % 3 == 0).alias("corroborated"), F.round(F.col("c_nationkey") / 40, 4).alias("rule_score"), F.lit(0.4).alias("rule_threshold"), F.round(F.abs("c_acctbal") / 20000, 8).alias("probability"), families.alias("families"))
    o = d.filter("c_custkey % 4 != 0").select("c_custkey", "cond", F.lit(0.5).alias("estimate"))
    more = d.sparkSession.createDataFrame([("a", "sun"), ("a", "sun_barrier")], "cond string, family string")
    return decisions.second_opinions(d, "c_custkey", o, more).select("c_custkey", "cond", "positive", "probability", "reason")


@query("""WITH i AS (SELECT DISTINCT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'Vitamina D3 gotas' WHEN 1 THEN 'Citrato de Magnesio' ELSE 'Colageno' END AS name FROM lineitem), t AS (SELECT o_orderkey, o_orderkey % 4 AS k, (o_custkey % 120 + 1)::DOUBLE AS a FROM orders WHERE o_orderkey % 4 <> 3)
SELECT l_orderkey, name, s AS supplement, CASE WHEN s IS NULL THEN NULL WHEN a IS NULL THEN 'unknown' WHEN a >= hi THEN 'high' WHEN a < lo THEN 'low' ELSE 'covered' END AS dose_status, s IS NOT NULL AND NOT (a IS NOT NULL AND a < lo) AS blocked FROM (
  SELECT i.*, CASE WHEN name LIKE 'Vit%' AND k IN (0, 1) THEN 'vitamina_d' WHEN name LIKE 'Cit%' AND k IN (1, 2) THEN 'magnesio' END AS s, CASE WHEN name LIKE 'Vit%' THEN CASE WHEN k = 0 THEN a * 40 ELSE a * 40 END WHEN k = 2 THEN NULL ELSE a * 4 END AS a, CASE WHEN name LIKE 'Vit%' THEN 600 ELSE 100 END AS lo, CASE WHEN name LIKE 'Vit%' THEN 4000 ELSE 350 END AS hi FROM i LEFT JOIN t ON o_orderkey = l_orderkey)""")
def d28_current_doses(t):
    name = F.when(F.col("l_linenumber") % 3 == 0, "Vitamina D3 gotas").when(F.col("l_linenumber") % 3 == 1, "Citrato de Magnesio").otherwise("Colageno")
    items = t("lineitem").select("l_orderkey", name.alias("name")).distinct()
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4).alias("k"), (F.col("o_custkey") % 120 + 1).cast("double").alias("a"))
    d = o.filter("k IN (0, 1)").select("l_orderkey", F.lit(0).alias("place"), F.lit("vitamina_d").alias("supplement"), F.when(F.col("k") == 0, F.col("a")).otherwise(F.col("a") * 40).alias("amount"), F.when(F.col("k") == 0, "MCG").otherwise("UI").alias("unit"))
    m = o.filter("k IN (1, 2)").select("l_orderkey", F.lit(1).alias("place"), F.lit("magnesio").alias("supplement"), F.when(F.col("k") == 1, F.col("a") * 4).alias("amount"), F.lit("mg").alias("unit"))
    words = items.sparkSession.createDataFrame([("vitamina_d", "vitamina d"), ("vitamina_d", "colecalciferol"), ("magnesio", "magnesio")], "supplement string, keyword string")
    return decisions.current_doses(items, "l_orderkey", "name", d.unionByName(m), words)


@query("""WITH r AS (SELECT 's' || (o_custkey % 7) AS shop, CASE WHEN o_orderkey % 90 = 0 THEN 0 ELSE o_totalprice END AS price, o_orderdate AS seen_at FROM orders),
a AS (SELECT 's' || (l_suppkey % 7) AS shop, l_partkey::VARCHAR AS sku, 'c' || (l_partkey % 5) AS component, p_name AS name, 'r' || (l_partkey % 40) AS registry, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN 'zzz' ELSE '' END AS registered_name, l_extendedprice AS price, CASE WHEN l_tax > 0.07 THEN 'out' ELSE ' Available' END AS availability FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 2),
f AS (SELECT count_if(n > 5) AS over FROM (SELECT registry, count(DISTINCT lower(trim(name))) AS n FROM a GROUP BY 1)),
c AS (SELECT (SELECT count(*) FROM r) AS rr, (SELECT count(*) FROM a) AS ar, (SELECT count(DISTINCT shop) FROM r) AS rs, (SELECT count(DISTINCT shop) FROM a) AS sa, (SELECT round(avg((price <= 0)::INT), 4) FROM r) AS rb, (SELECT count_if(availability = 'out') FROM a) AS un, (SELECT count_if(regexp_matches(lower(name), '(^| )(lace|lavender)( |$)')) FROM a) AS ns, (SELECT over FROM f) AS fo,
  (SELECT count(*) - count(DISTINCT (lower(shop), sku, component)) FROM a) AS du, (SELECT count_if(registered_name = 'zzz') FROM a) AS nm, (SELECT floor(date_diff('second', max(seen_at), TIMESTAMP '2001-12-31 00:00:00') / 3600) FROM r) AS age)
SELECT unnest(['raw_rows', 'approved_rows', 'raw_shops', 'approved_shops', 'required_shops_missing', 'raw_bad_prices', 'approved_bad_prices', 'raw_age_hours', 'approved_unavailable', 'approved_non_supplements', 'approved_fan_out', 'approved_duplicates', 'approved_names_without_overlap']) AS "check",
  unnest(['error', 'error', 'error', 'error', 'error', 'error', 'error', 'error', 'error', 'error', 'error', 'warning', 'warning']) AS level, unnest([rr, ar, rs, sa, 1, rb, 0, age, un, ns, fo, du, nm]::DOUBLE[]) AS value,
  unnest([rr < 500, ar < 250, rs < 3, sa < 3, true, rb > 0.01, false, age > 48, un > 0, ns > 0, fo > 0, du > 0, nm > 0]) AS failed FROM c""")
def d38_catalog_gate(t):
    raw = t("orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string")).alias("shop"), F.when(F.col("o_orderkey") % 90 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("price"), F.col("o_orderdate").cast("timestamp").alias("seen_at"))
    li = t("lineitem").filter("l_linenumber <= 2").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey")
    other = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, "zzz").otherwise("")
    s = lambda c, n, p: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    approved = li.select(s("l_suppkey", 7, "s").alias("shop"), F.col("l_partkey").cast("string").alias("sku"), s("l_partkey", 5, "c").alias("component"), F.col("p_name").alias("name"), s("l_partkey", 40, "r").alias("registry"), other.alias("registered_name"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_tax") > 0.07, "out").otherwise(" Available").alias("availability"))
    return decisions.catalog_gate(raw, approved, F.lit("2001-12-31 00:00:00").cast("timestamp"), r"(^| )(lace|lavender)( |$)", 500, 250, 3, ("s1", "s9"))


@query("""WITH r AS (SELECT DISTINCT ON (l_partkey, l_suppkey, l_returnflag) l_partkey, l_suppkey, l_returnflag, l_linestatus AS status FROM lineitem WHERE l_quantity > 30 ORDER BY l_partkey, l_suppkey, l_returnflag, l_linestatus),
p AS (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_returnflag END AS flag FROM lineitem WHERE l_linenumber <= 3) SELECT p.l_partkey, p.l_suppkey, flag, coalesce(status, CASE WHEN flag IS NULL THEN 'not_required' ELSE 'pending' END) AS review FROM p LEFT JOIN r ON r.l_partkey = p.l_partkey AND r.l_suppkey = p.l_suppkey AND r.l_returnflag = flag""")
def p3_three_keys(t):
    """Review states by three keys; a null key asks for none."""
    li = t("lineitem")
    r = li.filter("l_quantity > 30").groupBy("l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag")).agg(F.min("l_linestatus").alias("status"))
    p = li.filter("l_linenumber <= 3").select("l_partkey", "l_suppkey", F.when(F.col("l_discount") <= 0.08, F.col("l_returnflag")).alias("flag")).distinct()
    return p.join(r, ["l_partkey", "l_suppkey", "flag"], "left").select("l_partkey", "l_suppkey", "flag", F.coalesce("status", F.when(F.col("flag").isNull(), "not_required").otherwise("pending")).alias("review"))


STAGES_OF_LIFE = [("child", "any", 4, 13, None), ("teen", "any", 14, 18, None), ("woman", "female", 19, 50, False), ("pregnant", "female", 14, 50, True), ("man", "male", 19, 50, None), ("older", "any", 51, 120, None)]


@query(f"""WITH s(stage, sex, lo, hi, pregnant) AS (VALUES {_values(STAGES_OF_LIFE)}), c AS (SELECT c_custkey, c_custkey % 90 AS age, CASE WHEN c_nationkey % 3 = 0 THEN 'male' WHEN c_nationkey % 3 = 1 THEN 'female' END AS sex, CASE WHEN c_custkey % 5 = 0 THEN true WHEN c_custkey % 5 = 1 THEN false END AS pregnant FROM customer)
SELECT c_custkey, stage FROM c JOIN s ON age BETWEEN lo AND hi AND (s.sex = 'any' OR s.sex = c.sex) AND (s.pregnant IS NULL OR s.pregnant = coalesce(c.pregnant, false))""")
def p10_life_stages(t):
    """Stages by age, sex and pregnancy; an unknown pregnancy counts as none, a stage without one fits both."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = t("customer").select("c_custkey", (k % 90).alias("age"), F.when(n % 3 == 0, "male").when(n % 3 == 1, "female").alias("sex"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("pregnant"))
    s = bounded(c.sparkSession.createDataFrame(STAGES_OF_LIFE, "stage string, s_sex string, lo int, hi int, s_pregnant boolean"), 1000, "life stages")
    fits = F.col("age").between(F.col("lo"), F.col("hi")) & ((F.col("s_sex") == "any") | (F.col("s_sex") == F.col("sex"))) & (F.col("s_pregnant").isNull() | (F.col("s_pregnant") == F.coalesce("pregnant", F.lit(False))))
    return c.join(s, fits).select("c_custkey", "stage")


@query("""WITH paired AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 90), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type = 'error') WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM paired)),
j AS (SELECT r.user_id, r.event_id, p.event_id AS survey_id, abs(epoch_us(r.ts) - epoch_us(p.ts)) AS gap_us, p.ts AS pt FROM r JOIN events p ON p.user_id = r.user_id AND p.event_type = 'purchase' AND abs(epoch_us(r.ts) - epoch_us(p.ts)) <= 10 * 86400 * 1000000::BIGINT)
SELECT user_id, event_id, survey_id, gap_us FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap_us, pt, survey_id) AS rn FROM j) WHERE rn = 1""")
def j14_newest_report_pairs(t):
    """The survey nearest to each user's newest report, within ten days; users that are paired already stay out."""
    e = t("events").select("event_id", "user_id", "ts", "event_type", "value")
    paired = e.filter("event_type = 'signup' AND value > 90").select("user_id").distinct()
    newest = ranking.best_per_key(e.filter("event_type = 'error'"), ["user_id"], [F.desc("ts"), F.col("event_id")], 1, "_rn").select("event_id", "user_id", "ts").join(paired, "user_id", "left_anti")
    surveys = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("survey_id"), F.col("ts").alias("survey_ts"))
    return matching.nearest_in_time(newest, surveys, ["user_id"], "ts", "survey_ts", 10 * 86400, "event_id", "survey_id").select("user_id", "event_id", "survey_id", "gap_us")


@query("""WITH e AS (SELECT p_brand AS component, p_partkey, p_name, p_size > 10 AS available, p_retailprice < 1500 AS safe, p_type AS shop FROM part), m AS (SELECT DISTINCT CASE WHEN component IN ('Brand#11', 'Brand#12') THEN 'Brand#11' ELSE component END AS component, p_partkey, p_name, available, safe, shop FROM e),
x AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY p_partkey) AS rn FROM m)
SELECT component, count(*) AS products, count_if(available)::BIGINT AS available, count_if(available AND safe)::BIGINT AS safe, count(DISTINCT shop) AS shops, array_to_string(list(p_name ORDER BY p_partkey) FILTER (WHERE rn <= 4), '|') AS examples FROM x GROUP BY 1""")
def a8_component_coverage(t):
    """Counts of a component and those that are equivalent to it, with its first four products."""
    p = t("part").select(F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "Brand#11").otherwise(F.col("p_brand")).alias("component"), "p_partkey", "p_name", (F.col("p_size") > 10).alias("available"), (F.col("p_retailprice") < 1500).alias("safe"), F.col("p_type").alias("shop"))
    four = ranking.best_per_key(p, ["component"], [F.col("p_partkey")], 4, "_rn").groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "p_name"))), lambda x: x["p_name"]), "|").alias("examples"))
    n = p.groupBy("component").agg(F.count("*").alias("products"), F.count_if("available").alias("available"), F.count_if(F.col("available") & F.col("safe")).alias("safe"), F.countDistinct("shop").alias("shops"))
    return n.join(four, "component")


@query("""WITH c AS (SELECT source, count(*) AS n, count(quality) AS k, count_if(quality = 1) AS pos, avg((n_chars > 500)::INT) FILTER (WHERE quality = 1) AS recall FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, pos, round(recall, 4) AS recall, CASE WHEN recall < 0.50 AND pos >= 20 THEN 'alto' WHEN recall < 0.80 THEN 'medio' ELSE 'bajo' END AS risk FROM c""")
def d41_missed_risk(t):
    """The risk of missed positives by source: high below half with twenty positives or more."""
    j = t("documents").select("doc_id", "source", (F.col("n_chars") > 500).cast("int").alias("hit")).join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    c = j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.avg(F.when(F.col("quality") == 1, F.col("hit"))).alias("recall"))
    r = F.col("recall")
    return c.select("source", "pos", F.round(r, 4).alias("recall"), F.when((r < 0.50) & (F.col("pos") >= 20), "alto").when(r < 0.80, "medio").otherwise("bajo").alias("risk"))


#: Closed answers and amounts of a made-up survey: name to its values; null is one of them where a person may skip it.
CLOSED = {
    "edad_rango": list(payload.AGE), "horas_sueno": list(payload.SLEEP), "frecuencia_ejercicio": list(payload.EXERCISE), "fatiga": list(payload.FATIGUE), "exposicion_solar": list(payload.SUN), "frecuencia_enfermedad": list(payload.ILLNESS), "estres": list(payload.STRESS), "alcohol": [*payload.ALCOHOL, None],
    "tipo_dieta": ["omnivoro", "pescetariano", "vegetariano", "vegano"], "dieta": ["poco_variada", "regular", "variada"], **{s: [*payload.SEVERITY, None] for s in (*payload.SYMPTOMS, "digestive_discomfort")}, "peso_rango": [*payload.WEIGHT, None], "talla_rango": [*payload.HEIGHT, None], "sexo": ["femenino", "masculino", None],
    "sleep_quality": [*payload.SLEEP_QUALITY, None], "night_wakeups": [*payload.WAKEUPS, None], "caffeine_after_3pm": [*payload.CAFFEINE, None], "recovery_difficulty": [*payload.RECOVERY, None], "fatiga_duracion": ["menos_2_semanas", "mas", None], "fatiga_mejora_descanso": ["si", "no", None],
    "alimentos_fortificados_b12": ["si", "no", None], "anios_dieta_vegetal": ["menos_1", "1_3", "mas_3", None], "iron_anemia_history": ["si", "no", "no", None], "menstruacion_abundante": ["si", "no", None], "parto_ultimo_anio": ["si", "no", None], "dona_sangre": ["2_o_mas_al_anio", "no", None], "piel_expuesta": ["cara_manos", "mas", None],
}
AMOUNTS = {
    "age_years": 90, "weight_kg": 120, "height_cm": 200, "exercise_days_week": 8, "alcohol_drinks_week": 20, "fish_servings_week": 4, "dairy_servings_day": 4, "dairy_servings_week": 15, "legume_servings_week": 6, "red_meat_servings_week": 6, "poultry_servings_week": 6, "eggs_servings_week": 8, "meat_servings_week": 6,
    "fruit_veg_servings_day": 5, "protein_g_day_estimate": 120, "fermented_foods_week": 5, "water_intake_l_day": 4, "screen_hours_day": 12, "heavy_sweat_days_week": 7, "headache_days_week": 7, "fatigue_days_week": 8, "caffeine_servings_day": 6,
}


def made_answers(customers):
    """Answers picked by a hash of customer and question; a third of the amounts isn't given."""
    pick = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "c_custkey"), F.lit(n)).cast("int")
    closed = [F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), pick(name, len(values)) + 1).alias(name) for name, values in CLOSED.items()]
    amounts = [F.when(pick(f"{name}?", 3) > 0, pick(name, most).cast("double") + (40 if name in ("weight_kg", "height_cm") else 0)).alias(name) for name, most in AMOUNTS.items()]
    taken = F.element_at(F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in ([], ["proteina"], ["vitamina_b12", "zinc"], ["multivitaminico", "proteina"])]), pick("taken", 4) + 1)
    return customers.select("c_custkey", *closed, *amounts, taken.alias("suplementos_actuales"), F.when(pick("dose", 2) == 0, F.create_map(F.lit("proteina"), F.lit(30.0))).alias("suplementos_dosis_actual"), F.when(pick("drug", 3) == 0, F.array(F.lit("metformina"))).alias("medicamentos_b12"))


@query()
def d8_payload(t):
    """A model's features of every customer; a plain version holds it in the tests."""
    return payload.payload(made_answers(t("customer")), "c_custkey")


@query("""WITH p AS (SELECT CASE p_size % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'preferred' ELSE 'retired' END AS status, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 11 = 0 THEN NULL ELSE p_brand END AS registry, CASE p_size % 4 WHEN 0 THEN 'digemid_name_match' WHEN 1 THEN 'image_ocr' END AS src, p_size % 5 = 0 AS vf, p_size % 2 = 0 AS inf, CASE WHEN p_size % 3 = 1 THEN 'label' ELSE '' END AS ls, CASE WHEN p_size > 25 THEN 1 END AS la, CASE p_partkey % 3 WHEN 0 THEN 'Alta' WHEN 1 THEN 'media' ELSE 'BAJA' END AS conf FROM part),
c AS (SELECT count(*) AS products_total, count_if(status <> 'retired') AS active_products, count_if(registry <> '') AS products_with_registro_sanitario, count_if(vf) AS products_with_verified_restriction_flags, count_if(inf) AS products_with_inferred_restriction_flags, count_if(ls <> '') AS products_with_label_source, count(la) AS products_with_recent_label_review,
  count_if(coalesce(registry, '') = '') AS products_without_registro_sanitario, count_if(src = 'digemid_name_match') AS products_with_digemid_name_match, count_if(src = 'image_ocr') AS products_with_image_ocr_rs, count_if(conf = 'BAJA') AS products_with_low_commercial_confidence, count_if(conf = 'media') AS products_with_medium_commercial_confidence, count_if(conf = 'Alta') AS products_with_high_commercial_confidence,
  round(count_if(registry <> '') / count(*), 4) AS traceability_rate, round(count_if(ls <> '') / count(*), 4) AS verified_label_rate FROM p)
SELECT *, 'traceability_below_95;few_label_sources;components_of_low_rotation' AS warnings FROM c""")
def a28_catalog_quality(t):
    s, p = F.col("p_size"), t("part")
    products = p.select(
        F.when(s % 3 == 0, "active").when(s % 3 == 1, "preferred").otherwise("retired").alias("status"), F.when(s % 7 == 0, "").when(s % 11 != 0, F.col("p_brand")).alias("registry"), F.when(s % 4 == 0, "digemid_name_match").when(s % 4 == 1, "image_ocr").alias("registry_source"), (s % 5 == 0).alias("verified_flags"), (s % 2 == 0).alias("inferred_flags"),
        F.when(s % 3 == 1, "label").otherwise("").alias("label_source"), F.when(s > 25, F.lit(1)).alias("label_at"), F.when(F.col("p_partkey") % 3 == 0, "Alta").when(F.col("p_partkey") % 3 == 1, "media").otherwise("BAJA").alias("confidence"),
    )
    got = decisions.catalog_quality(products, p.filter("p_size > 1000"), p.filter("p_size < 3"))
    return got.withColumn("warnings", F.array_join("warnings", ";"))
