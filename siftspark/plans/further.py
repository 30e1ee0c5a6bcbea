"""Queries that round off the inventory: sources, lookups, keys, states, metrics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.functions import scores as S
from siftspark.functions import text as X
from siftspark.operators import catalog, evaluation, graph, linkmodel, ranking, safety, survey
from siftspark.plans.core import query
from siftspark.sources import writers


@query("SELECT p_partkey, p_retailprice, p_brand FROM part WHERE p_retailprice IS NOT NULL AND p_size > 2 AND p_brand <> ''")
def s3_filtered_scan(t):
    return t("part").filter("p_retailprice IS NOT NULL AND p_size > 2 AND p_brand != ''").select("p_partkey", "p_retailprice", "p_brand")


@query("""SELECT 'c_custkey' AS "column", 'bigint' AS kind, count_if(c_custkey IS NULL)::BIGINT AS n_null FROM customer UNION ALL SELECT 'c_name', 'string', count_if(c_name IS NULL) FROM customer UNION ALL SELECT 'c_nationkey', 'int', count_if(c_nationkey IS NULL) FROM customer
UNION ALL SELECT 'c_acctbal', 'double', count_if(c_acctbal IS NULL) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count_if(c_mktsegment IS NULL) FROM customer""")
def s8_inspection(t):
    return writers.inspected(t("customer"))


@query("SELECT page_id, CASE WHEN left(x, 1) IN ('=', '+', '@', '-') THEN '''' || x ELSE x END AS cell FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '=' || url ELSE url END AS x FROM pages)")
def s17_safe_cells(t):
    x = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("="), F.col("url"))).otherwise(F.col("url"))
    return t("pages").select("page_id", writers.safe_cell(x).alias("cell"))


@query("SELECT o_orderkey, i - 1 AS item_no, x AS item FROM (SELECT o_orderkey, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS xs FROM lineitem GROUP BY 1))")
def s19_nested_items(t):
    packs = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array(F.struct(F.array_sort(F.collect_set("l_partkey")).alias("items"))).alias("packs"))
    return writers.nested_parts(packs, "o_orderkey", "packs", "items")[2].drop("pack_no")


@query("""SELECT 'orders_total{o_orderstatus="' || o_orderstatus || '",o_orderpriority="' || o_orderpriority || '"} ' || count(*) AS line FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def s20_metric_text(t):
    n = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return writers.metric_text(n, "orders_total", ["o_orderstatus", "o_orderpriority"], "n")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' OR json_extract_string(props, '$.k')::INT > 95")
def p6_json_predicates(t):
    k = F.get_json_object("props", "$.k")
    return t("events").filter((k == "7") | (k.cast("int") > 95)).select("event_id")


@query("""SELECT c_custkey, kind FROM customer JOIN (VALUES ('any', ''), ('lab', ''), ('segment', 'BUILDING'), ('segment', 'FURNITURE')) r(kind, val) ON kind = 'any' OR (kind = 'lab' AND c_acctbal > 5000) OR (kind = 'segment' AND val = c_mktsegment)""")
def p11_applicability(t):
    c = t("customer")
    r = c.sparkSession.createDataFrame([("any", ""), ("lab", ""), ("segment", "BUILDING"), ("segment", "FURNITURE")], "kind string, val string")
    k = F.col("kind")
    return c.join(F.broadcast(r), (k == "any") | ((k == "lab") & (F.col("c_acctbal") > 5000)) | ((k == "segment") & (F.col("val") == F.col("c_mktsegment")))).select("c_custkey", "kind")


@query("""WITH v(seg, second) AS (VALUES ('BUILDING', 'lacteos'), ('MACHINERY', 'soya')), w AS (SELECT o_custkey, list_distinct(list(c_mktsegment) || list(o_orderpriority)) AS w FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_distinct(w || coalesce((SELECT list(second) FROM v WHERE list_contains(w, seg)), []))), ' ') AS expanded FROM w""")
def p12_alias_expansion(t):
    """A customer's segment and priorities as restrictions, of which two have a second name."""
    own = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").groupBy("o_custkey").agg(F.array_union(F.collect_set("c_mktsegment"), F.collect_set("o_orderpriority")).alias("w"))
    return own.select("o_custkey", F.array_join(F.array_sort(survey.with_aliases(F.col("w"), {"BUILDING": "lacteos", "MACHINERY": "soya"})), " ").alias("expanded"))


@query("SELECT conv_id FROM (SELECT conv_id, to_json(list(role ORDER BY turn) FILTER (WHERE role = 'system')) AS a, to_json(list(turn ORDER BY turn)) AS b FROM conversations GROUP BY 1) WHERE json_type(coalesce(a, '[]')) = 'ARRAY' AND json_array_length(coalesce(a, '[]')) > 0 AND json_extract(b, '$[0]')::INT = 0 AND json_array_length(b) > 3")
def p6_json_arrays(t):
    """Conversations whose JSON of system turns is an array that isn't empty, and whose turns are more than three."""
    of = lambda c, test: F.to_json(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("turn", F.col(c).alias("own"))))), lambda x: x["own"]))
    j = t("conversations").groupBy("conv_id").agg(of("role", F.col("role") == "system").alias("a"), of("turn", F.lit(True)).alias("b"))
    return j.filter((F.json_array_length("a") > 0) & (F.get_json_object("b", "$[0]") == "0") & (F.json_array_length("b") > 3)).select("conv_id")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_discount > 0.05) AS blocked, max(l_quantity) AS q FROM lineitem GROUP BY 1) WHERE NOT blocked AND q > 10")
def p13_pack_eligibility(t):
    bad = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)
    items = t("lineitem").groupBy("l_orderkey").agg(F.bool_or(bad).alias("bad"), F.max("l_quantity").alias("most"))
    return items.filter("NOT bad AND most > 10").select("l_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(p_type, 'PROMO|ECONOMY')")
def p16_hint_filter(t):
    return t("part").filter(~F.col("p_type").rlike("PROMO|ECONOMY")).select("p_partkey")


@query("""SELECT l_partkey, s_name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') = 'BRAND12' GROUP BY 1, 2""")
def j3_registry_components(t):
    reg = t("part").filter(X.registry_key(F.col("p_brand")) == "BRAND12").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").select("l_partkey", "l_suppkey").join(reg, "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").groupBy("l_partkey", "s_name").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem LEFT JOIN orders ON substr(lpad(l_orderkey::VARCHAR, 8, '0'), 1, 8)::BIGINT = o_orderkey AND l_linestatus = o_orderstatus WHERE l_linenumber = 1""")
def j7_composite_key(t):
    li = t("lineitem").filter("l_linenumber = 1").withColumn("o_orderkey", F.substring(F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), 1, 8).cast("long")).withColumn("k", F.col("l_linestatus"))
    o = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("k"), "o_orderstatus")
    return li.join(o, ["o_orderkey", "k"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus")


@query("""WITH p(name, profile) AS (VALUES ('blue', 1), ('red', 2), ('green', 3)), c AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS name, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
SELECT p_partkey, arg_min(profile, i)::INT AS profile FROM c JOIN p USING (name) GROUP BY 1""")
def j9_ordered_fallback(t):
    p = t("part")
    profiles = p.sparkSession.createDataFrame([("blue", 1), ("red", 2), ("green", 3)], "name string, profile int")
    c = p.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "name"))
    return c.join(F.broadcast(profiles), "name").groupBy("p_partkey").agg(F.min_by("profile", "i").alias("profile"))


@query("""WITH a(alias, id) AS (VALUES ('almond antique', 1), ('antique', 2), ('blue', 3)), m AS (SELECT p_partkey, id, length(alias) AS l FROM part JOIN a ON contains(' ' || p_name || ' ', ' ' || alias || ' '))
SELECT p_partkey, arg_max(id, l)::INT AS id FROM m GROUP BY 1""")
def j13_longest_alias(t):
    p = t("part")
    a = p.sparkSession.createDataFrame([("almond antique", 1), ("antique", 2), ("blue", 3)], "alias string, id int")
    j = p.join(F.broadcast(a), X.holds_phrase(F.col("p_name"), F.col("alias")))
    return j.groupBy("p_partkey").agg(F.max_by("id", F.length("alias")).alias("id"))


@query("SELECT d.doc_id, quality, n_chars > 1000 AS predicted FROM documents d JOIN labels USING (doc_id)")
def j17_label_prediction(t):
    return t("documents").select("doc_id", (F.col("n_chars") > 1000).alias("predicted")).join(t("labels").select("doc_id", "quality"), "doc_id")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000)")
def j19_functional_edge(t):
    s = t("supplier").filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("l_suppkey"))
    return t("lineitem").select("l_partkey", "l_suppkey").join(s, "l_suppkey", "left_semi").select("l_partkey").distinct()


@query("SELECT c_custkey, o_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def j20_items_to_sessions(t):
    o = t("orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
    return li.join(o, "o_orderkey").join(t("customer").select("c_custkey"), "c_custkey").select("c_custkey", "o_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT coalesce(a.p_type, b.p_type) AS rule, CASE WHEN a.w IS NULL THEN 'added' WHEN b.w IS NULL THEN 'removed' WHEN a.w <> b.w THEN 'weight_changed' ELSE 'same' END AS change FROM (SELECT p_type, count(*) AS w FROM part WHERE p_size < 25 GROUP BY 1) a FULL JOIN (SELECT p_type, count(*) AS w FROM part WHERE p_size >= 25 GROUP BY 1) b USING (p_type)""")
def j22_rule_diff(t):
    of = lambda f, n: t("part").filter(f).groupBy(F.col("p_type").alias("rule")).agg(F.count("*").alias(n))
    j = of("p_size < 25", "a").join(of("p_size >= 25", "b"), "rule", "full_outer")
    return j.select("rule", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "weight_changed").otherwise("same").alias("change"))


@query("SELECT event_type, round(avg(coalesce(CASE WHEN json_extract_string(props, '$.k')::INT > 20 THEN json_extract_string(props, '$.k')::DOUBLE / 100 END, value / 100)), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def a2_coalesced_average(t):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return t("events").groupBy("event_type").agg(F.round(F.avg(F.coalesce(F.when(k > 20, k / 100), F.col("value") / 100)), 6).alias("mean"), F.count("*").alias("n"))


@query("SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS any_urgent, bool_and(o_orderstatus = 'F') AS all_finished FROM orders GROUP BY 1")
def a18_any_per_subject(t):
    return t("orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_finished"))


@query("SELECT lang, round(count(*) / (SELECT count(*) FROM documents WHERE lang <> ''), 6) AS share FROM documents WHERE lang <> '' GROUP BY 1")
def a21_category_share(t):
    d = t("documents").filter("lang != ''").groupBy("lang").agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(d.agg(F.sum("n").alias("_all")))).select("lang", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders) >= 1000 AND (SELECT count(*) FROM events) >= 5000 AS ready")
def a27_readiness(t):
    one = t("orders").agg(F.count("*").alias("orders")).crossJoin(t("events").agg(F.count("*").alias("events")))
    return one.withColumn("ready", (F.col("orders") >= 1000) & (F.col("events") >= 5000))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w12_representative(t):
    return ranking.best_per_key(t("orders"), ["o_custkey"], [(F.col("o_orderstatus") == "P").desc(), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, rn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 4")
def t5_nested_top(t):
    top = ranking.best_per_key(t("part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 4, "rn")
    return top.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type", "rn")).alias("place"))


@query("SELECT l_orderkey, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS extra FROM (SELECT l_orderkey, list(DISTINCT l_suppkey % 5) AS a, list(DISTINCT l_partkey % 5) AS b FROM lineitem GROUP BY 1)")
def u2_set_diffs(t):
    s = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 5).alias("a"), F.collect_set(F.col("l_partkey") % 5).alias("b"))
    return s.select("l_orderkey", F.array_sort(F.array_except("a", "b")).alias("missing"), F.array_sort(F.array_except("b", "a")).alias("extra"))


@query("SELECT p_partkey, regexp_replace(regexp_extract(upper(p_name || ' R.S. N° DE-0' || (1000 + p_partkey)), '\\b((?:DE|DN|EE|EN|PN|RD|N)[- ]?[0-9]{4,6})\\b', 1), '-', '') AS code FROM part")
def f17_registry_code(t):
    return t("part").select("p_partkey", X.registry_code(F.concat("p_name", F.lit(" R.S. N° DE-0"), (F.col("p_partkey") + 1000).cast("string"))).alias("code"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part")
def f18_price(t):
    return t("part").select("p_partkey", X.price(F.concat(F.lit("S/ "), F.format_string("%.2f", "p_retailprice"), F.lit(" c/u"))).alias("price"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM part")
def f28_human_label(t):
    return t("part").select("p_partkey", X.human(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS number, coalesce(try_cast(event_type AS DOUBLE), -1) AS parsed FROM events")
def f29_scalar_parse(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("number"), F.coalesce(F.col("event_type").try_cast("double"), F.lit(-1.0)).alias("parsed"))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', ' OR ') WHEN 1 THEN replace(p_name, ' ', ' AND ') WHEN 2 THEN p_name ELSE '' END AS term, CASE p_size % 3 WHEN 0 THEN 'fatigue OR  tiredness' ELSE 'pain' END AS outcome, CASE WHEN p_type = 'PROMO' THEN 'deficiency_low' ELSE 'use' END AS claim FROM part),
q AS (SELECT *, CASE WHEN contains(term, ' AND ') THEN '(' || term || ')' ELSE '(' || array_to_string(list_transform(string_split(term, ' OR '), lambda x: trim(x) || '[ti]'), ' OR ') || ')' END AS a, '(' || array_to_string(list_transform(string_split(outcome, ' OR '), lambda x: trim(x) || '[tiab]'), ' OR ') || ')' AS b FROM p)
SELECT p_partkey, CASE WHEN term <> '' THEN a || ' AND ' || b || CASE WHEN claim = 'deficiency_low' THEN ' AND (supplement*[tiab] OR repletion[tiab] OR treatment[tiab])' ELSE '' END || ' AND humans[mh]' END AS search FROM q""")
def f30_search_expression(t):
    """Searches of parts' names, joined by OR, by AND, or as they are."""
    s, name = F.col("p_size"), F.col("p_name")
    joined = lambda word: F.replace(name, F.lit(" "), F.lit(f" {word} "))
    term = F.when(s % 4 == 0, joined("OR")).when(s % 4 == 1, joined("AND")).when(s % 4 == 2, name).otherwise("")
    query = X.search_query(term, F.when(s % 3 == 0, "fatigue OR  tiredness").otherwise("pain"), F.when(F.col("p_type") == "PROMO", "deficiency_low").otherwise("use"), "humans[mh]", "[ti]")
    return t("part").select("p_partkey", query.alias("search"))


@query("SELECT l_partkey, round((n * m + 20 * 0.7) / (n + 20), 8)::DOUBLE AS smoothed FROM (SELECT l_partkey, count(*) AS n, avg(l_discount * 10) AS m FROM lineitem GROUP BY 1)")
def m2_bayesian_mean(t):
    s = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg(F.col("l_discount") * 10).alias("m"))
    return s.select("l_partkey", F.round(S.bayesian_mean(F.col("n"), F.col("m"), m=20), 8).alias("smoothed"))


@query("SELECT l_orderkey, round(0.45 * avg(l_quantity / 50) + 0.25 * (count(DISTINCT l_returnflag) / 3) + 0.30 * ((count(*) * avg(l_discount * 10) + 5.6) / (count(*) + 8)), 8)::DOUBLE AS score FROM lineitem GROUP BY 1")
def m5_pack_score(t):
    s = t("lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_quantity") / 50).alias("q"), F.size(F.collect_set("l_returnflag")).alias("k"), F.count("*").alias("n"), F.avg(F.col("l_discount") * 10).alias("m"))
    return s.select("l_orderkey", F.round(0.45 * F.col("q") + 0.25 * (F.col("k") / 3) + 0.30 * S.bayesian_mean(F.col("n"), F.col("m")), 8).alias("score"))


@query("SELECT p_partkey, round(((p_size > 5)::INT * 0.18 + (p_retailprice > 1000)::INT * 0.22 + (p_type LIKE 'PROMO%')::INT * 0.14 + 0.12), 4)::DOUBLE AS confidence, CASE WHEN ((p_size > 5)::INT * 0.18 + (p_retailprice > 1000)::INT * 0.22 + (p_type LIKE 'PROMO%')::INT * 0.14 + 0.12) >= 0.5 THEN 'high' ELSE 'low' END AS level FROM part")
def m9_confidence(t):
    c = F.round(F.when(F.col("p_size") > 5, 0.18).otherwise(0.0) + F.when(F.col("p_retailprice") > 1000, 0.22).otherwise(0.0) + F.when(F.col("p_type").startswith("PROMO"), 0.14).otherwise(0.0) + 0.12, 4)
    return t("part").select("p_partkey", c.alias("confidence"), F.when(c >= 0.5, "high").otherwise("low").alias("level"))


@query("SELECT p_partkey, ('0x' || substr(sha256('fixed' || p_partkey::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.05 AS sampled FROM part")
def m20_hash_sample(t):
    return t("part").select("p_partkey", S.hash_sample(F.concat(F.lit("fixed"), F.col("p_partkey").cast("string")), 0.05).alias("sampled"))


@query("SELECT l_orderkey, round(0.7 * (count(DISTINCT l_suppkey) / count(*)) + 0.3 * (count(DISTINCT l_partkey) = count(*))::INT, 6)::DOUBLE AS diversity FROM lineitem GROUP BY 1")
def m26_diversity(t):
    s = t("lineitem").groupBy("l_orderkey").agg(F.size(F.collect_set("l_suppkey")).alias("a"), F.size(F.collect_set("l_partkey")).alias("b"), F.count("*").alias("n"))
    return s.select("l_orderkey", F.round(0.7 * (F.col("a") / F.col("n")) + 0.3 * (F.col("b") == F.col("n")).cast("int"), 6).alias("diversity"))


@query("SELECT o_orderkey, round_even(o_totalprice, 0)::DOUBLE AS half_even, round(o_totalprice, 0) AS half_up FROM orders")
def m31_rounding(t):
    return t("orders").select("o_orderkey", F.bround("o_totalprice", 0).alias("half_even"), F.round("o_totalprice", 0).alias("half_up"))


@query("SELECT c_custkey, least(10, n) AS orders_capped, CASE WHEN n = 0 THEN 0 ELSE 1 END AS implied, round(c_acctbal * 0.008 + CASE WHEN n > 12 THEN 5 ELSE 0 END, 4)::DOUBLE AS estimate, (n < 8)::INT + (c_acctbal < 2000)::INT + (c_nationkey < 6)::INT >= 2 AS deficient FROM (SELECT c.*, coalesce(n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)")
def d8_survey_payload(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = t("customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = (F.col("n") < 8).cast("int") + (F.col("c_acctbal") < 2000).cast("int") + (F.col("c_nationkey") < 6).cast("int")
    return c.select("c_custkey", F.least(F.lit(10), "n").alias("orders_capped"), F.when(F.col("n") == 0, 0).otherwise(1).alias("implied"), F.round(F.col("c_acctbal") * 0.008 + F.when(F.col("n") > 12, 5).otherwise(0), 4).alias("estimate"), (low >= 2).alias("deficient"))


_CONDITIONS = ["enfermedad_renal", "hipertension", "sedantes", "otra", "insomnio", "anticoagulantes"]


@query(f"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS b, list_filter([CASE WHEN c_custkey % 13 = 0 THEN '{_CONDITIONS[0]}' END, CASE WHEN c_custkey % 7 = 0 THEN '{_CONDITIONS[1]}' END, CASE WHEN c_custkey % 11 = 0 THEN '{_CONDITIONS[3]}' END, CASE WHEN c_custkey % 17 = 0 THEN '{_CONDITIONS[1]}' END], lambda x: x IS NOT NULL) AS cond,
  CASE WHEN c_custkey % 5 = 0 THEN ['sin_gluten', 'vegano'] ELSE [] END AS res, CASE WHEN c_custkey % 9 = 0 THEN ['zinc'] ELSE [] END AS sup FROM customer),
s AS (SELECT *, CASE WHEN n % 2 = 0 THEN n * 4 < 18 ELSE n = 3 END AS minor, coalesce(b < -500, false) OR k % 19 = 0 AS sleepless FROM c),
l AS (SELECT *, CASE WHEN minor OR list_contains(cond, 'enfermedad_renal') THEN 2 WHEN len(cond) + len(res) + len(sup) > 0 THEN 1 ELSE 0 END AS lv, CASE WHEN k % 10 = 1 THEN 2 WHEN k % 10 = 2 THEN 1 ELSE 0 END AS lab FROM s)
SELECT k AS c_custkey, ['normal', 'caution', 'medical_review_required'][greatest(lv, lab) + 1] AS safety_level, ['normal', 'caution', 'medical_review_required'][lv + 1] AS survey_level,
  array_to_string(CASE WHEN len(sup) > 0 THEN ['suplementos_actuales'] ELSE [] END || list_filter([CASE WHEN list_contains(cond, 'enfermedad_renal') THEN 'enfermedad_renal' END, CASE WHEN list_contains(cond, 'hipertension') THEN 'hipertension' END, CASE WHEN sleepless THEN 'insomnio' END, CASE WHEN len(res) > 0 THEN 'sin_gluten' END, CASE WHEN minor THEN 'menor_de_edad' END], lambda x: x IS NOT NULL), ' ') AS warnings,
  CASE lv WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS n_actions FROM l""")
def d27_safety_level(t):
    """Customers as profiles: age, conditions, restrictions, supplements, sleep, and a laboratory's level."""
    c, k, n = t("customer"), F.col("c_custkey"), F.col("c_nationkey")
    some = lambda *pairs: F.array_compact(F.array(*[F.when(test, F.lit(v)) for test, v in pairs]))
    own = c.select(
        "c_custkey",
        F.when(n % 2 == 0, n * 4).alias("age_years"),
        F.when(n == 3, "menos_18").alias("edad_rango"),
        some((k % 13 == 0, _CONDITIONS[0]), (k % 7 == 0, _CONDITIONS[1]), (k % 11 == 0, _CONDITIONS[3]), (k % 17 == 0, _CONDITIONS[1])).alias("condiciones_seguridad"),
        some((k % 5 == 0, "sin_gluten"), (k % 5 == 0, "vegano")).alias("restricciones"),
        some((k % 9 == 0, "zinc")).alias("suplementos_actuales"),
        F.when(F.col("c_acctbal") < -500, "mala").alias("sleep_quality"),
        F.when(k % 19 == 0, "3_o_mas").alias("night_wakeups"),
        F.lit(None).cast("string").alias("horas_sueno"),
        F.when(k % 10 == 1, "medical_review_required").when(k % 10 == 2, "caution").alias("lab_level"),
    )
    return safety.profile_safety(own, "c_custkey").select("c_custkey", "safety_level", "survey_level", F.array_join("warnings", " ").alias("warnings"), F.size("actions").alias("n_actions"))


@query("SELECT p_type, count(DISTINCT p_brand) AS n, CASE WHEN count(DISTINCT p_brand) >= 25 THEN 'ready' WHEN count(DISTINCT p_brand) >= 24 THEN 'minimum' WHEN count(DISTINCT p_brand) > 0 THEN 'weak' ELSE 'missing' END AS status FROM part WHERE p_size < 10 GROUP BY 1")
def d35_coverage_status(t):
    n = t("part").filter("p_size < 10").groupBy("p_type").agg(F.countDistinct("p_brand").alias("n"))
    return n.withColumn("status", S.coverage_status(F.col("n"), 25))


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_brand END AS rs, CASE p_size % 3 WHEN 0 THEN 'true_rs_component' WHEN 1 THEN 'no_rs_component' END AS traced, CASE WHEN p_size % 5 = 0 THEN 'Name+brand' ELSE 'rs' END AS basis, CASE WHEN p_size % 2 = 0 THEN 'available' ELSE 'unknown' END AS shelf,
  CASE p_size % 11 WHEN 0 THEN 'manual_rejected' WHEN 1 THEN 'approved_verified' WHEN 2 THEN 'other' END AS manual FROM part),
s AS (SELECT *, CASE WHEN manual IN ('manual_rejected', 'approved_verified') THEN manual WHEN trim(rs) = '' THEN 'candidate_needs_rs' WHEN traced = 'true_rs_component' THEN 'approved_verified' WHEN contains(lower(basis), 'name') THEN 'candidate_name_match' ELSE 'approved_inferred' END AS catalog_status FROM c)
SELECT p_partkey, catalog_status, trim(rs) <> '' AND coalesce(traced = 'true_rs_component', false) AND catalog_status <> 'manual_rejected' AS promotable,
  array_to_string(list_filter([CASE WHEN trim(rs) <> '' THEN 'has_registration' ELSE 'registration_missing' END, CASE WHEN traced = 'true_rs_component' THEN 'component_traced' WHEN traced = 'no_rs_component' THEN 'matched_without_registration' END, CASE WHEN catalog_status = 'candidate_name_match' THEN 'match_needs_explanation' END, CASE WHEN shelf = 'unknown' THEN 'availability_not_ideal' END], lambda x: x IS NOT NULL), ' ') AS notes FROM s""")
def d37_candidate_state(t):
    """Parts as candidates of a catalog."""
    s = F.col("p_size")
    own = t("part").select(
        "p_partkey",
        F.when(s % 4 == 0, " ").otherwise(F.col("p_brand")).alias("registro_sanitario"),
        F.when(s % 3 == 0, "true_rs_component").when(s % 3 == 1, "no_rs_component").alias("component_traceable"),
        F.when(s % 5 == 0, "Name+brand").otherwise("rs").alias("match_basis"),
        F.when(s % 2 == 0, "available").otherwise("unknown").alias("availability"),
        F.when(s % 11 == 0, "manual_rejected").when(s % 11 == 1, "approved_verified").when(s % 11 == 2, "other").alias("manual_status"),
    )
    return catalog.candidate_states(own).select("p_partkey", "catalog_status", "promotable", F.array_join("notes", " ").alias("notes"))


@query("""WITH r AS (SELECT p_partkey, p_name AS name, p_brand AS rs, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 2) WHEN p_size % 3 = 1 THEN p_name ELSE 'other thing' END AS reg, CASE WHEN p_type = 'PROMO' THEN 'promo' END AS category FROM part),
n AS (SELECT rs, count(DISTINCT lower(name)) AS n, arg_min(reg, p_partkey) AS first FROM r GROUP BY 1), m AS (SELECT * FROM n WHERE n > 40 AND len(list_distinct(string_split(first, ' '))) < 2)
SELECT p_partkey, CASE WHEN category IS NOT NULL THEN 'category:' || category WHEN m.n IS NOT NULL THEN 'fan_out:' || rs || ':' || first || ':' || m.n WHEN NOT list_has_any(string_split(name, ' '), string_split(reg, ' ')) THEN 'name:' || reg END AS reason FROM r LEFT JOIN m USING (rs)""")
def d39_cleaning_class(t):
    """Parts as products: the brand stands for the registration, a part of the name for the registered one."""
    s, name = F.col("p_size"), F.col("p_name")
    registered = F.when(s % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).when(s % 3 == 1, name).otherwise("other thing")
    rows = t("part").select("p_partkey", "p_name", "p_brand", registered.alias("registered"), "p_type")
    return catalog.cleaning_reasons(rows, "p_brand", "p_name", "registered", F.when(F.col("p_type") == "PROMO", "promo"), "p_partkey", 40).select("p_partkey", "reason")


TARGETS = [("anemia", "a", ["low", "critical_low"]), ("anemia", "b", ["low", "critical_low"]), ("thyroid", "c", ["low", "critical_low", "high", "critical_high"]), ("glucose", "d", ["high", "critical_high"])]


@query("""WITH i AS (SELECT l_orderkey, ['a', 'b', 'c', 'd', 'e'][l_suppkey % 5 + 1] AS code, CASE WHEN l_quantity < 5 THEN 'critical_low' WHEN l_quantity < 15 THEN 'low' WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 38 THEN '' ELSE 'normal' END AS status, [l_linenumber, l_partkey, l_suppkey, l_quantity::INT] AS at_ FROM lineitem),
s AS (SELECT l_orderkey, code, coalesce(arg_min(status, at_) FILTER (WHERE status IN ('low', 'critical_low', 'high')), arg_min(status, at_)) AS status FROM i WHERE status <> '' GROUP BY 1, 2),
g(condition, code, low, high) AS (VALUES ('anemia', 'a', true, false), ('anemia', 'b', true, false), ('thyroid', 'c', true, true), ('glucose', 'd', false, true)),
y AS (SELECT l_orderkey, condition, bool_or((low AND status IN ('low', 'critical_low')) OR (high AND status = 'high')) AS truth FROM s JOIN g USING (code) GROUP BY 1, 2),
p AS (SELECT o_orderkey AS l_orderkey, 'system' AS predictor, CASE WHEN o_orderpriority = '1-URGENT' THEN 'anemia' WHEN o_orderpriority = '2-HIGH' THEN 'thyroid' ELSE 'glucose' END AS condition FROM orders UNION ALL SELECT o_orderkey, 'rules', 'anemia' FROM orders WHERE o_totalprice < 150000),
b AS (SELECT y.condition, q.predictor, truth, p.condition IS NOT NULL AS said FROM y CROSS JOIN (VALUES ('system'), ('rules')) q(predictor) LEFT JOIN p ON p.l_orderkey = y.l_orderkey AND p.predictor = q.predictor AND p.condition = y.condition),
n AS (SELECT condition, predictor, count(*) FILTER (WHERE said AND truth) AS tp, count(*) FILTER (WHERE said AND NOT truth) AS fp, count(*) FILTER (WHERE NOT said AND truth) AS fn, count(*) FILTER (WHERE NOT said AND NOT truth) AS tn FROM b GROUP BY 1, 2)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall, tp + fp >= 10 AND tp + fn >= 10 AS enough FROM n""")
def d43_paired_truth(t):
    """Orders as people: their lines are biomarkers, their priority and price two predictors."""
    q, li, o = F.col("l_quantity"), t("lineitem"), t("orders")
    status = F.when(q < 5, "critical_low").when(q < 15, "low").when(q > 40, "high").when(q > 38, "").otherwise("normal")
    items = li.select("l_orderkey", F.get(F.array(*map(F.lit, "abcde")), (F.col("l_suppkey") % 5).cast("int")).alias("code"), status.alias("status"), "l_linenumber", "l_partkey", "l_suppkey", q.cast("int").alias("q"))
    found = evaluation.statuses(items, "l_orderkey", "code", "status", ["l_linenumber", "l_partkey", "l_suppkey", "q"])
    truth = evaluation.lab_truth(found, "l_orderkey", "code", li.sparkSession.createDataFrame(TARGETS, "condition string, code string, directions array<string>"))
    p = F.col("o_orderpriority")
    said = o.select(F.col("o_orderkey").alias("l_orderkey"), F.lit("system").alias("predictor"), F.when(p == "1-URGENT", "anemia").when(p == "2-HIGH", "thyroid").otherwise("glucose").alias("condition"))
    rules = o.filter("o_totalprice < 150000").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("rules").alias("predictor"), F.lit("anemia").alias("condition"))
    return evaluation.paired(truth, said.unionByName(rules), "l_orderkey")


@query("SELECT a, i AS part, round(avg(x), 6) AS mean FROM (SELECT e.a, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM (SELECT DISTINCT l_partkey % 100 AS a, 100 + l_suppkey % 100 AS b FROM lineitem WHERE l_quantity > 45) e JOIN embeddings ON vec_id = e.b) GROUP BY 1, 2")
def l5_neighbour_means(t):
    e = t("lineitem").filter("l_quantity > 45").select((F.col("l_partkey") % 100).alias("a"), (100 + F.col("l_suppkey") % 100).alias("b")).distinct()
    got = graph.neighbour_means(t("embeddings").select(F.col("vec_id").alias("a"), "embedding"), e, "a", "embedding")
    return got.filter("a < 100 AND neighbours IS NOT NULL").select("a", F.posexplode("neighbours").alias("part", "mean")).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderkey, year(o_orderdate) <= 1999 AS train FROM orders WHERE year(o_orderdate) <> 2000")
def l8_temporal_split(t):
    from siftspark.operators.models import split_by_period

    a, b = split_by_period(t("orders").withColumn("y", F.year("o_orderdate")), "y", [1995, 1996, 1997, 1998, 1999], [2001])
    return a.select("o_orderkey", F.lit(True).alias("train")).unionByName(b.select("o_orderkey", F.lit(False).alias("train")))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def e9_latest_vote(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN props END AS props, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value END AS value FROM events")
def e7_retention(t):
    from siftspark.streaming.jobs import purged

    return purged(t("events"), "ts", F.lit("2024-01-15").cast("timestamp_ntz"), ["props", "value"]).select("event_id", "props", "value")


@query("""SELECT o_orderkey, '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS before FROM orders WHERE o_orderstatus = 'P'""")
def g3_audit_rows(t):
    return t("orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("before"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS c_name, c_acctbal >= 0 AS consent FROM customer")
def g4_consent(t):
    ok = F.col("c_acctbal") >= 0
    return t("customer").select("c_custkey", F.when(ok, F.col("c_name")).alias("c_name"), ok.alias("consent"))


@query()
def l5_link_scores(t):
    """Scores of held-out pairs of parts that share an order, by a model of few epochs; a fitted model isn't SQL."""
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    pairs = li.alias("x").join(li.alias("y"), (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("y.l_linenumber") == F.col("x.l_linenumber") + 1))
    edges = linkmodel.split_edges(linkmodel.simple_edges(pairs.select(F.col("x.l_partkey").alias("a"), F.col("y.l_partkey").alias("b"))))
    nodes = t("part").select(F.col("p_partkey").alias("node"))
    examples = linkmodel.examples_of(edges, linkmodel.hashed_features(nodes, 8), 8, fan=5).persist(StorageLevel.DISK_ONLY)
    model = linkmodel.train_links(examples, 8, hidden=8, out=8, epochs=3)
    return linkmodel.scored_links(examples.filter("split = 'test'"), model)
