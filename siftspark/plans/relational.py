"""Queries over orders, parts, customers and suppliers: projections, joins, aggregates, windows, sets, catalog upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.functions import scores as S
from siftspark.functions import text as X
from siftspark.operators import catalog, ranking, survey
from siftspark.plans.core import ORACLES, query


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_size BETWEEN 5 AND 40")
def p2_status_filter(t):
    return t("part").filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & F.col("p_size").between(5, 40)).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_partkey % 100 + 1 FROM part)")
def p3_tuple_in(t):
    keys = t("part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100 + 1).alias("l_suppkey"))
    return t("lineitem").select("l_partkey", "l_suppkey").distinct().join(keys, ["l_partkey", "l_suppkey"], "left_semi")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' AND p_name NOT ILIKE '%blue%'")
def p4_ilike(t):
    return t("part").filter(F.col("p_name").ilike("%RED%") & ~F.col("p_name").ilike("%blue%")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def p5_in_subquery(t):
    return t("customer").select("c_custkey", "c_name").join(t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, concat_ws(';', CASE WHEN l_quantity > 45 THEN 'bulk' END,
  CASE WHEN l_discount >= 0.09 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS reject_reason
  FROM lineitem WHERE l_quantity > 45 OR l_discount >= 0.09 OR l_returnflag = 'R'""")
def p8_reject_reasons(t):
    why = catalog.reasons(bulk=F.col("l_quantity") > 45, discount=F.col("l_discount") >= 0.09, returned=F.col("l_returnflag") == "R")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", why.alias("reject_reason")).filter("reject_reason != ''")


@query("""WITH rule(seg, lo, hi) AS (VALUES ('BUILDING', 0.0, 5000.0), ('MACHINERY', -1000.0, 2000.0), ('AUTOMOBILE', 1000.0, 9999.0))
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer JOIN rule ON c_mktsegment = seg AND c_acctbal >= lo AND c_acctbal < hi""")
def p9_population_mask(t):
    c = t("customer")
    rule = c.sparkSession.createDataFrame([("BUILDING", 0.0, 5000.0), ("MACHINERY", -1000.0, 2000.0), ("AUTOMOBILE", 1000.0, 9999.0)], "seg string, lo double, hi double")
    return c.join(F.broadcast(rule), (F.col("c_mktsegment") == F.col("seg")) & (F.col("c_acctbal") >= F.col("lo")) & (F.col("c_acctbal") < F.col("hi"))).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("""WITH g(a, b, flag, label) AS (VALUES (0, 10, 'any', 'small'), (11, 30, 'any', 'medium'), (20, 50, 'PROMO', 'promo_large'))
SELECT p_partkey, label FROM part JOIN g ON p_size BETWEEN a AND b AND (flag = 'any' OR starts_with(p_type, flag))""")
def p10_life_stage(t):
    p = t("part")
    g = p.sparkSession.createDataFrame([(0, 10, "any", "small"), (11, 30, "any", "medium"), (20, 50, "PROMO", "promo_large")], "a int, b int, flag string, label string")
    fits = F.col("p_size").between(F.col("a"), F.col("b")) & ((F.col("flag") == "any") | F.col("p_type").startswith(F.col("flag")))
    return p.join(F.broadcast(g), fits).select("p_partkey", "label")


@query("""SELECT o_orderkey, o_totalprice > 50000 AND o_orderstatus <> 'F' AS eligible, CASE WHEN o_orderstatus = 'F' THEN 'finished'
  WHEN o_totalprice <= 50000 THEN 'small' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'regular' END AS reason FROM orders""")
def p14_decision_cascade(t):
    s = F.col("o_orderstatus") == "F"
    small = F.col("o_totalprice") <= 50000
    why = F.when(s, "finished").when(small, "small").when(F.col("o_orderpriority").like("1%"), "urgent").otherwise("regular")
    return t("orders").select("o_orderkey", (~small & ~s).alias("eligible"), why.alias("reason"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\b(red|rose)\\b') THEN 'warm' WHEN regexp_matches(p_name, '\\b(blue|navy)\\b') THEN 'cold'
  WHEN regexp_matches(p_type, 'PROMO|ECONOMY') THEN 'cheap' END AS class FROM part""")
def p15_ordered_regex_classes(t):
    c = F.coalesce(F.when(F.col("p_name").rlike(r"\b(red|rose)\b"), "warm"), F.when(F.col("p_name").rlike(r"\b(blue|navy)\b"), "cold"), F.when(F.col("p_type").rlike("PROMO|ECONOMY"), "cheap"))
    return t("part").select("p_partkey", c.alias("class"))


@query("""SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'segment' END,
  CASE WHEN c_nationkey > 20 AND c_acctbal > 9000 THEN 'nation_balance' END], lambda x: x IS NOT NULL)::VARCHAR[] AS errors FROM customer""")
def p17_validation_errors(t):
    e = F.array_compact(
        F.array(
            F.when(F.col("c_acctbal") < 0, "negative"),
            F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), "segment"),
            F.when((F.col("c_nationkey") > 20) & (F.col("c_acctbal") > 9000), "nation_balance"),
        )
    )
    return t("customer").select("c_custkey", e.alias("errors"))


@query("""SELECT c_custkey, CASE WHEN a < 18 THEN 'menos_18' WHEN a <= 30 THEN '18_30' WHEN a <= 50 THEN '31_50' ELSE 'mas_50' END AS age, CASE WHEN w IS NULL THEN NULL WHEN w < 50 THEN 'menos_50' WHEN w <= 65 THEN '50_65' WHEN w <= 80 THEN '66_80' ELSE 'mas_80' END AS weight,
  CASE WHEN s > 24 THEN NULL WHEN s < 5 THEN 'menos_5h' WHEN s < 7 THEN '5_7h' WHEN s < 9 THEN '7_9h' ELSE 'mas_9h' END AS sleep, CASE WHEN sun IS NULL THEN NULL WHEN sun < 15 THEN 'menos_15min' WHEN sun < 30 THEN '15_30min' WHEN sun <= 60 THEN '30_60min' ELSE 'mas_1h' END AS sun,
  CASE WHEN v IN (7, 9) OR m IN (7, 9) OR (v = 1 AND d = 77) THEN NULL ELSE ['casi_nunca', '1_2_semana', '1_2_semana', '3_4_semana', '3_4_semana', 'diario', 'diario', 'diario'][least(7, greatest(CASE WHEN v = 1 THEN d ELSE 0 END, CASE WHEN m = 1 THEN 3 ELSE 0 END))::INT + 1] END AS exercise
FROM (SELECT c_custkey, c_nationkey * 4 AS a, CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS w, c_custkey % 30 AS s, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN c_nationkey * 5 ELSE (5 * (c_custkey % 90) + 2 * c_nationkey * 5) / 7 END AS sun,
  [1, 2, 1, 7, 1][c_custkey % 5 + 1] AS v, [1, 2, 9][c_custkey % 3 + 1] AS m, [0, 1, 3, 5, 77, 9][c_custkey % 6 + 1] AS d FROM customer)""")
def p19_bins(t):
    """Customers' numbers as the bins of a survey."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    of = lambda values, by: F.get(F.array(*map(F.lit, values)), (k % by).cast("int"))
    work, free = F.when(k % 7 > 1, k % 90), F.when(k % 7 > 0, n * 5)
    days = survey.exercise_days(of([1, 2, 1, 7, 1], 5), of([0, 1, 3, 5, 77, 9], 6), of([1, 2, 9], 3), F.lit(3))
    bins = {"age": survey.bin_of(n * 4, survey.AGE), "weight": survey.bin_of(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100), survey.WEIGHT), "sleep": survey.sleep_bin(k % 30), "sun": survey.sun_bin(work, free), "exercise": survey.bin_of(days, survey.EXERCISE)}
    return t("customer").select("c_custkey", *[c.alias(name) for name, c in bins.items()])


@query("""WITH u(unit, factor) AS (VALUES ('kg', 1.0::DOUBLE), ('g', 0.001::DOUBLE), ('lb', 0.45359237::DOUBLE), ('oz', 0.0283495231::DOUBLE), ('st', 6.35029318::DOUBLE)),
n(name, unit) AS (VALUES ('KG', 'kg'), ('g.', 'g'), ('Libras', 'lb'), ('oz', 'oz'), ('stone', 'st'), ('ounces', 'oz'), ('?', NULL))
SELECT p_partkey, round(p_size * factor, 4) AS kg FROM (SELECT *, ['KG', 'g.', 'Libras', 'oz', 'stone', 'ounces', '?'][(p_partkey % 7 + 1)::INT] AS name FROM part) LEFT JOIN n USING (name) LEFT JOIN u USING (unit)""")
def p20_unit_conversion(t):
    """Sizes in units of weight by their names; null for a unit that there isn't."""
    unit = F.get(F.array(*map(F.lit, ("KG", "g.", "Libras", "oz", "stone", "ounces", "?"))), (F.col("p_partkey") % 7).cast("int"))
    return t("part").select("p_partkey", survey.weight_in_kg(F.col("p_size"), unit).alias("kg"))


@query("""SELECT p_partkey, n_name, s_name, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey WHERE p_brand = 'Brand#12' GROUP BY ALL""")
def j1_star_join(t):
    return (
        t("lineitem").select("l_partkey", "l_suppkey").join(t("part").filter("p_brand = 'Brand#12'").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("p_partkey", "n_name", "s_name").agg(F.count("*").alias("lines"))
    )


@query("""WITH reg AS (SELECT * FROM part WHERE p_size > 10) SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate,
  CASE WHEN l_partkey % 7 = 0 THEN 'no_key' WHEN p_partkey IS NULL THEN 'not_in_registry' WHEN p_type LIKE 'ECONOMY%' THEN 'no_components' END AS miss
  FROM lineitem LEFT JOIN reg ON p_partkey = l_partkey AND l_partkey % 7 <> 0""")
def j4_key_misses(t):
    reg = t("part").filter("p_size > 10").select(F.col("p_partkey").alias("_k"), "p_type")
    li = t("lineitem").withColumn("_k", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")))
    miss = F.when(F.col("_k").isNull(), "no_key").when(F.col("p_type").isNull(), "not_in_registry").when(F.col("p_type").startswith("ECONOMY"), "no_components")
    return li.join(reg, "_k", "left").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate", miss.alias("miss"))


_SNAP = "(SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS price FROM orders WHERE year(o_orderdate) = {} GROUP BY 1)"


def _snapshot(t, year):
    return t("orders").filter(F.year("o_orderdate") == year).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))


@query(f"""SELECT k, CASE WHEN o.price IS NULL THEN 'new' WHEN n.price IS NULL THEN 'removed' WHEN abs((n.price - o.price) / o.price) >= 0.01 THEN 'changed' ELSE 'same' END AS change,
  o.price AS old_value, n.price AS new_value, round((n.price - o.price) / o.price, 4) AS pct FROM {_SNAP.format(1996)} o FULL JOIN {_SNAP.format(1997)} n USING (k)""")
def j5_snapshot_diff(t):
    return catalog.snapshot_diff(_snapshot(t, 1996), _snapshot(t, 1997), "k", "price")


@query(f"SELECT k, coalesce(n.price, o.price) AS price, CASE WHEN o.price IS NULL THEN 'added' WHEN n.price IS NOT NULL AND n.price <> o.price THEN 'updated' ELSE 'unchanged' END AS status FROM {_SNAP.format(1996)} o FULL JOIN {_SNAP.format(1997)} n USING (k)")
def u5_filled_merge(t):
    return catalog.filled_merge(_snapshot(t, 1996), _snapshot(t, 1997), "k", ["price"])


@query(f"""SELECT k, CASE WHEN s IS NULL OR (s = 'pending' AND n.price IS NOT NULL) THEN n.price ELSE o.price END AS price, coalesce(s, 'pending') AS state,
  CASE WHEN s IS NULL THEN 'insert' WHEN n.price IS NULL THEN 'keep' WHEN s = 'pending' THEN 'refresh' ELSE 'skip' END AS action
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'pending' ELSE 'approved' END AS s FROM {_SNAP.format(1996)}) o FULL JOIN {_SNAP.format(1997)} n USING (k)""")
def u8_upsert(t):
    old = _snapshot(t, 1996).withColumn("state", F.when(F.col("k") % 2 == 0, "pending").otherwise("approved"))
    return catalog.upsert(old, _snapshot(t, 1997), "k", "price", "state")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size > 5 AND p_brand IN (SELECT p_brand FROM part WHERE p_size <= 25)
  AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def u9_deactivate_missing(t):
    known = t("part").withColumn("state", F.when(F.col("p_size") > 5, "active").otherwise("off"))
    return catalog.deactivate_missing(known, t("part").filter("p_size <= 25").select("p_partkey", "p_brand"), "p_partkey", "p_brand", "state").select("p_partkey", "p_brand")


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
UNION ALL SELECT 'removed', count(*) FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)""")
def u1_set_parts(t):
    of = lambda y: t("orders").filter(F.year("o_orderdate") == y).select("o_custkey")
    both, gone = of(1996).intersect(of(1997)), of(1996).subtract(of(1997))
    return both.agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n").unionByName(gone.agg(F.count("*").alias("n")).select(F.lit("removed").alias("part"), "n"))


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_extendedprice, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def u3_first_rows(t):
    return catalog.first_rows(t("lineitem"), ["l_partkey"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_extendedprice", "l_suppkey")]).select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates, count(*) AS n FROM lineitem")
def u4_duplicate_count(t):
    by = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"))
    return by.agg((F.sum("c") - F.count("*")).alias("duplicates"), F.sum("c").alias("n"))


@query("""WITH x AS (SELECT l_orderkey, l_suppkey, l_shipdate, l_linenumber, l_extendedprice / l_quantity AS price, l_partkey FROM lineitem),
p AS (SELECT *, lag(price) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, price) AS previous FROM x)
SELECT l_partkey, l_orderkey, l_linenumber, round(price, 8) AS price, round((price - previous) / previous, 8) AS pct FROM p WHERE previous <> 0 AND abs((price - previous) / previous) >= 0.5""")
def w10_price_changes(t):
    x = t("lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    out = catalog.price_changes(x, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "price"], "price", 0.5)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", F.round("price", 8).alias("price"), F.round("pct", 8).alias("pct"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def w1_latest_per_key(t):
    return ranking.best_per_key(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w2_rank_by_score(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
s AS (SELECT o_custkey, o_orderpriority, position AS new_position, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY position) AS slot FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, position) AS slot FROM b)
SELECT o_custkey, o_orderkey, o_orderpriority, position, new_position FROM r JOIN s USING (o_custkey, o_orderpriority, slot)""")
def w5_rerank_in_tiers(t):
    b = t("orders").withColumn("position", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return ranking.rerank_in_tiers(b, ["o_custkey"], "o_orderpriority", "position", F.col("o_totalprice")).select("o_custkey", "o_orderkey", "o_orderpriority", "position", "new_position")


@query("""SELECT o_custkey, o_orderkey, min(position) OVER (PARTITION BY o_custkey, o_orderpriority) AS group_order, position FROM
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders)""")
def w6_group_order(t):
    b = t("orders").withColumn("position", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return b.select("o_custkey", "o_orderkey", F.min("position").over(Window.partitionBy("o_custkey", "o_orderpriority")).alias("group_order"), "position")


@query("""SELECT l_partkey, arg_max(l_orderkey, (l_returnflag <> 'R', l_extendedprice, -l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1""")
def w7_argmax_preference(t):
    best = F.max(F.struct((F.col("l_returnflag") != "R").alias("a"), F.col("l_extendedprice").alias("b"), (-F.col("l_orderkey")).alias("c")))
    return t("lineitem").groupBy("l_partkey").agg(best.alias("m")).select("l_partkey", (-F.col("m.c")).alias("l_orderkey"))


@query("""WITH x AS (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), y AS (SELECT x.*, s_nationkey, row_number() OVER (PARTITION BY l_orderkey, s_nationkey ORDER BY score DESC, l_suppkey) AS rn FROM x JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn > 1, score DESC, l_suppkey) AS place FROM y""")
def w9_diverse_first(t):
    x = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score")).join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return ranking.diverse_first(x, ["l_orderkey"], "s_nationkey", [F.desc("score"), F.col("l_suppkey")]).select("l_orderkey", "l_suppkey", "place")


@query("""SELECT o_orderkey, round(greatest(0.45, 0.82 - 0.12 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)), 4)::DOUBLE AS probability FROM orders""")
def w14_decay(t):
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return t("orders").select("o_orderkey", F.round(F.greatest(F.lit(0.45), 0.82 - 0.12 * i), 4).alias("probability"))


@query("SELECT p_partkey, p_retailprice, nullif(p_size, 1) AS size FROM part ORDER BY p_retailprice ASC, nullif(p_size, 1) DESC NULLS LAST, p_partkey LIMIT 50")
def t1_cheapest(t):
    size = F.when(F.col("p_size") != 1, F.col("p_size"))
    return t("part").select("p_partkey", "p_retailprice", size.alias("size")).orderBy("p_retailprice", F.desc_nulls_last("size"), "p_partkey").limit(50)


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def t4_page(t):
    c = t("customer").filter("c_acctbal > 0")
    page = c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")
    return page.crossJoin(F.broadcast(c.agg(F.count("*").alias("total"))))


@query("SELECT o_custkey, o_orderpriority, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_custkey, o_orderpriority), (o_custkey))")
def a1_rollup(t):
    return t("orders").groupingSets([[F.col("o_custkey"), F.col("o_orderpriority")], [F.col("o_custkey")]], F.col("o_custkey"), F.col("o_orderpriority")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


_VOTES = """(SELECT l_partkey AS item, l_returnflag AS context, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS rating, CASE WHEN l_quantity > 30 THEN l_linestatus = 'O' END AS purchased,
  CASE WHEN l_quantity > 40 THEN l_discount > 0.05 END AS still, CASE WHEN l_tax > 0.07 THEN ' CLARO' WHEN l_tax > 0.06 THEN 'leve' WHEN l_tax > 0.05 THEN 'ninguno' END AS benefit FROM lineitem)"""
_RATED = "coalesce((least(5, greatest(1, rating)) - 1) / 4.0::DOUBLE, 0)"
_REWARD = f"""least(greatest(CASE WHEN purchased IS NULL AND still IS NULL AND benefit IS NULL THEN {_RATED} ELSE 0.40::DOUBLE * {_RATED} + CASE WHEN purchased THEN 0.20 ELSE 0.0 END::DOUBLE + CASE WHEN still THEN 0.30 ELSE 0.0 END::DOUBLE
  + CASE lower(trim(benefit)) WHEN 'claro' THEN 0.10 WHEN 'leve' THEN 0.05 ELSE 0.0 END::DOUBLE END, 0), 1)"""


def _votes(t):
    q, x = F.col("l_quantity"), F.col("l_tax")
    benefit = F.when(x > 0.07, " CLARO").when(x > 0.06, "leve").when(x > 0.05, "ninguno")
    rating = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber"))
    return t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("context"), rating.alias("rating"), F.when(q > 30, F.col("l_linestatus") == "O").alias("purchased"), F.when(q > 40, F.col("l_discount") > 0.05).alias("still"), benefit.alias("benefit"))


def _rewards(t):
    return _votes(t).withColumn("r", S.reward(F.col("rating"), F.col("purchased"), F.col("still"), F.col("benefit")))


@query(f"SELECT item, context, round(sum({_REWARD}), 4) AS reward, sum(rating)::BIGINT AS rating, count(*) AS n FROM {_VOTES} GROUP BY 1, 2")
def m1_reward_by_context(t):
    return _rewards(t).groupBy("item", "context").agg(F.round(F.sum("r"), 4).alias("reward"), F.sum("rating").alias("rating"), F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT item, context, avg({_REWARD}) AS m, count(*) AS n FROM {_VOTES} GROUP BY 1, 2), g AS (SELECT item, avg({_REWARD}) AS m, count(*) AS n FROM {_VOTES} GROUP BY 1)
SELECT item, context, CASE WHEN c.n >= 5 THEN 'context' WHEN g.n >= 10 THEN 'global' WHEN g.n > 0 OR c.n > 0 THEN 'insufficient' ELSE 'none' END AS level, (CASE WHEN c.n >= 5 THEN c.n WHEN g.n >= 10 THEN g.n ELSE 0 END)::BIGINT AS used,
  round(CASE WHEN c.n >= 5 THEN (c.n * c.m + 8 * 0.7::DOUBLE) / (c.n + 8) WHEN g.n >= 10 THEN (g.n * g.m + 8 * 0.7::DOUBLE) / (g.n + 8) ELSE 0.7 END, 9)::DOUBLE AS value FROM c JOIN g USING (item)""")
def m3_signal_choice(t):
    sums = _rewards(t).groupBy("item", "context").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    glob = sums.groupBy("item").agg(F.sum("s").alias("gs"), F.sum("n").alias("gn"))
    pick = S.chosen_signal(F.col("n"), F.col("s") / F.col("n"), F.col("gn"), F.col("gs") / F.col("gn"))
    return sums.join(glob, "item").withColumn("p", pick).select("item", "context", F.col("p.level").alias("level"), F.col("p.used").alias("used"), F.round("p.value", 9).alias("value"))


@query(f"""WITH s AS (SELECT item, count(*) AS n, avg({_REWARD}) AS m FROM {_VOTES} GROUP BY 1), a AS (SELECT sum(n) AS total FROM s)
SELECT item, round((n * m + 5.6::DOUBLE) / (n + 8) + 0.01::DOUBLE * sqrt(ln(total + 1) / (n + 1)), 5) AS score FROM s, a""")
def m4_exploration(t):
    s = _rewards(t).groupBy("item").agg(F.count("*").alias("n"), F.avg("r").alias("m"))
    return s.crossJoin(F.broadcast(s.agg(F.sum("n").alias("total")))).select("item", F.round(S.bayesian_mean(F.col("n"), F.col("m")) + S.exploration(F.col("n"), F.col("total")), 5).alias("score"))


@query("""WITH g AS (SELECT avg(l_quantity / 10) AS prior FROM lineitem), s AS (SELECT l_partkey, count(*) AS n, avg(l_quantity / 10) AS r, avg(l_discount * 10) AS e, avg(1 - l_tax) AS v, count_if(l_returnflag = 'A') AS verified FROM lineitem GROUP BY 1)
SELECT l_partkey, n, verified::BIGINT AS verified, round(0.55::DOUBLE * ((n * r + 10 * prior) / (n + 10)) / 5 + 0.20::DOUBLE * e + 0.15::DOUBLE * v + 0.10::DOUBLE * least(r / 5, 1), 4) AS review_score FROM s, g""")
def m10_review_score(t):
    li = t("lineitem")
    r = F.col("l_quantity") / 10
    s = li.groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg(r).alias("r"), F.avg(F.col("l_discount") * 10).alias("e"), F.avg(1 - F.col("l_tax")).alias("v"), F.count_if(F.col("l_returnflag") == "A").alias("verified"))
    s = s.crossJoin(F.broadcast(li.agg(F.avg(r).alias("prior"))))
    score = 0.55 * ((F.col("n") * F.col("r") + 10 * F.col("prior")) / (F.col("n") + 10)) / 5 + 0.20 * F.col("e") + 0.15 * F.col("v") + 0.10 * F.least(F.col("r") / 5, F.lit(1.0))
    return s.select("l_partkey", "n", "verified", F.round(score, 4).alias("review_score"))


@query("""SELECT l_suppkey, count(*) AS shown, round(greatest(0.25, 1 - least(0.75, 3 * (count(*) / (SELECT count(*) FROM lineitem)))), 6)::DOUBLE AS exposure FROM lineitem GROUP BY 1""")
def m11_exposure(t):
    n = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("shown"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("shown").alias("_all")))).select("l_suppkey", "shown", F.round(S.exposure(F.col("shown") / F.col("_all")), 6).alias("exposure"))


@query("SELECT o_custkey, round(avg(o_totalprice), 2) AS mean, count(*) AS n, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order FROM orders GROUP BY 1 ORDER BY mean DESC, n DESC, o_custkey LIMIT 25")
def a4_top_rated(t):
    by = t("orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.count("*").alias("n"), F.max("o_orderdate").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"))
    return by.orderBy(F.desc("mean"), F.desc("n"), "o_custkey").limit(25)


@query("""SELECT p_type, count(DISTINCT p_partkey) AS products, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN p_partkey END) AS safe, count(DISTINCT l_suppkey) AS suppliers,
  CASE WHEN count(DISTINCT l_suppkey) >= 100 THEN 'ready' WHEN count(DISTINCT l_suppkey) >= 99 THEN 'minimum' WHEN count(DISTINCT l_suppkey) > 0 THEN 'weak' ELSE 'missing' END AS status FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def a8_coverage(t):
    j = t("part").select("p_partkey", "p_type").join(t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), F.col("l_partkey") == F.col("p_partkey"), "left")
    # each count apart, on rows that are distinct already
    pairs = j.groupBy("p_type", "p_partkey").agg(F.bool_or(F.col("l_returnflag") != "R").alias("safe"))
    parts = pairs.groupBy("p_type").agg(F.count("*").alias("products"), F.count_if("safe").alias("safe"))
    sup = j.groupBy("p_type", "l_suppkey").agg(F.count("*")).groupBy("p_type").agg(F.count("l_suppkey").alias("suppliers"))
    return parts.join(sup, "p_type").withColumn("status", S.coverage_status(F.col("suppliers"), 100))


@query("SELECT p_name, count(DISTINCT p_brand) AS n_names FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 20")
def a9_fan_out(t):
    return catalog.fan_out(t("part"), "p_name", "p_brand", 20)


@query("SELECT DISTINCT p_name, p_brand FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 20)")
def d31_rejected_fan_out(t):
    return catalog.split_by_fan_out(t("part").select("p_name", "p_brand"), "p_name", "p_brand", 20)[1]


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def a10_pivot_rollup(t):
    is_ = lambda p: F.count_if(F.col("o_orderpriority") == p)
    return t("orders").rollup("o_orderstatus").agg(is_("1-URGENT").alias("urgent"), is_("5-LOW").alias("low"), F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def a11_most_common(t):
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("""SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg((o_orderpriority = '5-LOW')::INT), 4) AS low_share FROM orders GROUP BY 1""")
def a19_summary(t):
    c = F.col("o_totalprice")
    return t("orders").groupBy("o_orderstatus").agg(F.round(F.avg(c), 2).alias("mean"), F.round(F.stddev_samp(c), 2).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg((F.col("o_orderpriority") == "5-LOW").cast("int")), 4).alias("low_share"))


@query("SELECT round(avg((nullif(p_size, 1) IS NULL)::INT), 6) AS size_missing, round(avg((nullif(p_brand, 'Brand#11') IS NULL)::INT), 6) AS brand_missing FROM part")
def a20_missing_share(t):
    return t("part").agg(F.round(F.avg((F.col("p_size") == 1).cast("int")), 6).alias("size_missing"), F.round(F.avg((F.col("p_brand") == "Brand#11").cast("int")), 6).alias("brand_missing"))


@query("SELECT w AS word, count(*) AS n, round(avg((p_size > 25)::INT), 4) AS warned FROM (SELECT unnest(string_split(p_name, ' ')) AS w, p_size FROM part) GROUP BY 1")
def a23_exploded_counts(t):
    return t("part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_size").groupBy("word").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p_size") > 25).cast("int")), 4).alias("warned"))


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'bulk' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.06 THEN 'tax' END], lambda x: x IS NOT NULL)) AS rule, l_returnflag = 'R' AS y FROM lineitem),
p AS (SELECT avg((l_returnflag = 'R')::INT) AS prevalence FROM lineitem) SELECT rule, count(*) AS n, round(avg(y::INT), 4) AS precision, round(avg(y::INT) / any_value(prevalence), 4) AS lift FROM r, p GROUP BY 1""")
def a24_rule_lift(t):
    from siftspark.operators.evaluation import rule_lift

    li = t("lineitem").withColumn("y", F.col("l_returnflag") == "R")
    rules = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "bulk"), F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_tax") > 0.06, "tax")))
    return rule_lift(li.select(F.explode(rules).alias("rule"), "y"), "rule", F.col("y"), li.agg(F.avg(F.col("y").cast("double")).alias("prevalence")))


@query("SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def a25_stable_in_all(t):
    from siftspark.operators.evaluation import stable_in_all

    return stable_in_all(t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("SELECT p_brand, list(DISTINCT p_type ORDER BY p_type) AS types, min(p_retailprice) AS cheapest, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest_part FROM part GROUP BY 1")
def a29_collected(t):
    return t("part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.min("p_retailprice").alias("cheapest"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest_part"))


@query("""SELECT unnest(['orders', 'urgent_share', 'mean_price']) AS "check", unnest([n, u, m]) AS value, unnest([CASE WHEN n < 100 THEN 'error' WHEN n < 1000 THEN 'warning' ELSE 'ok' END,
  CASE WHEN u < 0.01 THEN 'error' WHEN u < 0.9 THEN 'warning' ELSE 'ok' END, CASE WHEN m < 1000 THEN 'error' WHEN m < 2000 THEN 'warning' ELSE 'ok' END]) AS status
  FROM (SELECT count(*)::DOUBLE AS n, avg((o_orderpriority = '1-URGENT')::INT) AS u, round(avg(o_totalprice), 2) AS m FROM orders)""")
def d38_quality_gate(t):
    return catalog.gate(t("orders"), {"orders": (F.count("*"), 1000, 100), "urgent_share": (F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")), 0.9, 0.01), "mean_price": (F.round(F.avg("o_totalprice"), 2), 2000, 1000)})


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 50)")
def g1_orphans(t):
    return catalog.orphans(t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), t("part").filter("p_size < 50"), "l_partkey", "p_partkey")


@query("""WITH i AS (SELECT o_custkey, l_partkey, max(l_extendedprice) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, l_partkey) AS p FROM i), x AS (SELECT * FROM p WHERE p <= 6),
f AS (SELECT o_custkey, count(*) AS n, list(l_partkey ORDER BY p) AS alls FROM x GROUP BY 1), c AS (SELECT a.o_custkey, a.p AS p1, b.p AS p2, d.p AS p3, [a.l_partkey, b.l_partkey, d.l_partkey] AS items
  FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.p < b.p JOIN x d ON d.o_custkey = a.o_custkey AND b.p < d.p JOIN f ON f.o_custkey = a.o_custkey AND n > 3),
k AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY p1, p2, p3) AS pack_no, items FROM c UNION ALL SELECT o_custkey, 1, alls FROM f WHERE n <= 3)
SELECT o_custkey, pack_no, 'pack_' || substr(md5(array_to_string(list_sort(list_transform(items, lambda v: v::VARCHAR)), '|')), 1, 10) AS pack_key FROM k WHERE pack_no <= 10""")
def d17_packs(t):
    items = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_extendedprice"), "o_orderkey").groupBy("o_custkey", "l_partkey").agg(F.max("l_extendedprice").alias("s"))
    out = ranking.packs(items, "o_custkey", "l_partkey", [F.desc("s"), F.col("l_partkey")])
    return out.select("o_custkey", "pack_no", S.pack_key(F.transform("items", lambda v: v.cast("string"))).alias("pack_key"))


_SELECTION = """of AS (SELECT l_partkey % 40 AS component, l_partkey AS product, l_suppkey % 7 AS shop, max(l_quantity / 50) AS score, l_partkey % 11 = 0 AS blocked FROM lineitem GROUP BY ALL),
best AS (SELECT * FROM of QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, product, shop) <= 8),
slots AS (SELECT l_orderkey AS pack, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey % 40) AS slot, l_partkey % 40 AS component FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 3),
c AS (SELECT pack, slot, product, shop, score FROM slots JOIN best USING (component) WHERE NOT blocked)"""


@query(f"""WITH RECURSIVE {_SELECTION},
r AS (SELECT pack, 0::BIGINT AS step, NULL::BIGINT AS product, NULL::BIGINT AS shop, []::BIGINT[] AS used, []::BIGINT[] AS shops, []::BIGINT[] AS entry, max(slot) * 2 AS last FROM slots GROUP BY 1 UNION ALL
  SELECT pack, step, product, shop, CASE WHEN product IS NULL THEN used ELSE list_append(used, product) END, CASE WHEN product IS NULL THEN shops ELSE list_append(shops, shop) END, entry, last FROM (
    SELECT b.pack, b.step + 1 AS step, c.product, c.shop, b.used, b.shops, b.entry, b.last, row_number() OVER (PARTITION BY b.pack ORDER BY c.score + 0.06::DOUBLE * greatest(0.35::DOUBLE, 1 - 0.20::DOUBLE * len(list_filter(b.entry, lambda x: x = c.shop))) DESC NULLS LAST, c.product, c.shop) AS rn
    FROM (SELECT pack, step, used, shops, last, CASE WHEN step % 2 = 0 THEN shops ELSE entry END AS entry FROM r WHERE step < last) AS b LEFT JOIN c ON c.pack = b.pack AND c.slot = b.step // 2 + 1 AND NOT list_contains(b.used, c.product)) WHERE rn = 1)
SELECT pack, (step + 1) // 2 AS slot, product, shop FROM r WHERE product IS NOT NULL""")
def d22_greedy_selection(t):
    """Orders are packs, their first lines' components the slots; a component has its eight best offers, of which every eleventh product is blocked."""
    li, component = t("lineitem"), (F.col("l_partkey") % 40).alias("component")
    offers = li.groupBy(component, F.col("l_partkey").alias("product"), (F.col("l_suppkey") % 7).alias("shop")).agg(F.max(F.col("l_quantity") / 50).alias("score"))
    best = ranking.best_per_key(offers, ["component"], [F.desc("score"), F.col("product"), F.col("shop")], 8).withColumn("blocked", F.col("product") % 11 == 0)
    lines = li.filter("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("pack")).agg(F.array_sort(F.collect_set(F.struct(F.col("l_linenumber").alias("at"), component))).alias("_lines"))
    packs_of = lines.select("pack", F.array_distinct(F.transform("_lines", lambda x: x["component"])).alias("components"))
    return ranking.selection_of_packs(packs_of, "pack", "components", best, "component", "product", "shop", "score", per_slot=2, blocked="blocked")


_PACK_SQL = ORACLES["d17_packs"].rpartition("SELECT o_custkey")[0].replace("max(l_extendedprice) AS s", "max(l_extendedprice) AS s, round(max(l_quantity) / 50, 4)::DOUBLE AS q, min(o_orderpriority) AS pri")


@query(f"""{_PACK_SQL}, d AS (SELECT k.*, 'pack_' || substr(md5(array_to_string(list_sort(list_transform(items, lambda v: v::VARCHAR)), '|')), 1, 10) AS pack_id FROM k WHERE pack_no <= 10),
st AS (SELECT DISTINCT pack_id, n, avg_score FROM (SELECT pack_id, o_custkey % 17 AS n, (o_custkey % 10) / 10.0::DOUBLE AS avg_score, row_number() OVER (PARTITION BY pack_id ORDER BY o_custkey) AS rn FROM d WHERE o_custkey % 3 = 0 AND o_custkey % 17 > 0) WHERE rn = 1), tot AS (SELECT greatest(coalesce(sum(n), 0), 1) AS total FROM st),
us AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority <> '5-LOW') AS u FROM orders GROUP BY 1),
m AS (SELECT o_custkey, pack_no, pack_id, avg(coalesce(nullif(q, 0), 0.7)) AS gnn, count(DISTINCT pri) FILTER (WHERE pri <> '5-LOW' AND pri <> '3-MEDIUM') AS cov FROM (SELECT d.*, unnest(items) AS l_partkey FROM d) JOIN i USING (o_custkey, l_partkey) GROUP BY 1, 2, 3),
z AS (SELECT o_custkey, pack_no, pack_id, gnn, CASE WHEN len(u) > 0 THEN cov / len(u) ELSE 1 END AS cov, CASE WHEN n IS NULL THEN 0.70 ELSE (n * avg_score + 5.6::DOUBLE) / (n + 8) END AS fb, coalesce(n, 0) AS n, total FROM m JOIN us USING (o_custkey) LEFT JOIN st USING (pack_id), tot),
y AS (SELECT *, 0.45::DOUBLE * gnn + 0.25::DOUBLE * cov + 0.30::DOUBLE * fb + 0.01::DOUBLE * sqrt(ln(total + 1) / (n + 1)) AS final FROM z)
SELECT o_custkey, pack_id, row_number() OVER (PARTITION BY o_custkey ORDER BY round(final, 9) DESC, pack_no) AS rank, round(final, 6) AS score_final, round(cov, 6)::DOUBLE AS score_coverage, n AS feedback_count FROM y""")
def d17_reranked(t):
    """Candidate packs by score, coverage of the customer's priorities and feedback; priority 5-LOW stands for health, 3-MEDIUM for no condition."""
    lines = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_extendedprice", "l_quantity"), "o_orderkey")
    items = lines.groupBy("o_custkey", "l_partkey").agg(F.max("l_extendedprice").alias("s"), F.round(F.max("l_quantity") / 50, 4).alias("score"), F.min("o_orderpriority").alias("condition"))
    packs = ranking.packs(items.withColumn("item", F.struct(F.col("l_partkey").alias("component"), "score", "condition")), "o_custkey", "item", [F.desc("s"), F.col("l_partkey")])
    named = packs.select("o_custkey", S.pack_key(F.transform("items", lambda x: x["component"].cast("string"))).alias("pack_id")).filter("o_custkey % 3 = 0 AND o_custkey % 17 > 0")
    first = named.groupBy("pack_id").agg(F.min("o_custkey").alias("k"))
    stats = first.select("pack_id", (F.col("k") % 17).alias("n"), ((F.col("k") % 10) / 10).alias("avg_score"))
    useful = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("conditions"))
    out = ranking.reranked(packs, "o_custkey", "items", useful, stats, no_condition="3-MEDIUM", healthy="5-LOW")
    return out.select("o_custkey", "pack_id", "rank", F.round("score_final", 6).alias("score_final"), F.round("score_coverage", 6).alias("score_coverage"), "feedback_count")


_OFFERS = """WITH li AS (SELECT l_partkey, l_suppkey, count(*) AS shown, avg(l_quantity / 50) AS review, count_if(l_returnflag = 'A') / count(*) AS verified, max(o_orderdate) AS seen, avg(l_extendedprice / l_quantity) AS price, count(DISTINCT l_linenumber) AS parts FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
pp AS (SELECT l_partkey, sum(shown) AS n FROM li GROUP BY 1), ss AS (SELECT l_suppkey, sum(shown) AS n FROM li GROUP BY 1), tot AS (SELECT sum(shown) AS n, max(seen) AS now FROM li),
o AS (SELECT li.*, p_size, p_brand, pp.n / tot.n AS p_share, ss.n / tot.n AS s_share, date_diff('day', seen, now) AS days, l_partkey % 3 = 0 AS budget FROM li JOIN part ON p_partkey = l_partkey JOIN pp USING (l_partkey) JOIN ss USING (l_suppkey), tot),
x AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN 1.0 WHEN p_size % 4 = 1 THEN 0.85 WHEN p_size % 4 = 2 THEN 0.70 ELSE 0.45 END AS trace, p_size % 4 <= 1 AS registered,
  CASE WHEN budget AND price > 1500 THEN greatest(0.05, 0.4 * (1 - least(1.0, (price - 1500) / 1500))) WHEN budget THEN least(1, greatest(0, 1 - 0.30 * ((price - 900) / 600))) ELSE greatest(0.05, least(1, 1 / (1 + price / 100))) END AS pr,
  CASE WHEN p_size % 6 = 5 THEN 0.25 WHEN p_size % 5 = 0 THEN 0.75 WHEN shown - 1 <= 0 THEN 0.40 WHEN shown - 1 < 5 THEN 0.75 ELSE 1.0 END AS st, CASE WHEN parts <= 1 THEN 1.0 WHEN parts = 2 THEN 0.78 WHEN parts <= 4 THEN 0.62 ELSE 0.45 END AS unit FROM o),
q AS (SELECT *, 0.50 * trace + 0.20 + 0.15 * (p_size % 6 <> 5)::INT + 0.15 * CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.35 END AS conf FROM x),
c AS (SELECT *, least(1, greatest(0, 0.35 * trace + 0.20 * registered::INT + 0.12 * (p_size > 10)::INT + 0.12 * (pr > 0.05)::INT + 0.08 + 0.08 * (p_size % 2 = 0)::INT + 0.05 * (unit >= 0.95)::INT + CASE WHEN conf >= 0.85 THEN 0.06 WHEN conf >= 0.68 THEN 0.03 ELSE 0 END)) AS quality,
  greatest(0.35, 1 - 0.20 * (l_suppkey % 5)) AS shop, CASE WHEN days <= 7 THEN 1.0 WHEN days <= 30 THEN 0.85 WHEN days <= 90 THEN 0.65 ELSE 0.45 END AS fresh, 0.60 * greatest(0.25, 1 - least(0.75, 4 * p_share)) + 0.40 * greatest(0.40, 1 - least(0.60, 2.5 * s_share)) AS expo FROM q)
SELECT l_partkey, l_suppkey, round(least(1, greatest(0, CASE WHEN budget THEN 0.24 * (p_size / 50.0) + 0.13 * unit + 0.24 * (pr + st) / 2 + 0.14 * review + 0.11 * quality + 0.05 * shop + 0.04 * fresh + 0.03 * expo + 0.02 * verified
  ELSE 0.26 * (p_size / 50.0) + 0.14 * unit + 0.16 * (pr + st) / 2 + 0.20 * review + 0.12 * quality + 0.06 * shop + 0.04 * fresh + 0.03 * expo + 0.03 * verified END + 0.04 * (p_brand = 'Brand#12')::INT - 0.12 * (p_size % 9 = 0)::INT)), 10)::DOUBLE AS score FROM c"""


@query(_OFFERS)
def d20_product_score(t):
    """Offers of a product by a shop: every term comes from the tables."""
    li = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    q = F.col("l_quantity")
    offers = li.groupBy("l_partkey", "l_suppkey").agg(
        F.count("*").alias("shown"), F.avg(q / 50).alias("review"), (F.count_if(F.col("l_returnflag") == "A") / F.count("*")).alias("verified"), F.max("o_orderdate").alias("seen"), F.avg(F.col("l_extendedprice") / q).alias("price"), F.size(F.collect_set("l_linenumber")).alias("parts")
    )
    total = offers.agg(F.sum("shown").alias("all"), F.max("seen").alias("now"))
    share = lambda key, name: offers.groupBy(key).agg(F.sum("shown").alias(name))
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand")
    o = offers.join(p, "l_partkey").join(share("l_partkey", "pn"), "l_partkey").join(share("l_suppkey", "sn"), "l_suppkey").crossJoin(F.broadcast(total))
    s, budget = F.col("p_size"), F.col("l_partkey") % 3 == 0
    trace = S.traceability_score(F.when(s % 4 <= 1, "DE1"), F.when(s % 4 == 0, "digemid").when(s % 4 == 2, "trace").otherwise(""))
    low, high = F.when(budget, 900.0), F.when(budget, 1500.0)
    price, there = S.price_score(F.col("price"), low, high), F.when(s % 6 == 5, "out of stock").otherwise("Available")
    stock = S.stock_score(F.when(s % 5 != 0, F.col("shown") - 1), there)
    unit, flag = S.unit_score(F.col("parts")), lambda c, w: F.when(c, w).otherwise(0.0)
    confidence = S.confidence_of(trace, F.lit(True), s % 6 != 5, F.when(s % 2 == 0, 1.0).otherwise(0.35))
    quality = S.quality_score(trace, s % 4 <= 1, s > 10, price > 0.05, F.lit(True), s % 2 == 0, unit, confidence)
    exposure = 0.60 * S.exposure(F.col("pn") / F.col("all"), 4.0) + 0.40 * S.exposure(F.col("sn") / F.col("all"), 2.5, 0.40, 0.60)
    terms = {
        "match": s / 50.0, "unit": unit, "price_stock": (price + stock) / 2, "review": F.col("review"), "quality": quality, "shop": S.shop_score(F.col("l_suppkey") % 5),
        "fresh": S.freshness(F.datediff("now", "seen")), "exposure": exposure, "verified": F.least("verified", F.lit(1.0)),
    }
    score = S.commercial_score(terms, budget, flag(F.col("p_brand") == "Brand#12", 0.04), flag(s % 9 == 0, 0.12))
    return o.select("l_partkey", "l_suppkey", F.round(score, 10).alias("score"))


@query("SELECT n_name, list(s_suppkey::VARCHAR || ' ' || s_name ORDER BY s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def j23_nested_history(t):
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat_ws(" ", x["s_suppkey"].cast("string"), x["s_name"])).alias("suppliers"))


@query("SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS registry_key, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug FROM customer")
def f2_keys(t):
    return t("customer").select("c_custkey", X.registry_key(F.col("c_name")).alias("registry_key"), X.slug(F.col("c_name")).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN ('0x' || substr(sha256(p_name || p_partkey::VARCHAR), 1, 8))::BIGINT % 100 < 50 THEN 'calibration' ELSE 'evaluation' END AS split,
  substr(sha256('salt' || p_partkey::VARCHAR), 1, 16) AS case_id FROM part""")
def m21_hash_split(t):
    key = F.concat("p_name", F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", S.hash_split(key).alias("split"), F.substring(F.sha2(F.concat(F.lit("salt"), F.col("p_partkey").cast("string")).cast("binary"), 256), 1, 16).alias("case_id"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderpriority <> '5-LOW'),
f AS (SELECT o_custkey, c, min(n) AS n FROM o GROUP BY 1, 2), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n) <= 3)
SELECT o_custkey, coalesce(string_agg(c, '+' ORDER BY c) FILTER (WHERE c IS NOT NULL), '') AS priorities FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN k USING (o_custkey) GROUP BY 1""")
def m19_context_key(t):
    """A customer's first three priorities by date, 5-LOW as the healthy one."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return t("orders").groupBy("o_custkey").agg(own.alias("c")).select("o_custkey", S.context_key(F.col("c"), "5-low").alias("priorities"))


@query("""SELECT c_custkey, round(142 * pow(least(c / k, 1), a) * pow(greatest(c / k, 1), -1.2) * pow(0.9938, age) * f, 3) AS egfr FROM (SELECT c_custkey, abs(c_acctbal) / 5000 + 0.3 AS c, 20 + c_custkey % 60 AS age,
  CASE WHEN c_nationkey % 2 = 0 THEN 0.7::DOUBLE ELSE 0.9 END AS k, CASE WHEN c_nationkey % 2 = 0 THEN -0.241::DOUBLE ELSE -0.302 END AS a, CASE WHEN c_nationkey % 2 = 0 THEN 1.012::DOUBLE ELSE 1.0 END AS f FROM customer)""")
def m13_egfr(t):
    return t("customer").select("c_custkey", F.round(S.egfr(F.abs("c_acctbal") / 5000 + 0.3, 20 + F.col("c_custkey") % 60, F.col("c_nationkey") % 2 == 0), 3).alias("egfr"))


@query("""WITH x AS (SELECT c_custkey, c_acctbal AS v, CASE WHEN c_nationkey % 3 = 0 THEN 1500 END AS ol, CASE WHEN c_nationkey % 4 = 0 THEN 7000 END AS oh FROM customer),
s AS (SELECT *, CASE WHEN v < -500 THEN 'critical_low' WHEN v > 9500 THEN 'critical_high' WHEN v < coalesce(ol, 1000) THEN 'low' WHEN v > coalesce(oh, 9000) THEN 'high' WHEN v < 3000 AND ol IS NULL THEN 'borderline' ELSE 'normal' END AS status FROM x)
SELECT c_custkey, status, CASE WHEN status LIKE 'critical%' THEN 'critical' WHEN status IN ('low', 'high') THEN 'warning' WHEN status = 'borderline' THEN 'info' ELSE 'normal' END AS severity FROM s""")
def m14_status_ladder(t):
    border = lambda x: F.lit(float(x))
    own_low, own_high = F.when(F.col("c_nationkey") % 3 == 0, 1500.0), F.when(F.col("c_nationkey") % 4 == 0, 7000.0)
    status = S.status_ladder(F.col("c_acctbal"), border(-500), border(9500), border(1000), border(9000), border(3000), own_low, own_high)
    return t("customer").select("c_custkey", status.alias("status"), S.severity(status).alias("severity"))


@query("SELECT n_name, round(sum(c_acctbal * (c_mktsegment = 'BUILDING')::INT) / sum(c_acctbal), 5) AS weighted FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def m27_weighted_prevalence(t):
    j = t("customer").filter("c_acctbal > 0").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("c_acctbal") * (F.col("c_mktsegment") == "BUILDING").cast("int")) / F.sum("c_acctbal"), 5).alias("weighted"))
