"""Queries over events, documents, pages, embeddings and rules: streams as batch, text, graphs, rule engine, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.functions import scores as S
from siftspark.functions import text as X
from siftspark.operators import evaluation, events, graph, matching, ranking, rules
from siftspark.operators.bounds import bounded
from siftspark.plans.core import query

# a small rule dimension over customers: condition, field, operator, value, weight
RULES = [
    ("debt", "c_acctbal", "lte", "500", 0.42), ("debt", "n_orders", "lt", "5", 0.20), ("debt", "max_price", "gte", "300000", 0.16), ("debt", "c_mktsegment", "eq", "BUILDING", 0.22),
    ("growth", "n_orders", "gte", "12", 0.35), ("growth", "max_price", "gte", "400000", 0.15), ("growth", "c_mktsegment", "in", "MACHINERY|AUTOMOBILE", 0.30), ("growth", "c_name", "contains", "99", 0.10),
]
FAMILIES = [("c_acctbal", "c_acctbal", True), ("max_price", "spend", False), ("n_orders", "activity", False)]
PROXIES = [("c_mktsegment", ["spend", "c_acctbal"]), ("c_name", ["activity"])]
BASE = [("debt", 0.70), ("growth", 0.52), ("quiet", 0.30)]
FIELDS = ["c_acctbal", "n_orders", "max_price", "c_mktsegment", "c_name"]


def _rows(rows):
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) if not isinstance(v, list) else str(v) for v in r) + ")" for r in rows)


_HITS = f"""WITH w AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_name, coalesce(n, 0) AS n_orders, m AS max_price FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey),
rule(cond, field, op, val, weight) AS (VALUES {_rows(RULES)}), fam(field, family, is_lab) AS (VALUES {_rows(FAMILIES)}), prox(field, components) AS (VALUES {_rows(PROXIES)}),
h AS (SELECT c_custkey, cond, field, op, weight::DOUBLE AS weight FROM w, rule WHERE CASE field
  WHEN 'c_acctbal' THEN c_acctbal >= 0 AND c_acctbal <= val::DOUBLE
  WHEN 'n_orders' THEN CASE op WHEN 'lt' THEN n_orders < val::DOUBLE ELSE n_orders >= val::DOUBLE END
  WHEN 'max_price' THEN max_price >= val::DOUBLE WHEN 'c_mktsegment' THEN list_contains(string_split(val, '|'), c_mktsegment) ELSE contains(c_name, val) END)"""


def _fold(source: str, key: str) -> str:
    """Score by family, step by step: `source` has (key, cond, field, w), a row a field. The result is `scored`."""
    return f"""raw AS (SELECT {key}, cond, coalesce(family, s.field) AS family, max(w) AS w, bool_or(coalesce(is_lab, false)) AS lab FROM {source} s LEFT JOIN fam ON fam.field = s.field WHERE s.field NOT IN (SELECT field FROM prox) GROUP BY ALL),
b AS (SELECT k.{key}, k.cond, coalesce(sum(r.w), 0) AS raw_score, count(r.family) AS n, coalesce(bool_or(lab), false) AS lab, coalesce(list(r.family) FILTER (WHERE r.family IS NOT NULL), []) AS claimed FROM (SELECT DISTINCT {key}, cond FROM {source}) k LEFT JOIN raw r ON r.{key} = k.{key} AND r.cond = k.cond GROUP BY ALL),
y AS (SELECT {key}, cond, s.field, w, components AS c, row_number() OVER (PARTITION BY {key}, cond ORDER BY w DESC, s.field) AS i FROM {source} s JOIN prox ON prox.field = s.field),
f AS (WITH RECURSIVE z AS (SELECT {key}, cond, 0::BIGINT AS i, raw_score, 0::DOUBLE AS p, n, lab, claimed, []::VARCHAR[] AS counted FROM b UNION ALL
  SELECT z.{key}, z.cond, y.i, raw_score, CASE WHEN list_has_any(claimed, c) THEN p ELSE p + w END, CASE WHEN list_has_any(claimed, c) THEN n ELSE n + 1 END, lab, CASE WHEN list_has_any(claimed, c) THEN claimed ELSE claimed || c END, CASE WHEN list_has_any(claimed, c) THEN counted ELSE counted || ['proxy:' || y.field] END
  FROM z JOIN y ON y.{key} = z.{key} AND y.cond = z.cond AND y.i = z.i + 1) SELECT * FROM z),
scored AS (SELECT {key}, cond, round(arg_max(raw_score + p, i), 4)::DOUBLE AS score, arg_max(n, i)::INT AS n_families, bool_or(lab) OR max(n) >= 2 AS corroborated, arg_max(counted, i) AS proxies FROM f GROUP BY ALL)"""


def _dims(spark):
    r = spark.createDataFrame(RULES, "cond string, field string, op string, value string, weight double")
    f = spark.createDataFrame(FAMILIES, "field string, family string, is_lab boolean")
    p = spark.createDataFrame(PROXIES, "field string, components array<string>")
    return F.broadcast(r), F.broadcast(f), F.broadcast(p)  # as many rows as there are rules


def _wide(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("max_price"))
    return t("customer").join(o, "c_custkey", "left").withColumn("n_orders", F.coalesce("n", F.lit(0)))


def _hits(t):
    w = _wide(t)
    r, f, p = _dims(w.sparkSession)
    return rules.fired(w, "c_custkey", FIELDS, r), r, f, p


@query(_HITS + " SELECT c_custkey, cond, field, weight FROM h")
def p1_rule_predicates(t):
    return _hits(t)[0].drop("op")


_PF = ", pf AS (SELECT c_custkey, cond, field, sum(weight) AS w FROM h GROUP BY ALL), "


@query(_HITS + _PF + _fold("pf", "c_custkey") + " SELECT c_custkey, cond, score, n_families, corroborated FROM scored")
def d2_family_scores(t):
    h, _, f, p = _hits(t)
    return rules.family_scores(h, "c_custkey", f, p).drop("raw_score", "proxies")


@query(_HITS + " SELECT c_custkey, cond, round(sum(weight), 4) AS score, count(*) AS n_rules FROM h GROUP BY ALL")
def d3_sum_scores(t):
    return rules.sum_scores(_hits(t)[0], "c_custkey")


@query(_HITS + _PF + _fold("pf", "c_custkey") + " SELECT c_custkey, cond, len(proxies)::INT AS n_proxies, array_to_string(proxies, '|') AS counted FROM scored")
def d2_proxy_fold(t):
    h, _, f, p = _hits(t)
    return rules.family_scores(h, "c_custkey", f, p).select("c_custkey", "cond", F.size("proxies").alias("n_proxies"), F.array_join("proxies", "|").alias("counted"))


@query(_HITS + _PF.rstrip(", ") + ", cs AS (WITH " + _fold("pf", "c_custkey") + f""" SELECT c_custkey, cond, score FROM scored),
th AS (WITH own AS (SELECT cond, field, op, weight::DOUBLE AS weight FROM rule WHERE field NOT IN (SELECT field FROM fam WHERE is_lab)),
chosen AS (SELECT 1 AS k, cond, field, coalesce(sum(weight) FILTER (WHERE op = 'gte'), 0) + coalesce(max(weight) FILTER (WHERE op <> 'gte'), 0) AS w FROM own GROUP BY ALL), {_fold("chosen", "k")},
ss AS (SELECT cond, round(sum(w), 4) AS sum_max FROM chosen GROUP BY 1),
ff AS (SELECT cond, coalesce(family, own.field) AS family, own.field, CASE WHEN bool_and(op = 'gte') THEN sum(weight) ELSE max(weight) END AS w FROM own LEFT JOIN fam ON fam.field = own.field WHERE own.field NOT IN (SELECT field FROM prox) GROUP BY ALL),
fm AS (SELECT cond, family, max(w) AS w FROM ff GROUP BY ALL), tw AS (SELECT cond, round(sum(w) FILTER (WHERE rn <= 2), 4) AS two FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY w DESC, family) AS rn FROM fm) GROUP BY 1 HAVING count(*) >= 2),
base(cond, threshold) AS (VALUES {_rows(BASE)}), al AS (SELECT base.cond, threshold::DOUBLE AS t, coalesce(score, 0) AS family_max, coalesce(sum_max, 0) AS sum_max, two FROM base LEFT JOIN scored USING (cond) LEFT JOIN ss USING (cond) LEFT JOIN tw USING (cond))
SELECT cond, family_max, (CASE WHEN family_max >= t OR sum_max < t THEN t ELSE coalesce(least(t, two), t) END)::DOUBLE AS threshold FROM al)
SELECT c_custkey, cond, score, family_max, threshold, score >= threshold AS reached FROM cs JOIN th USING (cond)""")
def d4_thresholds(t):
    """Each customer's scores beside the thresholds, which follow from the rules alone."""
    h, r, f, p = _hits(t)
    limits = rules.thresholds(r.select("cond", "field", "op", "weight"), f, p, h.sparkSession.createDataFrame(BASE, "cond string, threshold double"))
    scores = rules.family_scores(h, "c_custkey", f, p).select("c_custkey", "cond", "score")
    return scores.join(limits, "cond").select("c_custkey", "cond", "score", "family_max", "threshold", (F.col("score") >= F.col("threshold")).alias("reached"))


#: Supplements that keep a condition from counting as positive.
SUPPRESSING = [("AUTOMOBILE", "b", "iron"), ("AUTOMOBILE", "a", "calcium"), ("BUILDING", "a", "zinc"), ("MACHINERY", "c", "iron")]


@query(f"""WITH u(seg, taken, supplement) AS (VALUES {_rows(SUPPRESSING)}), h AS (SELECT c_custkey, c_mktsegment, abs(c_acctbal) / 20000 AS p, (c_custkey % 10) / 10.0::DOUBLE AS s, c_custkey % 3 = 0 AS ok, c_custkey % 4 = 0 AS lab,
  CASE WHEN c_custkey % 5 = 0 THEN 'a b' WHEN c_custkey % 5 = 1 THEN 'c' ELSE '' END AS taken FROM customer),
f AS (SELECT *, s >= 0.3 AND p < 0.35 AND ok AS lifted, (SELECT min(u.supplement) FROM u WHERE u.seg = h.c_mktsegment AND contains(h.taken, u.taken)) AS supplement FROM h),
g AS (SELECT *, CASE WHEN lifted THEN least(0.98, 0.35::DOUBLE + least(0.12, greatest(0.03, s - 0.35::DOUBLE))) ELSE p END AS q, CASE WHEN NOT lab THEN supplement END AS by_ FROM f)
SELECT c_custkey, round(q::DECIMAL(18, 10), 4)::DOUBLE AS probability, q >= 0.35 AND ok AND by_ IS NULL AS positive, by_ AS suppressed_by, CASE WHEN lifted THEN 'model+rules' ELSE 'model' END AS score_basis FROM g""")
def d9_rule_lift(t):
    """Decisions on customers: probability, rules' lift, corroboration, supplements that are taken already."""
    c, k = t("customer"), F.col("c_custkey")
    taken = F.split(F.when(k % 5 == 0, "a b").when(k % 5 == 1, "c").otherwise(""), " ")
    of = F.array_compact(F.array(*[F.when((F.col("c_mktsegment") == seg) & F.array_contains(taken, code), F.lit(name)) for seg, code, name in SUPPRESSING]))
    d = rules.decision(F.abs("c_acctbal") / 20000, (k % 10) / 10, F.lit(0.3), F.lit(0.35), k % 3 == 0, k % 4 == 0, of)
    return c.select("c_custkey", d.alias("_d")).select("c_custkey", "_d.*")


@query("""WITH k AS (SELECT p_partkey, p_brand, round(greatest(0.05, 0.36 * CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.82 WHEN 2 THEN 0.72 ELSE CASE p_size % 3 WHEN 0 THEN 0.96 WHEN 1 THEN 0.66 ELSE 0.55 END END + 0.22 * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.74 ELSE 0.70 END
  + 0.18 * 0.90 + 0.14 * CASE WHEN p_size > 25 THEN 0.72 ELSE 1.0 END + 0.10 * (1 - CASE WHEN p_size > 40 THEN 0.25 ELSE 0.08 END) - CASE WHEN p_size % 7 = 0 THEN 0.1 ELSE 0 END), 4)::DOUBLE AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM k) SELECT p_brand, p_partkey, score, rank FROM r WHERE rank <= 3""")
def d14_evidence_ranking(t):
    s = F.col("p_size")
    grade = F.when(s % 4 == 0, "high").when(s % 4 == 1, "moderate").when(s % 4 == 2, "low").otherwise("none")
    strength = F.when(s % 3 == 0, "strong_with_lab").when(s % 3 == 1, "contextual").otherwise("unknown")
    role = F.when(s % 3 == 0, "primary").when(s % 3 == 1, "supportive").otherwise("other")
    score = S.evidence_score(grade, role, F.lit("official_health_resource"), F.when(s > 25, "required").otherwise("no"), F.when(s > 40, "high").otherwise("unknown"), F.when(s % 7 == 0, 0.1).otherwise(0.0), strength)
    return ranking.best_per_key(t("part").select("p_brand", "p_partkey", F.round(score, 4).alias("score")), ["p_brand"], [F.desc("score"), F.col("p_partkey")], 3)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, user_id, event_type FROM e WHERE event_type <> 'view' OR rn = 1""")
def u10_impressions_once(t):
    return events.drop_repeated(t("events"), ["user_id", "event_type", "value"], ["ts", "event_id"], F.col("event_type") == "view").select("event_id", "user_id", "event_type")


_STEPS = "(SELECT *, date_trunc('day', ts) AS day, user_id::VARCHAR || '|' || date_trunc('day', ts)::DATE::VARCHAR AS session, (event_id % 4)::INT AS step, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'submit' ELSE 'other' END AS kind FROM events)"


def _steps(t):
    kind = F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "purchase", "submit").otherwise("other")
    session = F.concat(F.col("user_id").cast("string"), F.lit("|"), F.to_date("ts").cast("string"))
    return t("events").select("event_id", "ts", "user_id", session.alias("session"), (F.col("event_id") % 4).cast("int").alias("step"), kind.alias("kind"))


@query(f"""WITH e AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 END AS place FROM {_STEPS}),
l AS (SELECT session, arg_max(step, (ts, event_id)) FILTER (WHERE kind = 'view') AS step, bool_or(kind = 'submit') AS done FROM e GROUP BY 1), a AS (SELECT step, count(*) AS abandoned FROM l WHERE NOT done AND step IS NOT NULL GROUP BY 1),
n AS (SELECT step, count(DISTINCT session) FILTER (WHERE kind = 'view') AS viewed, count(DISTINCT session) FILTER (WHERE kind = 'complete') AS completed, coalesce(avg(place) FILTER (WHERE kind = 'view'), 999) AS place FROM e GROUP BY 1)
SELECT step, viewed, completed, coalesce(abandoned, 0) AS abandoned_here, round(coalesce(abandoned, 0) / viewed, 4) AS drop_rate, round(place, 4) AS mean_position FROM n LEFT JOIN a USING (step) WHERE viewed > 0""")
def d42_funnel(t):
    place = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7)
    return events.funnel(_steps(t).withColumn("place", place), "session", "step", "kind", "ts", "event_id", "place")


@query(f"SELECT count(DISTINCT session) FILTER (WHERE kind IN ('view', 'submit')) AS sessions, count(DISTINCT session) FILTER (WHERE kind = 'submit') AS submitted, round(count(DISTINCT session) FILTER (WHERE kind = 'submit') / count(DISTINCT session) FILTER (WHERE kind IN ('view', 'submit')), 4) AS completion_rate FROM {_STEPS}")
def d42_funnel_summary(t):
    return events.funnel_summary(_steps(t), "session", "kind")


@query(f"SELECT session, arg_max(step, ts) FILTER (WHERE kind = 'view') AS last_step, max(ts) AS last_at FROM {_STEPS} GROUP BY 1")
def w3_last_step(t):
    view = F.col("kind") == "view"
    return _steps(t).groupBy("session").agg(F.max_by(F.when(view, F.col("step")), F.when(view, F.col("ts"))).alias("last_step"), F.max("ts").alias("last_at"))


@query(f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS position FROM {_STEPS}) SELECT step, round(coalesce(avg(position) FILTER (WHERE kind = 'view'), 999), 4) AS mean_position FROM p GROUP BY 1")
def w4_mean_position(t):
    from pyspark.sql import Window

    p = _steps(t).withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id")))
    return p.groupBy("step").agg(F.round(F.coalesce(F.avg(F.when(F.col("kind") == "view", F.col("position"))), F.lit(999.0)), 4).alias("mean_position"))


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
z AS (WITH RECURSIVE r AS (SELECT user_id, i, event_id, 0 AS in_window, true AS allowed, [s] AS hits FROM e WHERE i = 1 UNION ALL
  SELECT user_id, i, event_id, len(live)::INT, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, s) ELSE live END
  FROM (SELECT e.user_id, e.i, e.event_id, e.s, list_filter(r.hits, lambda x: x >= e.s - 7200) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)) SELECT * FROM r)
SELECT event_id, in_window, allowed FROM z""")
def w13_rate_limit(t):
    return events.rate_limited(t("events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 7200, 2).select("event_id", "in_window", "allowed")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def e5_tumbling_counts(t):
    return t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS start, event_type FROM events) GROUP BY 1, 2""")
def e5_sliding_counts(t):
    return t("events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) > 86400 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g) SELECT user_id, session_no::BIGINT AS session_no, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2""")
def e6_sessions(t):
    s = events.sessions(t("events"), "user_id", "ts", "event_id", 86400)
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id, count_if(ts >= now - INTERVAL 1 DAY)::BIGINT AS last_day, count_if(ts >= now - INTERVAL 7 DAY)::BIGINT AS last_week, count(*) AS n FROM events, m GROUP BY 1""")
def p7_recent_counts(t):
    e = t("events")
    recent = lambda d: F.count_if(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {d} DAY"))
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).groupBy("user_id").agg(recent(1).alias("last_day"), recent(7).alias("last_week"), F.count("*").alias("n"))


@query("SELECT json_extract(props, '$.k')::BIGINT // 10 AS bucket, count_if(event_type = 'view')::BIGINT AS shown, count_if(event_type = 'click')::BIGINT AS clicked, round(count_if(event_type = 'click') / count_if(event_type = 'view'), 4) AS rate FROM events GROUP BY 1")
def e8_click_rate(t):
    k = F.floor(F.get_json_object("props", "$.k").cast("long") / 10)
    n = t("events").groupBy(k.alias("bucket")).agg(F.count_if(F.col("event_type") == "view").alias("shown"), F.count_if(F.col("event_type") == "click").alias("clicked"))
    return n.withColumn("rate", F.round(F.col("clicked") / F.col("shown"), 4))


@query("""WITH a AS (SELECT * FROM events WHERE event_type = 'error'), b AS (SELECT * FROM events WHERE event_type = 'purchase'),
j AS (SELECT a.event_id, b.event_id AS purchase_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap_us, b.ts AS bt FROM a JOIN b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400 * 1000000::BIGINT)
SELECT event_id, purchase_id, gap_us FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap_us, bt, purchase_id) AS rn FROM j) WHERE rn = 1""")
def j14_nearest_purchase(t):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    a = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    return matching.nearest_in_time(a, b, ["user_id"], "ts", "purchase_ts", 86400, "event_id", "purchase_id").select("event_id", "purchase_id", "gap_us")


@query("SELECT label, i AS part, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def m12_centroids(t):
    return graph.centroids(t("embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("part", "mean")).withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT c.label AS seed, vec_id, list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c)) + 1e-8) AS cos FROM c JOIN embeddings e ON e.label <> c.label)
SELECT seed, vec_id, round(cos, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cos DESC, vec_id) AS rn FROM s WHERE cos >= 0.1) WHERE rn <= 20""")
def t2_similar_to_centroid(t):
    e = t("embeddings")
    norm = lambda c: F.sqrt(graph.dot(F.col(c), F.col(c)))  # noqa: E731  once a row, not once a pair
    c = graph.centroids(e, "label", "embedding").select(F.col("label").alias("seed"), "centroid", norm("centroid").alias("cn"))
    own = e.withColumn("en", norm("embedding"))
    s = own.join(bounded(c, 1000, "centroids"), F.col("label") != F.col("seed")).withColumn("cos", graph.dot(F.col("embedding"), F.col("centroid")) / (F.col("en") * F.col("cn") + 1e-8)).filter("cos >= 0.1")
    return ranking.best_per_key(s, ["seed"], [F.desc("cos"), F.col("vec_id")], 20).select("seed", "vec_id", F.round("cos", 6).alias("cosine"))


@query("""WITH e AS (SELECT DISTINCT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b FROM lineitem WHERE l_quantity > 40), o AS (SELECT o_orderkey, list_sort(list_distinct(list(l_partkey % 50))) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
x AS (SELECT o_orderkey, unnest(ids) AS a, ids FROM o), p AS (SELECT o_orderkey, a, unnest(list_filter(ids, lambda v: v > a)) AS b FROM x) SELECT o_orderkey, p.a, p.b FROM p JOIN e ON p.a = e.a AND p.b = e.b""")
def j18_pairs_with_edges(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 50).alias("p"), (F.col("l_suppkey") % 50).alias("s"), "l_quantity")
    edges = li.filter("l_quantity > 40").select(F.least("p", "s").alias("a"), F.greatest("p", "s").alias("b")).distinct()
    lists = li.join(t("orders").select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.collect_set("p").alias("ids"))
    return graph.pairs_within(lists, "o_orderkey", F.col("ids")).join(edges, ["a", "b"], "left_semi").select("o_orderkey", "a", "b")


@query("SELECT a, b FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem)")
def u6_symmetric_closure(t):
    return graph.symmetric(t("lineitem"), "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))


@query("""SELECT doc_id, trim(regexp_replace(translate(lower(text), 'áàäâãåéèëêíìïîóòöôõúùüûñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents""")
def f1_plain_text(t):
    return t("documents").select("doc_id", X.plain_text(F.col("text")).alias("plain"))


@query("""SELECT doc_id, len(list_distinct(list_filter(string_split(trim(regexp_replace(translate(lower(text), 'áàäâãåéèëêíìïîóòöôõúùüûñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9]+', ' ', 'g')), ' '),
  lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ('the', 'of', 'de', 'la'))))::INT AS n_tokens FROM documents""")
def f5_token_sets(t):
    return t("documents").select("doc_id", F.size(X.tokens(F.col("text"), ("the", "of", "de", "la"))).alias("n_tokens"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b9[0-9]{8}\b', '[PHONE]', 'g'), '\b[0-9]{8}\b', '[ID]', 'g') AS text FROM documents""")
def f21_redact(t):
    return t("documents").select("doc_id", X.redact(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS mail, regexp_matches(text, '\b9[0-9]{8}\b') AS phone, regexp_matches(text, '\b[0-9]{8}\b') AS id_number FROM documents")
def f22_personal_data(t):
    c = F.col("text")
    return t("documents").select("doc_id", c.rlike(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}").alias("mail"), c.rlike(r"\b9[0-9]{8}\b").alias("phone"), c.rlike(r"\b[0-9]{8}\b").alias("id_number"))


def _any_of(words):
    return "(" + " OR ".join(f"contains(x, '{w}')" for w in words) + ")"


@query(f"""WITH x AS (SELECT doc_id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS x FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(x, '\\s+'), lambda w: trim(w, '.,;:!?¡¿()[]{{}}')), lambda w: w <> '') AS w FROM x)
SELECT doc_id, array_to_string(list_filter([CASE WHEN {_any_of(["http://", "https://", "www."])} THEN 'contains_url' END, CASE WHEN contains(x, '@') AND contains(x, '.') THEN 'contains_contact' END,
  CASE WHEN len(list_filter(list_distinct(string_split(x, '')), lambda c: contains(x, repeat(c, 8)))) > 0 THEN 'repeated_characters' END, CASE WHEN {_any_of(X.MEDICAL_CLAIM)} THEN 'medical_claim' END, CASE WHEN {_any_of(X.PERSONAL_DATA)} THEN 'personal_data' END,
  CASE WHEN {_any_of(X.UNSAFE_DOSING)} THEN 'unsafe_dosing' END, CASE WHEN len(w) >= 8 AND len(list_distinct(w)) / len(w) <= 0.45 THEN 'repeated_words' END], lambda f: f IS NOT NULL), ';') AS flags FROM x JOIN w USING (doc_id)""")
def f23_spam_flags(t):
    return t("documents").select("doc_id", F.array_join(X.spam_flags(F.col("text")), ";").alias("flags"))


@query("""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) AS base, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\\1', 'g'), '&&+', '&', 'g'), '\\?&+', '?', 'g'), '[?&]+$', '') AS clean FROM pages""")
def f24_urls(t):
    return t("pages").select("page_id", X.base_url(F.col("url")).alias("base"), X.without_tracking(F.col("url")).alias("clean"))


@query("""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS n_links FROM pages""")
def f19_title_and_links(t):
    return t("pages").select("page_id", X.title(F.col("html")).alias("title"), F.size(X.links(F.col("html"))).alias("n_links"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages""")
def f4_strip_tags(t):
    return t("pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1000 ELSE p_retailprice END AS value FROM part WHERE p_partkey % 3 <> 0""")
def f10_locale_number(t):
    p = t("part").filter("p_partkey % 3 != 0")
    return p.select("p_partkey", X.locale_number(F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(","))).alias("value"))


_SCORED = "(SELECT doc_id, lang, quality, toxic, least(1, n_chars / 4000.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id))"


def _scored(t):
    return t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id").withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 4000.0)).withColumn("y", F.col("quality") == 1)


@query(f"""WITH c AS (SELECT lang, count_if(p >= 0.5 AND quality = 1) AS tp, count_if(p >= 0.5 AND quality <> 1) AS fp, count_if(p < 0.5 AND quality = 1) AS fn, count_if(p < 0.5 AND quality <> 1) AS tn FROM {_SCORED} GROUP BY 1)
SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall, CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 4) END AS specificity,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) END AS f1,
  CASE WHEN tp + fn > 0 THEN round(greatest(0, (tp / (tp + fn) + 3.8416 / (2 * (tp + fn)) - 1.96::DOUBLE * sqrt(tp / (tp + fn) * (1 - tp / (tp + fn)) / (tp + fn) + 3.8416 / (4 * (tp + fn) * (tp + fn)))) / (1 + 3.8416 / (tp + fn))), 4) END AS recall_low,
  CASE WHEN tp + fn > 0 THEN round(least(1, (tp / (tp + fn) + 3.8416 / (2 * (tp + fn)) + 1.96::DOUBLE * sqrt(tp / (tp + fn) * (1 - tp / (tp + fn)) / (tp + fn) + 3.8416 / (4 * (tp + fn) * (tp + fn)))) / (1 + 3.8416 / (tp + fn))), 4) END AS recall_high FROM c""")
def a12_confusion(t):
    return evaluation.confusion(_scored(t), ["lang"], F.col("p") >= 0.5, F.col("y"))


@query(f"SELECT lang, round(avg((p - quality) * (p - quality)), 6) AS brier, round(avg(p) FILTER (WHERE quality = 1), 6) AS mean_positive, round(avg(p) FILTER (WHERE quality = 0), 6) AS mean_negative FROM {_SCORED} GROUP BY 1")
def a14_brier(t):
    return evaluation.brier(_scored(t), ["lang"], F.col("p"), F.col("quality"))


@query(f"SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM (SELECT lang, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(quality) AS my FROM {_SCORED} GROUP BY 1, 2) GROUP BY 1")
def a15_calibration_error(t):
    return evaluation.calibration_error(_scored(t), ["lang"], F.col("p"), F.col("quality"))


@query(f"""WITH r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS rk FROM {_SCORED})
SELECT lang, round(CASE WHEN sum(quality) > 0 AND count(*) > sum(quality) THEN (sum(rk) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))) END, 6) AS auc FROM r GROUP BY 1""")
def a16_auc(t):
    return evaluation.auc(_scored(t), ["lang"], F.col("p"), F.col("quality"))


@query(f"""WITH b AS (SELECT p, count(*) AS n, sum(quality) AS pos FROM {_SCORED} GROUP BY 1), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM b WINDOW w AS (ORDER BY p DESC)) SELECT 'all' AS part, round(sum(pos * cp / cn) / sum(pos), 6) AS average_precision FROM c""")
def a16_average_precision(t):
    return evaluation.average_precision(_scored(t).withColumn("part", F.lit("all")), ["part"], F.col("p"), F.col("quality"))


@query(f"""SELECT round(t, 2)::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM (SELECT (20 + g) / 100 AS t,
  count_if(floor(round(p * 100, 6)) >= 20 + g AND quality = 1) AS tp, count_if(floor(round(p * 100, 6)) >= 20 + g AND quality = 0) AS fp, count_if(floor(round(p * 100, 6)) < 20 + g AND quality = 1) AS fn FROM {_SCORED}, range(61) r(g) GROUP BY 1)""")
def l3_threshold_grid(t):
    return evaluation.threshold_grid(_scored(t), F.col("p"), F.col("quality"))


@query(f"""WITH g AS (SELECT (20 + g) / 100 AS t, count_if(floor(round(p * 100, 6)) >= 20 + g AND quality = 1) AS tp, count_if(floor(round(p * 100, 6)) >= 20 + g AND quality = 0) AS fp, count_if(floor(round(p * 100, 6)) < 20 + g AND quality = 1) AS fn FROM {_SCORED}, range(61) r(g) GROUP BY 1)
SELECT round(t, 2)::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1""")
def l4_best_threshold(t):
    return evaluation.best_threshold(evaluation.threshold_grid(_scored(t), F.col("p"), F.col("quality")))


@query("""WITH m AS (SELECT round(avg((quality = (n_chars > 1000)::INT AND toxic = (n_chars > 4000)::INT)::INT), 6) AS exact_match, round(avg(((quality <> (n_chars > 1000)::INT)::INT + (toxic <> (n_chars > 4000)::INT)::INT) / 2), 6) AS hamming FROM documents JOIN labels USING (doc_id)) SELECT * FROM m""")
def a17_multilabel(t):
    j = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id")
    a, b = F.col("quality") == (F.col("n_chars") > 1000).cast("int"), F.col("toxic") == (F.col("n_chars") > 4000).cast("int")
    return j.agg(F.round(F.avg((a & b).cast("int")), 6).alias("exact_match"), F.round(F.avg(((~a).cast("int") + (~b).cast("int")) / 2), 6).alias("hamming"))


@query("""WITH a(alias, target) AS (VALUES ('almond antique', 'AA'), ('blue', 'B'), ('red rose', 'RR'), ('green', 'G'), ('antique', 'A')),
p AS (SELECT p_partkey, p_name, lower(p_name) AS n FROM part), m AS (SELECT p_partkey, target, CASE WHEN n = alias THEN 1 ELSE 2 END AS tier, length(alias) AS l FROM p, a WHERE len(list_filter(string_split(alias, ' '), lambda w: NOT list_contains(string_split(n, ' '), w))) = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, l DESC, target) AS rn FROM m) SELECT p.p_partkey, target, tier FROM p LEFT JOIN b ON b.p_partkey = p.p_partkey AND rn = 1""")
def j10_tiered_lookup(t):
    p = t("part").select("p_partkey", "p_name")
    a = p.sparkSession.createDataFrame([("almond antique", "AA"), ("blue", "B"), ("red rose", "RR"), ("green", "G"), ("antique", "A")], "alias string, target string")
    return matching.tiered_lookup(p, F.broadcast(a), "p_name", "alias", "target").select("p_partkey", "target", "tier")


@query("""WITH a AS (SELECT s_suppkey, list_distinct(list_filter(string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))) AS x FROM supplier) SELECT s_suppkey, array_to_string(x, ' ') AS words FROM a""")
def f6_name_tokens(t):
    return t("supplier").select("s_suppkey", F.array_join(X.tokens(F.col("s_name")), " ").alias("words"))


@query("""WITH w AS (SELECT DISTINCT p_name FROM part), x AS (SELECT a.p_name AS a, b.p_name AS b, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y FROM w a JOIN w b ON len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0)
SELECT a, b, len(list_intersect(list_distinct(x), list_distinct(y)))::INT AS shared, round(len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(x || y)), 6) AS similarity FROM x""")
def j11_token_candidates(t):
    n = t("part").select(F.col("p_name")).distinct()
    return matching.token_candidates(n.select(F.col("p_name").alias("a"), F.col("p_name").alias("ta")), n.select(F.col("p_name").alias("b"), F.col("p_name").alias("tb")), "ta", "tb", "a", "b")


@query()
def f7_sequence_ratio(t):
    """Ratcliff-Obershelp isn't an SQL function; names of the same brand, neighbours by key."""
    from pyspark.sql import Window

    p = t("part").withColumn("other", F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return p.select("p_partkey", F.round(matching.sequence_ratio(F.col("p_name"), F.col("other")), 6).alias("ratio"))


@query("SELECT conv_id, count(*) AS turns, list(role ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def j15_attached_turns(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.transform(turns, lambda x: x["role"]).alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS total_products, count(DISTINCT l_partkey) AS products_with_ingredient, count(*) AS total_ingredients, count(DISTINCT l_suppkey) AS unique_ingredients, round(count(DISTINCT l_partkey) / (SELECT count(DISTINCT p_partkey) FROM part), 4) AS coverage_rate FROM lineitem WHERE l_discount > 0.09""")
def a22_text_report(t):
    """Parts as products, their suppliers as ingredients where a line's discount is high."""
    parsed = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_discount") > 0.09, F.col("l_suppkey")).alias("ingredient"))
    return evaluation.parser_report(t("part"), parsed, "p_partkey", "ingredient")
