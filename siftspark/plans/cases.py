"""Queries of ordered folds, name resolution and labels by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.operators import aliases, label_rules, labs, matching, recommend
from siftspark.plans.core import query
from siftspark.plans.domain import _DETECTED, _detected, _values
from siftspark.sources import versions
from siftspark.streaming import ingest

#: Biomarkers with their definitions: code, safety condition, supplement.
BIOMARKERS = [("ferritin", None, "iron"), ("iron", None, "iron"), ("hemoglobin", None, None), ("hematocrit", None, None), ("calcium", None, "calcium"), ("tsh", "thyroid", None), ("vitamin_d", None, "vitamin_d")]
_CODES = [b[0] for b in BIOMARKERS] + ["other"]

_ITEMS = f"""i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, {_CODES}[l_suppkey % 8 + 1] AS code,
  CASE WHEN l_quantity < 6 THEN 'critical_low' WHEN l_quantity < 16 THEN 'low' WHEN l_quantity < 20 THEN 'borderline' WHEN l_quantity > 46 THEN 'high' ELSE 'normal' END AS status, l_quantity < 6 AND l_partkey % 3 = 0 AS critical,
  CASE WHEN l_tax > 0.06 THEN 0.5 WHEN l_tax > 0.05 THEN 0 WHEN l_tax > 0.01 THEN 0.9 END AS confidence, l_discount > 0.09 AS inferred, l_discount < 0.02 AND l_linestatus = 'F' AS assumed FROM lineitem),
d(code, safety, supplement) AS (VALUES {_values(BIOMARKERS)}),
j AS (SELECT i.*, d.code IS NOT NULL AS known, coalesce(safety IS NOT NULL AND status <> 'normal', false) AS grave, supplement FROM i LEFT JOIN d USING (code))"""


def _reports(t):
    """Orders as reports, their lines as biomarkers in order."""
    li = t("lineitem")
    q, by = F.col("l_quantity"), F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_suppkey") % 8 + 1).cast("int"))
    status = F.when(q < 6, "critical_low").when(q < 16, "low").when(q < 20, "borderline").when(q > 46, "high").otherwise("normal")
    tax = F.col("l_tax")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", by.alias("code"), status.alias("status"), F.when((q < 6) & (F.col("l_partkey") % 3 == 0), "critical").otherwise("none").alias("severity"),
        F.when(tax > 0.06, 0.5).when(tax > 0.05, 0.0).when(tax > 0.01, 0.9).alias("confidence"), F.lit("mg").alias("unit"), F.when(F.col("l_linestatus") == "F", "g").alias("original_unit"), (F.col("l_discount") > 0.09).alias("unit_inferred"), (F.col("l_discount") < 0.02).alias("unit_assumed"))
    definitions = li.sparkSession.createDataFrame(BIOMARKERS, "code string, safety_condition string, supplement string")
    j = rows.join(definitions.withColumn("known", F.lit(True)), "code", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    fields = [x.split(":")[0] for x in labs.ITEM.removeprefix("struct<").removesuffix(">").split(",")]
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("item")))), lambda x: x["item"])
    return j.groupBy("l_orderkey").agg(items.alias("items"))


@query(f"""WITH RECURSIVE {_ITEMS},
f AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS n, 0 AS level, false AS blocked, []::VARCHAR[] AS warnings, []::VARCHAR[] AS signals FROM i UNION ALL
  SELECT l_orderkey, n, CASE WHEN NOT known THEN level ELSE greatest(level, CASE WHEN b THEN 2 WHEN doubtful OR inferred OR assumed OR status IN ('low', 'high') THEN 1 ELSE 0 END) END, blocked OR (known AND b),
    CASE WHEN NOT known THEN warnings ELSE warnings || list_filter([CASE WHEN doubtful THEN code || ':doubtful' END, CASE WHEN inferred THEN code || ':unit_inferred' END, CASE WHEN assumed AND NOT inferred THEN code || ':unit_assumed' END, CASE WHEN critical THEN code || ':critical' END, CASE WHEN grave THEN code || ':safety_condition' END], lambda w: w IS NOT NULL) END,
    CASE WHEN known AND supplement IS NOT NULL AND status IN ('low', 'critical_low', 'borderline') THEN signals || [code || '/' || status || CASE WHEN code IN ('ferritin', 'calcium') OR blocked OR b OR status = 'critical_low' THEN '!' ELSE '' END] ELSE signals END
  FROM (SELECT f.*, j.* EXCLUDE (l_orderkey, n), j.n AS m, coalesce(confidence <> 0 AND confidence < 0.65, false) AS doubtful, critical OR grave AS b FROM f JOIN j ON j.l_orderkey = f.l_orderkey AND j.n = f.n + 1) AS z(l_orderkey, before, level, blocked, warnings, signals, code, status, critical, confidence, inferred, assumed, known, grave, supplement, n, doubtful, b)),
e AS (SELECT * FROM f WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC) = 1),
l AS (SELECT l_orderkey, code, arg_max(status, n) IN ('low', 'critical_low') AS low FROM i GROUP BY ALL),
a AS (SELECT l_orderkey, bool_or(low AND code IN ('ferritin', 'iron')) AND bool_or(low AND code IN ('hemoglobin', 'hematocrit')) AS anemia FROM l GROUP BY 1)
SELECT l_orderkey, ['normal', 'caution', 'medical_review_required'][CASE WHEN anemia THEN 2 ELSE level END + 1] AS level, blocked OR anemia AS blocked,
  array_to_string(list_sort(list_distinct(warnings || CASE WHEN anemia THEN ['anemia_pattern'] ELSE [] END)), ' ') AS warnings, array_to_string(signals, ' ') AS signals, CASE WHEN blocked OR anemia THEN 2 WHEN level = 1 THEN 1 ELSE 0 END AS n_actions FROM e JOIN a USING (l_orderkey)""")
def d25_severity_state(t):
    """Level, block, warnings and signals of a report, by a fold over its biomarkers."""
    out = labs.analysed(_reports(t))
    signals = F.transform("signals", lambda s: F.concat(s["code"], F.lit("/"), s["status"], F.when(s["needs_review"], "!").otherwise("")))
    return out.select("l_orderkey", "level", "blocked", F.array_join(F.array_sort("warnings"), " ").alias("warnings"), F.array_join(signals, " ").alias("signals"), F.size("actions").alias("n_actions"))


#: Seeds of conditions, in order; one of them isn't resolvable.
SEEDS = [("TRUCK", "c1", 0), ("TRUCK", "c2", 1), ("MAIL", "c1", 0), ("MAIL", "c3", 1), ("SHIP", None, 0), ("SHIP", "c3", 1), ("SHIP", "c4", 2), ("RAIL", "c3", 0), ("RAIL", "c1", 1), ("AIR", "c4", 0), ("AIR", "c3", 1)]
_PLACES = ["TRUCK", "MAIL", "SHIP", "RAIL", "AIR"]


@query(f"""WITH RECURSIVE {_DETECTED}, s(condition, component, place) AS (VALUES {_values(SEEDS)}),
c AS (SELECT l_orderkey, condition, w, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, list_position({_PLACES}, condition)) AS n FROM (SELECT *, CASE WHEN probability > 0 THEN probability ELSE 0.60 END::DOUBLE AS w FROM d WHERE NOT (condition = 'RAIL' AND l_orderkey % 5 = 0))),
f AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS n, CASE WHEN l_orderkey % 4 = 0 THEN ['c1'] ELSE [] END::VARCHAR[] AS taken, NULL::VARCHAR AS condition, NULL::VARCHAR AS component, NULL::DOUBLE AS w FROM c UNION ALL
  SELECT f.l_orderkey, c.n, CASE WHEN x IS NULL THEN taken ELSE taken || [x] END, c.condition, x, c.w
  FROM f JOIN (SELECT c.*, (SELECT list(component ORDER BY place) FROM s WHERE s.condition = c.condition AND component IS NOT NULL) AS own FROM c) AS c ON c.l_orderkey = f.l_orderkey AND c.n = f.n + 1, LATERAL (SELECT list_filter(own, lambda o: NOT list_contains(taken, o))[1] AS x) AS z)
SELECT l_orderkey, condition, component, round(w * 0.58::DOUBLE, 4) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS place FROM f WHERE component IS NOT NULL""")
def d15_seed_fallback(t):
    """Conditions that nothing covers take seeds in the order of their weights; a seed is taken once."""
    d = _detected(t)
    place = F.array_position(F.array(*map(F.lit, _PLACES)), F.col("condition"))
    conditions = d.withColumn("place", place).withColumn("covered", (F.col("condition") == "RAIL") & (F.col("l_orderkey") % 5 == 0))
    seeds = d.sparkSession.createDataFrame(SEEDS, "condition string, component string, place int")
    chosen = t("orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("c1").alias("component"))
    return recommend.seed_fallback(conditions, "l_orderkey", seeds, chosen)


PATTERNS = [(r"\bBY\b", "p_by"), (r"\b(TION|MENT)\b", "p_ending"), (r"\bTHAT THE\b", "p_that")]
SALTS = ("THE", "DE", "LA", "DER", "DIE")
_KEY = f"trim(regexp_replace(regexp_replace(translate(upper(coalesce({{}}, '')), '{aliases._ACCENTED}', '{aliases._PLAIN}'), '\\([^)]*\\)', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g'))"
_TITLE = "replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), 'ß', 'ss')"
_METHODS = "['manual_alias', 'knowledge_alias', 'exact_translated', 'exact_master']"


def _core_sql(key: str) -> str:
    return f"array_to_string(list_filter(string_split({key}, ' '), lambda w: w NOT IN {SALTS} AND NOT regexp_full_match(w, '[0-9]+')), ' ')"


@query(f"""WITH n AS (SELECT page_id, {_TITLE} AS name, url, {_KEY.format(_TITLE)} AS k FROM pages), w AS (SELECT *, string_split(k, ' ') AS w FROM n),
r AS (SELECT page_id AS place, 'c' || page_id AS target, CASE WHEN page_id % 4 = 1 THEN {_KEY.format("url")} ELSE k END AS canonical, {_METHODS}[page_id % 4 + 1] AS method, page_id % 4 + 1 AS rank,
  array_to_string(CASE page_id % 4 WHEN 0 THEN w[1:2] WHEN 1 THEN w[2:2] WHEN 2 THEN w[2:3] ELSE w[1:3] END, ' ') AS key FROM w),
a AS (SELECT *, rank <= 2 OR len(list_intersect(list_filter(string_split(key, ' '), lambda x: length(x) >= 3), list_filter(string_split(canonical, ' '), lambda x: length(x) >= 3))) > 0 AS usable FROM r WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, place, target) = 1),
c AS (SELECT page_id, k, unnest([k, {_core_sql("k")}, {_core_sql(_KEY.format("url"))}]) AS key, unnest([1, 2, 3]) AS at_ FROM n),
e AS (SELECT page_id, arg_min(struct_pack(t := target, m := method, s := CASE rank WHEN 1 THEN 100 WHEN 2 THEN 100 WHEN 3 THEN 98 ELSE 95 END), at_) AS b FROM c JOIN a USING (key) WHERE usable AND key <> '' GROUP BY 1),
i AS (SELECT page_id, arg_min(target, (-length(key), key)) AS t FROM n JOIN a ON contains(' ' || k || ' ', ' ' || key || ' ') WHERE length(key) >= 4 AND (usable OR rank = 3) GROUP BY 1),
p AS (SELECT page_id, CASE {" ".join(f"WHEN regexp_matches(' ' || k || ' ', '{e}') THEN '{v}'" for e, v in PATTERNS)} END AS t FROM n)
SELECT page_id, coalesce(p.t, b.t, i.t, '') AS target, CASE WHEN p.t IS NOT NULL THEN 'nutrient_pattern' WHEN b.t IS NOT NULL THEN b.m WHEN i.t IS NOT NULL THEN 'contains_alias' ELSE 'unmapped' END AS method, (CASE WHEN p.t IS NOT NULL THEN 99 WHEN b.t IS NOT NULL THEN b.s WHEN i.t IS NOT NULL THEN 90 ELSE 0 END)::DOUBLE AS score
FROM n LEFT JOIN e USING (page_id) LEFT JOIN i USING (page_id) LEFT JOIN p USING (page_id)""")
def d32_resolution_precedence(t):
    """Titles of pages resolved by patterns, aliases of four sources, and aliases inside them; addresses stand for salt forms."""
    names = t("pages").select("page_id", F.replace(X.title(F.col("html")), F.lit("ß"), F.lit("ss")).alias("name"), "url")
    w, m = F.split(aliases.name_key(F.col("name")), " "), F.col("page_id") % 4
    words = F.when(m == 0, F.slice(w, 1, 2)).when(m == 1, F.slice(w, 2, 1)).when(m == 2, F.slice(w, 2, 2)).otherwise(F.slice(w, 1, 3))
    method = F.element_at(F.array(*map(F.lit, aliases.SOURCES)), (m + 1).cast("int"))
    rows = names.select(F.array_join(words, " ").alias("alias"), F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("target"), method.alias("method"), F.col("page_id").alias("place"), F.when(m == 1, F.col("url")).otherwise(F.col("name")).alias("canonical"))
    return aliases.resolved(names, "name", aliases.alias_table(rows), PATTERNS, SALTS, "url").select("page_id", "target", "method", "score")


_PLAIN_SQL = f"trim(regexp_replace(translate(lower({{}}), '{X.ACCENTED}', '{X.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"
_ASKED = "CASE page_id % 5 WHEN 0 THEN substr(title, 3, 9) WHEN 1 THEN split_part(title, ' ', 3) || ' ' || split_part(title, ' ', 1) WHEN 2 THEN title WHEN 3 THEN left(title, 2) ELSE split_part(title, ' ', 2) END"


@query(f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages), n AS (SELECT page_id, {_PLAIN_SQL.format("title")} AS name FROM p), q AS (SELECT page_id, {_PLAIN_SQL.format(_ASKED)} AS q FROM p),
w AS (SELECT *, list_filter(string_split(q, ' '), lambda x: length(x) >= 3) AS w FROM q WHERE q <> ''),
m AS (SELECT w.page_id, n.page_id AS target, CASE WHEN name = q THEN 1 WHEN contains(name, q) THEN 2 ELSE 3 END AS tier FROM w JOIN n ON contains(name, q) OR (len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(name, x))) = 0)),
b AS (SELECT page_id, target, tier FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY tier, target) = 1)
SELECT page_id, target, tier::INT AS tier FROM q LEFT JOIN b USING (page_id)""")
def j10_find_names(t):
    """Parts of titles looked up among all titles: equal, held as a substring, or every word held."""
    p = t("pages").select("page_id", X.title(F.col("html")).alias("title"))
    part, m = lambda i: F.split_part("title", F.lit(" "), F.lit(i)), F.col("page_id") % 5
    asked = F.when(m == 0, F.substring("title", 3, 9)).when(m == 1, F.concat(part(3), F.lit(" "), part(1))).when(m == 2, F.col("title")).when(m == 3, F.substring("title", 1, 2)).otherwise(part(2))
    names = p.select("title", F.col("page_id").alias("target"), F.col("page_id").alias("place"))
    return matching.find_names(p.select("page_id", asked.alias("asked")), "asked", names, "title", "target", "place").select("page_id", "target", "tier")


_FIELDS = sorted({f for _, _, _, _, _, _, _, f, _ in label_rules.rule_rows()})
_SEEN = ["low", "critical_low", "normal", "high", "critical_high", "missing", None, "not_labelable", "normal", "normal"]


def _status(i: int) -> str:
    return f"(c_custkey * {2 * i + 3} + c_nationkey * {i + 1} + c_custkey // {i + 7}) % {len(_SEEN)}"


_SETS = ", ".join(f"('{k}', '{v}')" for k, values in label_rules.STATUSES.items() for v in values)


@query(f"""WITH v AS (SELECT c_custkey, unnest({_FIELDS}) AS field, unnest([{", ".join(_status(i) for i in range(len(_FIELDS)))}]) AS i FROM customer),
s AS (SELECT c_custkey, field, coalesce([{", ".join("NULL" if x is None else f"'{x}'" for x in _SEEN)}][i + 1], 'missing') AS status FROM v), k(test, status) AS (VALUES {_SETS}),
r(condition, place, state, source, confidence, clause, need, field, test) AS (VALUES {_values(label_rules.rule_rows())}),
o(condition, source) AS (VALUES {_values([(c.name, c.otherwise) for c in label_rules.CONDITIONS])}),
x AS (SELECT s.c_custkey, r.*, CASE WHEN r.test = 'clear' THEN s.status NOT IN ('low', 'critical_low', 'high', 'critical_high') ELSE k.status IS NOT NULL END AS ok FROM r JOIN s USING (field) LEFT JOIN k ON k.test = r.test AND k.status = s.status),
c AS (SELECT c_custkey, condition, place, state, source, confidence, clause, count(*) FILTER (WHERE ok) >= any_value(need) AS ok FROM x GROUP BY ALL),
h AS (SELECT c_custkey, condition, place, state, source, confidence FROM c GROUP BY ALL HAVING bool_and(ok)),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY c_custkey, condition ORDER BY place) = 1)
SELECT c_custkey, o.condition, coalesce(state, 'unknown') AS state, coalesce(f.source, o.source) AS label_source, coalesce(f.confidence, 0)::DOUBLE AS confidence FROM customer CROSS JOIN o LEFT JOIN f USING (c_custkey, condition)""")
def d40_label_states(t):
    """Labels of seventeen conditions, by a table of rules over statuses."""
    c = t("customer")
    at = [F.expr(_status(i).replace("//", "DIV")).cast("int") for i in range(len(_FIELDS))]
    cases = c.select("c_custkey", *[F.get(F.array(*map(F.lit, _SEEN)), a).alias(f) for a, f in zip(at, _FIELDS, strict=True)])
    return label_rules.labels(cases, "c_custkey").select("c_custkey", "condition", "state", "label_source", "confidence")


_REFUSED = """WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type AS kind, CASE WHEN event_id % 97 = 0 THEN 's' || user_id ELSE 'session-' || user_id END AS session, CASE WHEN event_id % 53 = 0 THEN 'Step' ELSE 'step_' || (event_id % 4) END AS step, (event_id % 210)::INT AS position FROM events),
c AS (SELECT user_id, n, CASE WHEN length(session) < 8 THEN 'invalid survey_session_id' WHEN step = 'Step' THEN 'invalid step_key' WHEN position > 200 THEN 'invalid position' END AS why FROM e)
SELECT user_id, count(*) AS n, CASE WHEN count(*) > 65 THEN 'too_many_events' ELSE arg_min(why, n) FILTER (WHERE why IS NOT NULL) END AS reason FROM c GROUP BY 1"""


@query(_REFUSED)
def e1_refused_requests(t):
    """A user's events as one request of survey events, of at most 65."""
    e, i = t("events"), F.col("event_id")
    session = F.concat(F.when(i % 97 == 0, "s").otherwise("session-"), F.col("user_id").cast("string"))
    step = F.when(i % 53 == 0, "Step").otherwise(F.concat(F.lit("step_"), (i % 4).cast("string")))
    event = F.struct(session.alias("survey_session_id"), step.alias("step_key"), F.lit("view").alias("event_type"), (i % 210).cast("int").alias("position"), F.lit(None).cast("int").alias("visible_steps"), F.lit(None).cast("string").alias("contract_version"))
    own = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", event.alias("e")))), lambda x: x["e"]).alias("events"))
    return own.select("user_id", F.size("events").cast("long").alias("n"), ingest.refusal(F.col("events"), ingest.survey_checks, 65).alias("reason"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey % 30 AS c, l_suppkey AS s, l_extendedprice AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
i AS (SELECT l_orderkey, n, c, (n - 1) // 3 + 1 AS pack, (n - 1) % 3 + 1 AS rank FROM l),
p AS (SELECT l_orderkey, (n - 1) // 3 + 1 AS pack, c, arg_max(s, n) AS product, arg_max(price, n) AS price FROM l GROUP BY 1, 2, 3)
SELECT 'r' || l_orderkey AS recommendation_id, 'pack_' || pack AS pack_key, rank, 'c' || c AS component_id, 's' || product AS product_id, price AS price_at_recommendation FROM i JOIN p USING (l_orderkey, pack, c)""")
def s19_pack_items(t):
    """Orders as nested responses, three lines a pack; every line offers a product for its component."""
    li = t("lineitem")
    component = F.concat(F.lit("c"), (F.col("l_partkey") % 30).cast("string"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", component.alias("component_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("product_id"), F.col("l_extendedprice").alias("price"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    pack = lambda k: F.slice("l", k * 3 - 2, 3)
    packs = F.transform(F.sequence(F.lit(1), F.ceil(F.size("l") / 3).cast("int")), lambda k: F.struct(F.lit("").alias("pack_id"), k.alias("rank"), F.lit(None).cast("double").alias("score_final"), F.transform(pack(k), lambda x: F.struct(x["component_id"].alias("component_id"), F.lit("n").alias("name"))).alias("components"), F.transform(pack(k), lambda x: F.struct(x["component_id"].alias("component_id"), x["product_id"].alias("product_id"), x["price"].alias("price"), F.lit("yes").alias("availability"))).alias("selected_products")))
    none = F.array().cast("array<struct<component_id:string,name:string,reason:string,score:double,type:string,condition:string>>")
    responses = lines.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("recommendation_id"), F.lit(1).alias("user_id"), F.array(F.lit("x")).alias("conditions"), none.alias("recommendations"), packs.alias("packs_ranked"))
    return versions.response_tables(responses)["pack_items"].select("recommendation_id", "pack_key", "rank", "component_id", "product_id", "price_at_recommendation")
