"""Components of products and nodes: detection in names, registry states, equivalences, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import plain_text, registry_key, tokens
from siftspark.operators import ranking


def detected_components(products: DataFrame, key: str, name: Column, aliases: DataFrame) -> DataFrame:
    """key, component, display: components of which an alias stands in a product's name as a phrase, or with all its words.

    aliases: alias, component, display; a small dimension. Aliases are found by each of their words, so a product meets
    only those it shares a word with.
    """
    al = aliases.select(plain_text(F.col("alias")).alias("_alias"), "component", "display").withColumn("_words", tokens(F.col("_alias"))).filter(F.size("_words") > 0)
    hay = products.select(key, plain_text(name).alias("_hay")).withColumn("_tokens", tokens(F.col("_hay")))
    pairs = hay.withColumn("_w", F.explode("_tokens")).join(al.withColumn("_w", F.explode("_words")), "_w")
    phrase = F.contains(F.concat(F.lit(" "), "_hay", F.lit(" ")), F.concat(F.lit(" "), "_alias", F.lit(" ")))
    found = pairs.filter(phrase | (F.size(F.array_except("_words", "_tokens")) == 0))
    return found.groupBy(key, "component").agg(F.min("display").alias("display"))


def registry_states(products: DataFrame, key: str, registry: str, inferred: str, known: DataFrame, mapped: DataFrame, detected: DataFrame) -> DataFrame:
    """key, registry, source, traceable, rejection: what a product's registry number and components say of it.

    known: column registry, the registry numbers there are; mapped: column registry, those with components; detected: key,
    component. A number that isn't known is refused, and the inferred one, if any, takes its place.
    """
    own = products.select(key, registry_key(F.col(registry)).alias("_own"), registry_key(F.col(inferred)).alias("_inferred"))
    there = known.select(registry_key(F.col("registry")).alias("_own"), F.lit(True).alias("_known")).distinct()
    rows = own.join(there, "_own", "left")
    refused = (F.col("_own") != "") & F.col("_known").isNull()
    taken = F.when(~refused & (F.col("_own") != ""), F.col("_own")).otherwise(F.col("_inferred"))
    rows = rows.withColumn("registry", taken).withColumn("_refused", F.when(refused, F.concat(F.lit("rs_no_en_digemid:"), "_own")))
    rows = rows.join(mapped.select(registry_key(F.col("registry")).alias("registry"), F.lit(True).alias("_mapped")).distinct(), "registry", "left")
    rows = rows.join(detected.select(key, F.lit(True).alias("_found")).distinct(), key, "left")
    has, found = F.col("registry") != "", F.col("_found").isNotNull()
    state = (
        F.when(has & F.col("_mapped").isNotNull(), "true_rs_component").when(found & has, "true_component_name_with_rs_unmapped").when(found, "true_component_name_no_rs").when(has, "false_no_component_match").otherwise("false_no_registro_sanitario")
    )
    reason = F.when(state == "false_no_component_match", F.coalesce("_refused", F.lit("rs_sin_component_map"))).when(state == "false_no_registro_sanitario", F.coalesce("_refused", F.lit("sin_rs_y_sin_component_match"))).otherwise(F.col("_refused"))
    source = F.when(has & (refused | (F.col("_own") == "")), "digemid_name_match").when(has, "source")
    return rows.select(key, "registry", source.alias("source"), state.alias("traceable"), reason.alias("rejection"))


#: What may follow an alias in a node's name: a source page, or a salt.
SOURCE_SUFFIXES = ("ods", "medlineplus supplements", "clinicaltrials gov", "quickfacts ods", "health professional fact sheet ods")
SALT_FORMS = (
    "oxide", "chloride", "citrate", "sulfate", "sulphate", "hydroxide", "carbonate", "glycinate", "bisglycinate", "gluconate", "phosphate", "lactate", "malate", "picolinate", "orotate", "taurate", "threonate", "aspartate",
    "bicarbonate", "acetate", "fumarate", "succinate", "chelate", "amino acid chelate",
)


def node_equivalences(nodes: DataFrame, aliases: DataFrame, least: int = 4) -> DataFrame:
    """node, component, rule, alias: nodes that are a known component by another name; the longest alias decides.

    nodes: node, name; aliases: alias, component; both of a catalog's size. rule: exact; or the alias stands first and what
    follows is a source page, a bracket, or a salt form. Names of several components match nothing but exactly, and so
    does an alias of several components. An alias is found by a name's first words, as many as it has.
    """
    al = aliases.select(plain_text(F.col("alias")).alias("_alias"), "component").filter(F.length("_alias") >= least).distinct()
    single = al.groupBy("_alias").agg(F.min("component").alias("component"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    n = nodes.filter("name IS NOT NULL").select("node", "name", plain_text(F.col("name")).alias("_name")).join(aliases.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    words = F.split("_name", " ")
    heads = n.withColumn("_alias", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, 1, i), " "))))
    rest = F.trim(F.substring("_name", F.length("_alias") + 1, F.length("_name")))
    several = F.lower("name").rlike(r"in combination| and |,")
    bracket = F.lower("name").rlike(r"^[^()]*\(.*\)\s*$") & (plain_text(F.regexp_extract("name", r"^([^()]*)\(", 1)) == F.col("_alias"))
    rule = F.when(F.col("_name") == F.col("_alias"), "exact").when(several, None).when(rest.isin(*SOURCE_SUFFIXES) | rest.endswith(" ods"), "source_page").when(bracket, "qualified").when(rest.isin(*SALT_FORMS), "salt_form")
    hits = heads.join(single, "_alias").withColumn("rule", rule).filter("rule IS NOT NULL")
    return ranking.best_per_key(hits, ["node"], [F.desc(F.length("_alias")), F.col("_alias")], 1, "_rn").select("node", "component", "rule", F.col("_alias").alias("alias"))


def rotation_candidates(products: DataFrame, key: str, component: str, text: Column, wanted: DataFrame) -> DataFrame:
    """key, component, by: products that have a wanted component by its id, else by its name in their text.

    wanted: component, name; a small dimension. Two joins by equality and a union take the place of one join on either.
    """
    own = products.select(key, F.col(component).alias("component"), F.concat(F.lit(" "), plain_text(text), F.lit(" ")).alias("_text"))
    by_id = own.join(wanted.select("component").distinct(), "component").select(key, "component", F.lit("id").alias("by"))
    names = wanted.select("component", plain_text(F.col("name")).alias("_n")).filter("_n != ''").withColumn("_w", F.split("_n", " ")[0])
    words = own.select(key, "_text", F.explode(F.array_distinct(F.split(F.trim("_text"), " "))).alias("_w"))
    by_text = words.join(names, "_w").filter(F.contains("_text", F.concat(F.lit(" "), "_n", F.lit(" ")))).select(key, "component", F.lit("text").alias("by"))
    return by_id.unionByName(by_text).groupBy(key, "component").agg(F.min("by").alias("by"))
