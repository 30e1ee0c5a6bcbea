"""Ranking: best per key, tiers, diversity, packs, greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions import scores as S


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def rerank_in_tiers(df: DataFrame, keys: list[str], tier: str, position: str, score: Column, out: str = "new_position") -> DataFrame:
    """Rows change places inside their tier only: the tier's places stay, its rows take them by falling score."""
    by = [*keys, tier]
    slots = df.select(*by, position).withColumn("_slot", F.row_number().over(Window.partitionBy(*by).orderBy(position))).withColumnRenamed(position, out)
    ranked = df.withColumn("_slot", F.row_number().over(Window.partitionBy(*by).orderBy(score.desc_nulls_last(), F.col(position))))
    return ranked.join(slots, [*by, "_slot"]).drop("_slot")


def diverse_first(df: DataFrame, keys: list[str], spread: str, order: list[Column], out: str = "place") -> DataFrame:
    """The best row of each value of `spread` comes first, then the rest."""
    rn = F.row_number().over(Window.partitionBy(*keys, spread).orderBy(*order))
    return df.withColumn("_rn", rn).withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_rn") > 1, *order))).drop("_rn")


def packs(items: DataFrame, key: str, item: str, order: list[Column], most: int = 6, size: int = 3, first: int = 10) -> DataFrame:
    """(key, pack_no, items): combinations of `size` out of a key's first `most` items, the first ones in lexicographic place order; one pack if there are no more than size."""
    top = best_per_key(items, [key], order, most, "_p").select(key, F.col(item).alias("_i"), "_p")
    few = top.groupBy(key).agg(F.count("*").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_p", "_i"))), lambda x: x["_i"]).alias("_all"))
    one = few.filter(F.col("_n") <= size).select(key, F.lit(1).alias("pack_no"), F.col("_all").alias("items"))
    index = [(i, j, k) for i in range(most) for j in range(i + 1, most) for k in range(j + 1, most)] if size == 3 else []
    combos = F.array(*[F.struct(*[F.lit(v).alias(f"c{n}") for n, v in enumerate(c)]) for c in index])
    each = few.filter(F.col("_n") > size).select(key, "_n", "_all", F.explode(combos).alias("_c")).filter(F.col("_c.c2") < F.col("_n"))
    each = each.withColumn("items", F.array(*[F.get("_all", F.col(f"_c.c{n}")) for n in range(size)]))
    no = F.row_number().over(Window.partitionBy(key).orderBy("_c"))
    return each.withColumn("pack_no", no).filter(F.col("pack_no") <= first).select(key, "pack_no", "items").unionByName(one)


def greedy_selection(candidates: DataFrame, pack: str, slot: str, product: str, shop: str, score: str, shop_weight: float = 0.06, per_slot: int = 1, blocked: str | None = None) -> DataFrame:
    """Products for the slots of a pack, slots in order, at most per_slot each: the best of score + shop_weight * max(.35, 1 - .20 * times the shop was used).

    A product is chosen once in a pack, a blocked one never. The shops' terms are those when a slot begins; ties go to the
    smaller product, then shop. The choice of a slot depends on those before it, within one pack only; packs are dealt over
    the cluster, and a pack has as many candidates as its components have offers: cut those to the best ones first, by
    `best_per_key`. score is a product's score without its shop's term.
    """
    own = candidates if blocked is None else candidates.filter(~F.coalesce(F.col(blocked), F.lit(False)))
    schema = candidates.select(pack, slot, product, shop, score).schema
    fields = [slot, product, shop, score]

    def choose(batches):
        import pyarrow as pa

        for batch in batches:
            offers, at = batch.column("_c"), []
            ends = offers.offsets.to_pylist()
            first = ends[0] if ends else 0
            of_slot, of_product, of_shop, of_score = ([v for v in offers.flatten().field(i).to_pylist()] for i in range(4))
            packs_of = []
            for n in range(batch.num_rows):
                slots: dict = {}
                for i in range(ends[n] - first, ends[n + 1] - first):
                    slots.setdefault(of_slot[i], []).append(i)
                used, shops = set(), {}
                for _, own_offers in sorted(slots.items()):
                    term = {s: shop_weight * max(0.35, 1 - 0.20 * k) for s, k in shops.items()}
                    ranked = sorted(own_offers, key=lambda i: (-(of_score[i] + term.get(of_shop[i], shop_weight)), of_product[i], of_shop[i]))  # noqa: B023
                    picked = 0
                    for i in ranked:
                        if picked < per_slot and of_product[i] not in used:
                            used.add(of_product[i])
                            shops[of_shop[i]] = shops.get(of_shop[i], 0) + 1
                            at.append(i)
                            packs_of.append(n)
                            picked += 1
            chosen = offers.flatten().take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(packs_of, pa.int64())), *(chosen.field(i) for i in range(4))], [pack, *fields])

    return own.groupBy(pack).agg(F.collect_list(F.struct(*fields)).alias("_c")).mapInArrow(choose, schema)


def selection_of_packs(packs_of: DataFrame, pack: str, components: str, offers: DataFrame, component: str, product: str, shop: str, score: str, **how) -> DataFrame:
    """(pack, slot, product, shop): `greedy_selection` for packs whose slots have the array `components`, one each, slots counted from 1.

    What is chosen depends on the components and their offers alone, so packs with equal arrays share one selection, and
    each pack is dealt out once. offers: component, product, shop, score, and the column that how["blocked"] names.
    """
    kinds = packs_of.groupBy(components).agg(F.min(pack).alias("_kind"))
    slots = kinds.select("_kind", F.posexplode(components).alias("_at", component)).withColumn("_slot", (F.col("_at") + 1).cast("long"))
    chosen = greedy_selection(slots.join(offers, component), "_kind", "_slot", product, shop, score, **how)
    lists = chosen.groupBy("_kind").agg(F.collect_list(F.struct(F.col("_slot").alias("slot"), product, shop)).alias("_chosen"))
    of = kinds.join(lists, "_kind").select(components, "_chosen")
    return packs_of.join(of, components).select(pack, F.explode("_chosen").alias("_o")).select(pack, "_o.*")


#: Weights of a pack's own score, of what it covers and of its feedback.
PACK_WEIGHTS = (0.45, 0.25, 0.30)


def reranked(packs_of: DataFrame, key: str, items: str, useful: DataFrame, stats: DataFrame, unscored: float = 0.7, no_condition: str = "soporte_funcional", healthy: str = "SALUDABLE") -> DataFrame:
    """(key, pack_id, rank, score_final, score_gnn, score_coverage, score_feedback, feedback_count) of candidate packs.

    packs_of: key, pack_no and an array of struct component, score, condition. useful: key, conditions. stats: pack_id, n,
    avg_score, of feedback; its total is a row. A missing or zero score counts `unscored`. Without useful conditions a
    pack covers all. Ties go to the pack that came first.
    """
    score = F.aggregate(F.transform(items, lambda x: F.coalesce(F.nullif(x["score"], F.lit(0.0)), F.lit(unscored))), F.lit(0.0), lambda a, x: a + x) / F.size(items)
    covered = F.array_distinct(F.filter(F.transform(items, lambda x: x["condition"]), lambda c: c.isNotNull() & (c != no_condition)))
    own = packs_of.withColumn("pack_id", S.pack_key(F.transform(items, lambda x: x["component"].cast("string")))).join(useful, key, "left")
    wanted = F.filter(F.coalesce("conditions", F.array().cast("array<string>")), lambda c: c != healthy)
    total = stats.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("_total"))
    both = own.join(stats, "pack_id", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0))
    parts = both.select(key, "pack_no", "pack_id", score.alias("score_gnn"), F.when(F.size(wanted) > 0, F.size(F.array_intersect(covered, wanted)) / F.size(F.array_distinct(wanted))).otherwise(1.0).alias("score_coverage"), F.when(n > 0, S.bayesian_mean(n, F.col("avg_score"))).otherwise(0.70).alias("score_feedback"), n.alias("feedback_count"), S.exploration(n, F.col("_total")).alias("_bonus"))
    a, b, c = PACK_WEIGHTS
    final = parts.withColumn("score_final", a * F.col("score_gnn") + b * F.col("score_coverage") + c * F.col("score_feedback") + F.col("_bonus"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("score_final", 9).desc(), "pack_no"))
    return final.select(key, "pack_id", rank.alias("rank"), "score_final", "score_gnn", "score_coverage", "score_feedback", "feedback_count")


def pack_stats(events: DataFrame, pack: str, components: str, score: Column, at: str) -> DataFrame:
    """(pack_id, n, avg_score, avg_rating, last_feedback_at) of feedback events; an event without a pack's key gets that of its components, without those it doesn't count, nor does one without a score. The key is derived before anything is counted, so no averages are merged."""
    ids = F.filter(F.coalesce(components, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    key = F.coalesce(F.col(pack), F.when(F.size(ids) > 0, S.pack_key(ids)))
    own = events.select(key.alias("pack_id"), score.alias("_s"), F.col(at).alias("_at")).filter("pack_id IS NOT NULL AND _s IS NOT NULL")
    n = own.groupBy("pack_id").agg(F.count("*").alias("n"), F.avg("_s").alias("avg_score"), F.max("_at").alias("last_feedback_at"))
    return n.withColumn("avg_rating", 1 + 4 * F.col("avg_score"))
