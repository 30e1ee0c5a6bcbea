"""Evaluation: confusion, calibration, ranking quality, thresholds, lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.scores import hash_split, wilson


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def confusion(df: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """keys, tp, fp, fn, tn, precision, recall, specificity, f1 and the recall's confidence interval; null where undefined."""
    n = lambda c: F.count_if(c)
    out = df.groupBy(*keys).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    low, high = wilson(tp, tp + fn)
    return out.select(*keys, "tp", "fp", "fn", "tn", F.round(ratio(tp, tp + fp), 4).alias("precision"), F.round(ratio(tp, tp + fn), 4).alias("recall"), F.round(ratio(tn, tn + fp), 4).alias("specificity"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 4).alias("f1"), F.round(low, 4).alias("recall_low"), F.round(high, 4).alias("recall_high"))


def brier(df: DataFrame, keys: list[str], p: Column, y: Column) -> DataFrame:
    y = y.cast("double")
    return df.groupBy(*keys).agg(F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(F.when(y == 1, p)), 6).alias("mean_positive"), F.round(F.avg(F.when(y == 0, p)), 6).alias("mean_negative"))


def calibration_error(df: DataFrame, keys: list[str], p: Column, y: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins."""
    own = df.groupBy(*keys, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("_bin")).agg(F.count("*").alias("_n"), F.avg(p).alias("_p"), F.avg(y.cast("double")).alias("_y"))
    return own.groupBy(*keys).agg(F.round(F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n"), 6).alias("ece"))


def _running(df: DataFrame, keys: list[str], score: Column, y: Column, parts: int = 1024) -> DataFrame:
    """keys, _s, _n, _pos of each distinct score, with the running sums _cn and _cp in rising order.

    Scores are cut into ranges of 1/parts; a window runs inside a range, and another over the ranges' sums, so no task
    orders all scores of a key.
    """
    by = df.groupBy(*keys, score.alias("_s")).agg(F.count("*").alias("_n"), F.sum(y.cast("long")).alias("_pos")).withColumn("_part", F.floor(F.col("_s") * parts))
    sums = by.groupBy(*keys, "_part").agg(F.sum("_n").alias("_pn"), F.sum("_pos").alias("_pp"))
    over = Window.partitionBy(*keys).orderBy("_part")
    before = sums.select(*keys, "_part", (F.sum("_pn").over(over) - F.col("_pn")).alias("_bn"), (F.sum("_pp").over(over) - F.col("_pp")).alias("_bp"))
    w = Window.partitionBy(*keys, "_part").orderBy("_s")
    inside = by.withColumn("_cn", F.sum("_n").over(w)).withColumn("_cp", F.sum("_pos").over(w))
    same = F.lit(True)
    for c in [*keys, "_part"]:
        same = same & inside[c].eqNullSafe(before[c])
    return inside.join(before, same).select(*[inside[c] for c in keys], "_s", "_n", "_pos", (F.col("_cn") + F.col("_bn")).alias("_cn"), (F.col("_cp") + F.col("_bp")).alias("_cp"))


def auc(df: DataFrame, keys: list[str], score: Column, y: Column) -> DataFrame:
    """Area under the curve by rank sums with shared ranks for ties; scores are summed up first, so a window holds distinct scores only."""
    ranked = _running(df, keys, score, y).withColumn("_rank", F.col("_cn") - F.col("_n") + (F.col("_n") + 1) / 2)
    s = ranked.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("_pos")).alias("r"), F.sum("_pos").alias("p"), F.sum("_n").alias("n"))
    return s.select(*keys, F.round(F.when((F.col("p") > 0) & (F.col("n") > F.col("p")), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))), 6).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: Column, y: Column) -> DataFrame:
    run = _running(df, keys, -score, y)
    return run.groupBy(*keys).agg(F.round(F.sum(F.col("_pos") * F.col("_cp") / F.col("_cn")) / F.sum("_pos"), 6).alias("average_precision"))


def threshold_grid(df: DataFrame, p: Column, y: Column, low: int = 20, high: int = 80, step: int = 1) -> DataFrame:
    """(threshold, tp, fp, fn, f1) over a grid of hundredths: rows are counted by the highest step they reach, then summed from above."""
    reach = F.least(F.lit((high - low) // step), F.floor((F.floor(F.round(p * 100, 6)) - low) / step))
    by = df.groupBy(reach.alias("_k")).agg(F.count("*").alias("_n"), F.sum(y.cast("long")).alias("_pos"))
    total = by.agg(F.sum("_pos").alias("_all"))
    grid = df.sparkSession.range((high - low) // step + 1).select(F.col("id").alias("_g"))
    out = grid.join(by, F.col("_k") >= F.col("_g"), "left").groupBy("_g").agg(F.coalesce(F.sum("_pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("_n") - F.col("_pos")), F.lit(0)).alias("fp"))
    out = out.crossJoin(F.broadcast(total)).withColumn("fn", F.col("_all") - F.col("tp"))  # one row
    return out.select(F.round((low + F.col("_g") * step) / 100, 2).alias("threshold"), "tp", "fp", "fn", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The grid's row of the best F1, the lowest threshold among equals."""
    return grid.orderBy(F.desc_nulls_last("f1"), "threshold").limit(1)


def rule_lift(hits: DataFrame, rule: str, positive: Column, prevalence: DataFrame) -> DataFrame:
    """(rule, n, precision, lift): precision of each rule against the share of positives (one row, column prevalence)."""
    per = hits.groupBy(rule).agg(F.count("*").alias("n"), F.avg(positive.cast("double")).alias("p"))
    return per.crossJoin(F.broadcast(prevalence)).select(rule, "n", F.round("p", 4).alias("precision"), F.round(F.col("p") / F.col("prevalence"), 4).alias("lift"))


def stable_in_all(runs: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Detections that every seed has."""
    k = runs.agg(F.countDistinct(seed).alias("_k"))
    return runs.groupBy(*keys).agg(F.countDistinct(seed).alias("_n")).crossJoin(F.broadcast(k)).filter("_n = _k").drop("_n", "_k")


def multilabel(df: DataFrame, labels: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row: macro_f1, micro_f1, sample_f1, exact_match, hamming. labels: name to (actual, predicted), 0 or 1 each. One pass; an undefined F1 counts as 0."""
    y, z = ({k: v[i].cast("int") for k, v in labels.items()} for i in (0, 1))
    both, a, b = (sum((f(k) for k in labels), F.lit(0)) for f in (lambda k: y[k] * z[k], lambda k: y[k], lambda k: z[k]))
    wrong = sum((F.abs(y[k] - z[k]) for k in labels), F.lit(0))
    sums = {f"_{n}_{k}": F.sum(c) for k in labels for n, c in (("tp", y[k] * z[k]), ("y", y[k]), ("z", z[k]))}
    out = df.agg(*[c.alias(n) for n, c in sums.items()], F.avg(F.when(a + b > 0, 2 * both / (a + b)).otherwise(0.0)).alias("_s"), F.avg((wrong == 0).cast("int")).alias("_e"), F.avg(wrong / len(labels)).alias("_h"))
    f1 = lambda tp, p, q: F.coalesce(ratio(2 * tp, p + q), F.lit(0.0))
    col = lambda n: [F.col(f"_{n}_{k}") for k in labels]
    macro = sum((f1(*x) for x in zip(col("tp"), col("y"), col("z"), strict=True)), F.lit(0.0)) / len(labels)
    micro = f1(*(sum(col(n), F.lit(0)) for n in ("tp", "y", "z")))
    return out.select(F.round(macro, 6).alias("macro_f1"), F.round(micro, 6).alias("micro_f1"), F.round("_s", 6).alias("sample_f1"), F.round("_e", 6).alias("exact_match"), F.round("_h", 6).alias("hamming"))


def calibrated_thresholds(df: DataFrame, key: str, case: Column, p: Column, y: Column, original: float, floor: float, least: float, fewest: int = 10, margin: float = 0.02) -> DataFrame:
    """key, threshold, status, accepted: a new threshold for each key, chosen on one half of the cases and accepted on the other.

    Cases are split by hash. On the calibration half, of the hundredths from .01 to .99 that keep the specificity floor, the
    best by F1, recall, specificity counts (ties: the lowest); it is a candidate only if its F1 beats the original's. It is
    accepted if on the evaluation half its F1 is no worse, its specificity neither under the floor nor more than `margin`
    under the original's, and it is not under `least`. Rows are counted once by the highest hundredth they reach.
    """
    reach = F.least(F.lit(99), F.greatest(F.lit(0), F.floor(F.round(p * 100, 6)))).cast("int")
    rows = df.select(key, (hash_split(case) == "calibration").alias("_cal"), reach.alias("_k"), (y == 1).cast("int").alias("_y"))
    by = rows.groupBy(key, "_cal", "_k").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    # a hundred counts a key and half at most
    arrays = by.groupBy(key, "_cal").agg(F.collect_list(F.struct("_k", "_pos", "_neg")).alias("_all"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    grid = arrays.select(key, "_cal", "_all", "_p", "_n", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("_g"))
    above = lambda f: F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_k"] >= F.col("_g"), x[f]).otherwise(F.lit(0).cast("long")))
    m = grid.select(key, "_cal", "_g", "_p", "_n", above("_pos").alias("tp"), above("_neg").alias("fp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    m = m.select(key, "_cal", "_g", "_p", "_n", zero(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("_p"))).alias("f1"), zero(ratio(F.col("tp"), F.col("_p"))).alias("recall"), zero(ratio(F.col("_n") - F.col("fp"), F.col("_n"))).alias("spec"))
    at = round(original * 100)
    best = Window.partitionBy(key).orderBy(F.desc("f1"), F.desc("recall"), F.desc("spec"), "_g")
    chosen = m.filter(F.col("_cal") & (F.col("spec") >= floor)).withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select(key, F.col("_g").alias("_b"), F.col("f1").alias("_bf"))
    first = m.filter(F.col("_cal") & (F.col("_g") == at)).select(key, "_p", "_n", F.col("f1").alias("_of"))
    status = F.when((F.col("_p") < fewest) | (F.col("_n") < fewest), "insufficient_calibration_labels").when(F.col("_b").isNull(), "no_threshold_meets_specificity_floor").when(F.col("_bf") <= F.col("_of"), "original_threshold_not_worse").otherwise("candidate")
    taken = first.join(chosen, key, "left").withColumn("status", status).withColumn("_g", F.when(F.col("status") == "candidate", F.col("_b")).otherwise(F.lit(at)))
    ev = m.filter(~F.col("_cal"))
    new, old = ev.select(key, "_g", F.col("f1").alias("_nf"), F.col("spec").alias("_ns")), ev.filter(F.col("_g") == at).select(key, F.col("f1").alias("_ef"), F.col("spec").alias("_es"))
    out = taken.join(new, [key, "_g"]).join(old, key)
    fine = (F.col("status") == "candidate") & (F.col("_nf") >= F.col("_ef")) & (F.col("_ns") >= F.greatest(F.lit(floor), F.col("_es") - margin)) & (F.col("_g") >= least * 100)
    return out.select(key, "status", F.round(F.col("_g") / 100, 2).alias("threshold"), fine.alias("accepted"))


ABNORMAL = ("low", "critical_low", "high", "critical_high")


def statuses(items: DataFrame, key: str, code: str, status: str, order: list[str]) -> DataFrame:
    """(key, code, status): the first status of a code, or the first one out of range if there is any."""
    known = items.filter(f"{code} != '' AND {status} != ''")
    at, out = F.struct(*order), F.col(status).isin(*ABNORMAL)
    first = F.coalesce(F.min_by(F.when(out, F.col(status)), F.when(out, at)), F.min_by(status, at))
    return known.groupBy(key, code).agg(first.alias("status"))


def lab_truth(found: DataFrame, key: str, code: str, targets: DataFrame) -> DataFrame:
    """(key, condition, truth) of the conditions of which a biomarker was measured; true if one is out of range in the condition's direction. targets: condition, code, directions (array)."""
    return found.join(targets.withColumnRenamed("code", code), code).groupBy(key, "condition").agg(F.bool_or(F.array_contains("directions", F.col("status"))).alias("truth"))


def paired(truth: DataFrame, predicted: DataFrame, key: str, least: int = 10) -> DataFrame:
    """(condition, predictor, tp, fp, fn, tn, precision, recall, enough) over the pairs of truth; predicted: key, predictor, condition. A metric of fewer marked or positive cases than `least` isn't enough."""
    asked = truth.crossJoin(F.broadcast(predicted.select("predictor").distinct()))  # a few names of predictors
    both = asked.join(predicted.select(key, "predictor", "condition").distinct().withColumn("_p", F.lit(True)), [key, "predictor", "condition"], "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    n = both.groupBy("condition", "predictor").agg(*[F.count_if((F.col("_p") == p) & (F.col("truth") == y)).alias(name) for name, p, y in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    share = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 4))
    return n.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn"))).withColumn("enough", (F.col("tp") + F.col("fp") >= least) & (F.col("tp") + F.col("fn") >= least))


def ablation(base: DataFrame, without: DataFrame, question: str, case: str, condition: str, questions: DataFrame, n_cases: int) -> DataFrame:
    """(question, cases_changed, share_changed, lost, gained): what cases detect less and more without a question. base: case, condition; without: question, case, condition; questions: question, a small table."""
    before = base.select(case, condition).distinct().crossJoin(F.broadcast(questions.select(question))).withColumn("_b", F.lit(1))  # as many rows as there are questions
    after = without.select(question, case, condition).distinct().withColumn("_a", F.lit(1))
    both = before.join(after, [question, case, condition], "full_outer")
    per = both.groupBy(question, case).agg(F.count_if(F.col("_a").isNull()).alias("_lost"), F.count_if(F.col("_b").isNull()).alias("_gained"))
    n = per.groupBy(question).agg(F.count_if((F.col("_lost") > 0) | (F.col("_gained") > 0)).alias("cases_changed"), F.sum("_lost").alias("lost"), F.sum("_gained").alias("gained"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return questions.select(question).join(n, question, "left").select(question, zero("cases_changed").alias("cases_changed"), F.round(zero("cases_changed") / n_cases, 3).alias("share_changed"), zero("lost").alias("lost"), zero("gained").alias("gained"))


def parser_report(original: DataFrame, parsed: DataFrame, key: str, value: str) -> DataFrame:
    """One row: products, those with at least one ingredient, their share, and all and distinct ingredients. A null ingredient is none."""
    total = original.agg(F.countDistinct(key).alias("total_products"))
    found = parsed.filter(F.col(value).isNotNull()).agg(F.countDistinct(key).alias("products_with_ingredient"), F.count("*").alias("total_ingredients"), F.countDistinct(value).alias("unique_ingredients"))
    share = F.when(F.col("total_products") > 0, F.round(F.col("products_with_ingredient") / F.col("total_products"), 4)).otherwise(0.0)
    return total.crossJoin(found).withColumn("coverage_rate", share)  # a row each
