"""Supervised models with pyspark.ml: per-target logistic regression, imputation, recalibration, splits."""

from __future__ import annotations

import functools
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators import evaluation


def with_missing_flags(df: DataFrame, numbers: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in numbers}).withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in numbers})


def fit_target(df: DataFrame, numbers: list[str], label: str, reg: float = 0.01) -> PipelineModel:
    """Balanced logistic regression on medians, missing flags and scaled numbers."""
    own = with_missing_flags(df, numbers).filter(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    share = own.agg(F.avg("_y").alias("p")).first().p or 0.5
    own = own.withColumn("_w", F.when(F.col("_y") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
    filled = [f"{c}_filled" for c in numbers]
    stages = [Imputer(inputCols=numbers, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled + [f"{c}_missing" for c in numbers], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=reg, maxIter=50, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c")]
    return Pipeline(stages=stages).fit(own)


def predict(model: PipelineModel, df: DataFrame, numbers: list[str], out: str = "probability") -> DataFrame:
    scored = model.transform(with_missing_flags(df, numbers))
    return scored.withColumn(out, F.get(vector_to_array("_p"), F.lit(1))).select(*df.columns, out)


def one_vs_rest(df: DataFrame, numbers: list[str], labels: list[str], out: str = "p_{}") -> DataFrame:
    """A probability for each of several labels; one model a label, fitted apart."""
    for label in labels:
        df = predict(fit_target(df, numbers, label), df, [*numbers], out.format(label))
    return df


def odds_ratios(df: DataFrame, indicators: list[str], label: str, reg: float = 0.0) -> dict[str, float]:
    """exp of each 0/1 indicator's coefficient in a logistic regression on all of them."""
    own = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in indicators], F.col(label).cast("double").alias("_y")).filter("_y IS NOT NULL")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg, maxIter=100, standardization=False).fit(VectorAssembler(inputCols=indicators, outputCol="_x").transform(own))
    return {c: math.exp(w) for c, w in zip(indicators, model.coefficients.toArray(), strict=True)}


def cross_validated(df: DataFrame, key: str, numbers: list[str], label: str, folds: int = 3, out: str = "probability") -> DataFrame:
    """df with the probability of each row from a model that hasn't seen it: rows are dealt to folds by a hash of their key."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(folds))
    parts = [predict(fit_target(df.filter(fold != k), numbers, label), df.filter(fold == k), numbers, out) for k in range(folds)]
    return functools.reduce(DataFrame.unionByName, parts)


def platt(df: DataFrame, key: str, numbers: list[str], label: str, folds: int = 3, out: str = "probability") -> DataFrame:
    """df with a sigmoid-calibrated probability: a one-dimensional logistic regression on the log odds of cross-validated scores."""
    scored = cross_validated(df, key, numbers, label, folds, "_raw_p")
    p = F.least(F.greatest(F.col("_raw_p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    own = VectorAssembler(inputCols=["_odds"], outputCol="_z").transform(scored.withColumn("_odds", F.log(p / (1 - p))).withColumn("_l", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="_z", labelCol="_l", maxIter=100, probabilityCol="_q", rawPredictionCol="_qr", predictionCol="_qc").fit(own.filter("_l IS NOT NULL"))
    return model.transform(own).withColumn(out, F.get(vector_to_array("_q"), F.lit(1))).select(*df.columns, out)


def external_validation(model: PipelineModel, df: DataFrame, numbers: list[str], label: str, threshold: float = 0.5) -> DataFrame:
    """One row: counts, precision, recall, specificity, Brier score and AUC of a fitted model on other data."""
    scored = predict(model, df.filter(F.col(label).isNotNull()), numbers, "_p").withColumn("_all", F.lit("all"))
    y = F.col(label).cast("int")
    parts = [evaluation.confusion(scored, ["_all"], F.col("_p") >= threshold, y == 1), evaluation.brier(scored, ["_all"], F.col("_p"), y).select("_all", "brier"), evaluation.auc(scored, ["_all"], F.col("_p"), y)]
    return functools.reduce(lambda a, b: a.join(b, "_all"), parts).drop("_all")


def mapped_features(df: DataFrame, key: str, names: dict[str, str], factors: dict[str, float] | None = None) -> DataFrame:
    """key and a model's features from a survey's answers: names maps a feature to its answer. An answer that wasn't asked, or is no number, is NaN."""
    value = lambda a: F.coalesce(F.col(a).try_cast("double"), F.lit(float("nan"))) if a in df.columns else F.lit(float("nan"))
    return df.select(key, *[(value(a) * (factors or {}).get(f, 1.0)).alias(f) for f, a in names.items()])


def target_risks(df: DataFrame, key: str, models: dict[str, PipelineModel], numbers: list[str], contract: str, wanted: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """key, target, probability and place of every model but the excluded ones; places fall by probability within a row (ties by target), and rows stay where they are. A model of another contract version is refused."""
    if contract != wanted:
        raise ValueError(f"models of contract {contract}, features of {wanted}")
    own, scores = df, []
    for i, (target, m) in enumerate(sorted(models.items())):
        if target not in excluded:
            own = predict(m, own, numbers, f"_p{i}")
            scores.append(F.struct((-F.col(f"_p{i}")).alias("_o"), F.lit(target).alias("target"), F.col(f"_p{i}").alias("probability")))
    return own.select(key, F.posexplode(F.array_sort(F.array(*scores))).alias("_at", "_s")).select(key, "_s.target", "_s.probability", (F.col("_at") + 1).alias("place"))


def recalibrated(df: DataFrame, probability: str, label: str, out: str = "calibrated") -> DataFrame:
    """Isotonic regression of the label on the probability."""
    own = df.withColumn("_label", F.col(label).cast("double")).withColumn("_f", F.col(probability))
    model = IsotonicRegression(featuresCol="_f", labelCol="_label", predictionCol=out).fit(own)
    return model.transform(own).drop("_label", "_f")


def split_by_period(df: DataFrame, period: str, train: list, test: list) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(period).isin(train)), df.filter(F.col(period).isin(test))


def generated(spark, n: int, seed: int, prevalence: dict[str, float]) -> DataFrame:
    """n rows of yes or no answers, each from a hash of row, question and seed: the same on any cluster."""
    u = lambda name: F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return spark.range(n).select("id", *[(u(k) < p).cast("int").alias(k) for k, p in prevalence.items()])
