"""A wide row into a fixed feature contract."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: stands for an absent number.
ABSENT = -1.0


def contract(df: DataFrame, key: str, text: list[str], numbers: list[str]) -> DataFrame:
    """key, every contract column in order: texts default to `missing`, numbers to -1 with a `_reported` flag; other columns go."""
    have = set(df.columns)
    t = [F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) if c in have else F.lit("missing").alias(c) for c in text]
    n = [F.coalesce(F.col(c).cast("double"), F.lit(ABSENT)).alias(c) if c in have else F.lit(ABSENT).alias(c) for c in numbers]
    r = [(F.col(c).isNotNull() if c in have else F.lit(False)).cast("int").alias(f"{c}_reported") for c in numbers]
    return df.select(key, *t, *n, *r)


def with_defaults(df: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Derived columns fill in only where the column is absent or null."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in derived.items()})


def ordinal(c: Column, order: list[str]) -> Column:
    """Place of a value in an order, from 0; -1 for others and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), c).cast("int") - 1, F.lit(-1))


def burden(columns: list[Column]) -> Column:
    """Mean of the values that are there and not negative, three decimals; 0 if none."""
    fine = F.filter(F.array(*columns), lambda x: x.isNotNull() & (x >= 0))
    total = F.aggregate(fine, F.lit(0.0), lambda s, x: s + x)
    return F.round(F.when(F.size(fine) > 0, total / F.size(fine)).otherwise(0.0), 3)


def prepared(df: DataFrame, key: str, diet: list[str], labs: list[str], symptoms: list[str]) -> DataFrame:
    """key with what a model asks beside the answers: for each diet quantity `_reported`, for each laboratory status observed, age_days, unit_known and range_known, and the counts over them; burden and number of high symptoms.

    A column that the table lacks, or a null, is absent: a quantity of -1, a status `missing`, a symptom of 0. Ages are 30
    days for an observed status, else 999.
    """
    number = lambda c, absent: F.coalesce(F.col(c).cast("double"), F.lit(absent)) if c in df.columns else F.lit(absent)
    reported = {c: (number(c, ABSENT) >= 0).cast("int") for c in diet}
    observed = {c: (F.coalesce(F.col(c).cast("string"), F.lit("missing")) != "missing").cast("int") if c in df.columns else F.lit(0) for c in labs}
    base = lambda c: c.removeprefix("lab_").removesuffix("_status")
    total = lambda parts: functools.reduce(operator.add, parts) if parts else F.lit(0)
    score = [number(c, 0.0) for c in symptoms]
    out = [v.alias(f"{c}_reported") for c, v in reported.items()]
    for c, v in observed.items():
        out += [v.alias(f"lab_{base(c)}_observed"), F.when(v == 1, 30).otherwise(999).alias(f"lab_{base(c)}_age_days"), v.alias(f"lab_{base(c)}_unit_known"), v.alias(f"lab_{base(c)}_range_known")]
    n_reported, n_observed = total(list(reported.values())), total(list(observed.values()))
    return df.select(
        key,
        *out,
        (len(diet) - n_reported).alias("diet_quantity_missing_count"),
        n_observed.alias("observed_lab_count"),
        (len(labs) - n_observed).alias("missing_lab_count"),
        F.round(total(score) / max(len(symptoms), 1), 3).alias("symptom_burden_score"),
        total([(s.cast("int") >= 4).cast("int") for s in score]).alias("high_symptom_count"),
    )
