"""Logistic regressions of many labels on the same features, fitted together: every pass over the rows serves all labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class MultiLabel:
    """Features and weights: numbers filled by medians, flags of missing ones, one column a category's value; all divided by their deviation."""

    numbers: list[str]
    medians: dict[str, float]
    categories: dict[str, list[str]]
    labels: list[str]
    scale: object
    weights: object  # labels by features and, last, the intercept

    def features(self) -> list:
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numbers]
        flags = [F.col(c).cast("double").isNull().cast("double") for c in self.numbers]
        hot = [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c, values in self.categories.items() for v in values]
        return filled + flags + hot

    def names(self) -> list[str]:
        return [*self.numbers, *(f"{c}_missing" for c in self.numbers), *(f"{c}={v}" for c, values in self.categories.items() for v in values)]

    def predict(self, df: DataFrame, out: str = "p_{}") -> DataFrame:
        """df with a probability for each label; features are read once."""
        import numpy as np

        w, scale = np.asarray(self.weights), np.asarray(self.scale)

        @F.pandas_udf("array<double>")
        def score(x):
            m = np.stack(x.to_numpy()) / scale if len(x) else np.zeros((0, len(scale)))
            return __import__("pandas").Series(list(1 / (1 + np.exp(-(m @ w[:, :-1].T + w[:, -1])))))

        scored = df.withColumn("_p", score(F.array(*self.features())))
        return scored.select(*df.columns, *[F.get("_p", F.lit(i)).alias(out.format(label)) for i, label in enumerate(self.labels)])


def _rows(batch: pa.RecordBatch, d: int, n_labels: int):
    """The features and the labels (NaN: none) of a batch."""
    return (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for k, n in ((0, d), (1, n_labels)))


def _sums(design: DataFrame, step, n: int):
    """What `step` gives for every batch (n rows of float64), summed over all rows: tasks' sums meet by row, and n rows come back."""
    import numpy as np

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = step(batch)
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([np.ascontiguousarray(t, np.float64).tobytes() for t in total], pa.binary())], ["row", "sums"])

    def add(table: pa.Table) -> pa.Table:
        both = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("sums"))
        return pa.table({"row": table.column("row").slice(0, 1), "sums": pa.array([both.tobytes()], pa.binary())})

    found = design.mapInArrow(partial, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary").collect()
    return [np.frombuffer(r.sums, np.float64) for r in sorted(found, key=lambda r: r.row)]


def fit_labels(df: DataFrame, numbers: list[str], categories: list[str], labels: list[str], reg: float = 0.01, max_iter: int = 25, tol: float = 1e-8, most_values: int = 200) -> MultiLabel:
    """Balanced logistic regressions of 0/1 labels (null: not in that label's fit), by Newton steps that all labels take together.

    For each label, the mean weighted loss plus reg / 2 times the squared weights (not the intercept) is minimal. A step
    is one scan: tasks sum gradients and curvatures of all labels over Arrow blocks, and labels by features squared
    numbers reach the driver. The number of jobs doesn't depend on the number of labels. A category of more than
    most_values values is refused; one that the fit hasn't seen has no column.
    """
    import numpy as np

    median = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(c) for c in numbers] or [F.lit(0)]).first()
    values: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        seen = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories])).alias("_s")).select("_s.*").filter("v IS NOT NULL").distinct()
        for r in seen.limit(most_values * len(categories) + 1).collect():
            values[r.c].append(r.v)
        for c, v in values.items():
            if len(v) > most_values:
                raise ValueError(f"{c} has more than {most_values} values")
    model = MultiLabel(numbers, {c: float(median[c]) if median[c] is not None else 0.0 for c in numbers}, {c: sorted(v) for c, v in values.items()}, labels, None, None)
    d, k = len(model.names()), len(labels)
    design = df.select(F.array(*model.features()).alias("x"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in labels]).alias("y"))

    def moments(batch):
        x, y = _rows(batch, d, k)
        return [np.array([len(x)], float), x.sum(axis=0), (x * x).sum(axis=0), np.nansum(y, axis=0), (~np.isnan(y)).sum(axis=0)]

    n, s1, s2, positive, known = _sums(design, moments, 5) or (np.zeros(1), *[np.zeros(d)] * 2, *[np.zeros(k)] * 2)
    deviation = np.sqrt(np.maximum(s2 - s1 * s1 / max(n[0], 1), 0) / max(n[0] - 1, 1))
    scale = np.where(deviation > 0, deviation, 1.0)
    share = np.clip(np.where(known > 0, positive / np.maximum(known, 1), 0.5), 1e-6, 1 - 1e-6)
    high, low = 0.5 / share, 0.5 / (1 - share)
    mass = np.maximum(positive * high + (known - positive) * low, 1e-12)
    w = np.zeros((k, d + 1))
    ridge = np.append(np.full(d, reg), 0.0)
    step, loss = np.zeros_like(w), np.full(k, np.inf)
    for _ in range(max_iter if n[0] else 0):

        def slopes(batch, w=w):
            x, y = _rows(batch, d, k)
            x = np.hstack([x / scale, np.ones((len(x), 1))])
            there = ~np.isnan(y)
            y = np.where(there, y, 0.0)
            c = there * np.where(y > 0.5, high, low)
            z = x @ w.T
            p = 1 / (1 + np.exp(-z))
            losses = (c * (np.logaddexp(0, z) - y * z)).sum(axis=0)
            return [losses, x.T @ (c * (p - y)), *((x * (c[:, i] * p[:, i] * (1 - p[:, i]))[:, None]).T @ x for i in range(k))]

        losses, gradient, *curves = _sums(design, slopes, 2 + k)
        now = losses / mass + 0.5 * (ridge * w * w).sum(axis=1)
        worse = now > loss + 1e-12
        gradient = gradient.reshape(d + 1, k).T / mass[:, None] + ridge * w
        fresh = np.stack([np.linalg.lstsq(c.reshape(d + 1, d + 1) / m + np.diag(ridge), g, rcond=None)[0] for c, m, g in zip(curves, mass, gradient, strict=True)])
        # a label whose loss rose takes half of its last step back, the others their next one
        step = np.where(worse[:, None], -step / 2, -fresh)
        loss = np.where(worse, loss, now)
        w = w + step
        if np.abs(step).max() < tol:
            break
    model.scale, model.weights = scale.tolist(), w.tolist()
    return model
