"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that training sees; labelled negatives are never used. The class
prior is estimated from the two score distributions over the whole corpus: the least ratio of the unlabelled to the
positive share above any threshold. A logistic model then minimises the non-negative unbiased risk
prior * R+(1) + max(0, Ru(0) - prior * R+(0)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm._shared import stored, text_hash

#: The ASCII punctuation whose shares are features.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHAPE = ("upper", "lower", "digit", "space", "newline", "other", "log_words", "word_length", "distinct_words", "distinct_pairs", "short_words", "repeats_next", "repeated_lines", "spread", "line_words", "ends_like")
N_FEATURES = len(PUNCTUATION) + len(SHAPE)
#: Rows of each kind that the model is fitted on, at most; the prior is estimated on all rows.
FIT_ROWS = 20_000
BINS = 512


def features(text: str | None) -> list[float]:
    """Shares of characters and words; an empty text has zeros."""
    import numpy as np

    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    share = lambda a, b: float(counts[a : b + 1].sum()) / n
    words = raw.split()
    k = max(1, len(words))
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = {}
    for w in words:
        ends[w[-1:]] = ends.get(w[-1:], 0) + 1
    p = counts[counts > 0] / n
    shape = [
        share(65, 90), share(97, 122), share(48, 57), share(32, 32), float(counts[10]) / n, share(128, 255), math.log1p(len(words)) / 10, min(1.0, (n - counts[32] - counts[10]) / k / 20),
        kinds / k, pairs / k, sum(len(w) <= 3 for w in words) / k, again / k, 1 - len(set(lines)) / max(1, len(lines)), float(-(p * np.log(p)).sum()) / 5, min(1.0, k / max(1, len(lines)) / 200), max(ends.values(), default=0) / k,
    ]
    marks = counts[np.frombuffer(PUNCTUATION.encode(), np.uint8)] / n
    return [*np.minimum(1.0, marks * 10).tolist(), *shape]


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expanded(x):
    """Features and their squares: shares that are odd when low or high."""
    import numpy as np

    return np.hstack([x, x * x, np.minimum(x, 0.05) * 20])


def risk(zp, zu, prior: float):
    """The non-negative unbiased risk of log odds zp of positives and zu of unlabelled rows, its part that may not be negative, and the slopes by zp and zu.

    The logistic loss of a negative is log(1 + e^z): its mean over unlabelled rows, less the positives' part. Where that
    falls below zero, only that part is walked back.
    """
    import numpy as np

    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp, gu = _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    total = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    if negative >= 0:
        return total, negative, prior * (_sigmoid(zp) - 1) / len(zp) - prior * gp, gu
    return total, negative, prior * gp, -gu


def fit_nnpu(positive, unlabelled, prior: float, epochs: int = 60, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> dict:
    """Weights of the logistic model with the least non-negative risk; positive and unlabelled are feature matrices."""
    import numpy as np

    both = _expanded(np.vstack([positive, unlabelled]))
    mean, spread = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3)
    p, u = ((_expanded(x) - mean) / spread for x in (positive, unlabelled))
    p, u = np.clip(p, -8, 8), np.clip(u, -8, 8)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(both.shape[1]), 0.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    steps = max(1, min(len(u), 20_000) // 1000)
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for part_p, part_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            x, y = p[part_p], u[part_u]
            zp, zu = x @ w + b, y @ w + b
            _, _, toward_p, toward_u = risk(zp, zu, prior)
            g = np.append(toward_p @ x + toward_u @ y + ridge * w, toward_p.sum() + toward_u.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return {"w": w, "b": float(b), "mean": mean, "spread": spread}


def scores(model: dict, x):
    import numpy as np

    z = np.clip((_expanded(x) - model["mean"]) / model["spread"], -8, 8) @ model["w"] + model["b"]
    return _sigmoid(z)


def estimate_prior(positive_bins, unlabelled_bins, least_share: float = 0.2) -> float:
    """The least ratio of tail shares above a threshold that keeps least_share of the positives, with a margin for chance."""
    import numpy as np

    p, u = (np.cumsum(np.asarray(x, float)[::-1]) / max(1.0, float(np.sum(x))) for x in (positive_bins, unlabelled_bins))
    n = max(1.0, min(float(np.sum(positive_bins)), float(np.sum(unlabelled_bins))))
    kept = p >= least_share
    ratio = (u[kept] + 1 / math.sqrt(n)) / p[kept]
    return float(np.clip(ratio.min() if len(ratio) else 0.5, 0.05, 0.98))


def _matrix(rows):
    import numpy as np

    return np.array([r[0] for r in rows], float).reshape(-1, N_FEATURES)


def _with_scores(table: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores(model, x), pa.float64())], [*columns, "score"])

    return table.select("_x", *columns).mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double")


def _trained(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, fit_rows: int) -> tuple[DataFrame, dict | None]:
    """The rows' ids, hashes, features and held_out, and the model; no model without any positive."""
    h1, h2 = text_hash(text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column(3)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], ["_id", "_t1", "_t2", "_x"])

    own = docs.select(F.col(id_col).alias("_id"), h1.alias("_t1"), h2.alias("_t2"), F.col(text_col).cast("string").alias("_text"))
    table = stored(own.mapInArrow(extract, f"_id {id_type}, _t1 long, _t2 long, _x array<float>"), "features")
    ids = table.withColumnRenamed("_id", id_col).withColumn("held_out", F.coalesce(held_out, F.lit(False))).withColumnRenamed(id_col, "_id")
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y")).filter("_y = 1").select("_id")
    positives = stored(ids.filter("NOT held_out").join(marks, "_id", "left_semi").select("_x", F.xxhash64("_id", "_t1").alias("_h")), "positives")
    unlabelled = ids.filter("NOT held_out").select("_x", F.xxhash64("_id", "_t1").alias("_h"))

    def sample(df: DataFrame):
        """The rows with the smallest hashes, the same in every run. A first cut by hash leaves few more than asked for, so no task sends many."""
        cut = F.pmod("_h", F.lit(1 << 30)) < math.ceil((1.2 * fit_rows + 1000) / max(1, df.count()) * (1 << 30))
        return _matrix(df.filter(cut).orderBy(F.pmod("_h", F.lit(1 << 30)), "_h").select("_x").limit(fit_rows).collect())

    p, u = sample(positives), sample(unlabelled)
    if not len(p):
        return ids, None
    first = fit_nnpu(p, u, 0.5, epochs=15)

    def bins(df: DataFrame) -> list[int]:
        found = _with_scores(df, first, ["_h"]).groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
        out = [0] * BINS
        for r in found:
            out[r.bin] = r["count"]
        return out

    return ids, fit_nnpu(p, u, estimate_prior(bins(positives), bins(unlabelled)))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id_col, _t1, _t2 (the text's hash), held_out and score (0 to 1) of every row of docs.

    Positives are the rows of labels with label 1 and no held_out; unlabelled are all rows not held out. The model is
    fitted on `fit_rows` of each at most, those with the smallest hashes. Null, empty and very long texts are scored by
    the model like any other, whole. Without any positive every score is 0.5. Labels of ids that docs lacks, null labels
    and contradicting labels (an id with both) are no positives. Repeated rows are scored alike; null ids are passed on,
    and no label is theirs; an empty table gives none; other columns don't matter, whatever their names. held_out is an expression over id_col.
    """
    ids, model = _trained(docs, labels, held_out, id_col, text_col, label_col, fit_rows)
    own = ["_id", "_t1", "_t2", "held_out"]
    if model is None:
        return ids.select(*own, F.lit(0.5).alias("score")).withColumnRenamed("_id", id_col)
    return _with_scores(ids, model, own).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns.

    Rows are judged where they stand, by the model that score_quality scores with: no text is shuffled, and repeated
    rows, null ids and clashing column names need no care. Without any positive nothing is learned and every row stays.
    """
    _, model = _trained(docs, labels, held_out, id_col, text_col, label_col, fit_rows)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(texts):
        import numpy as np
        import pandas as pd

        # rounded to single precision, as the stored features are
        return pd.Series(scores(model, np.array([features(t) for t in texts], np.float32).astype(float).reshape(-1, N_FEATURES)))

    return docs.filter(score(F.col(text_col).cast("string")) >= threshold)
