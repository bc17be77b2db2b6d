"""Logistic regression: fits, probabilities, closed-form attribution."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitat.config import LOGIT_GRID, LogitParams
from habitat.functions.losses import sigmoid
from habitat.learning.logit_many import Fit, fit_many
from habitat.operators.metrics import boyce_index, roc_auc
from habitat.operators.splits import fold_column


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name).transform(df)


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    return {int(r[label]): r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def _estimator(params: LogitParams, rows: int, weighted: bool) -> LogisticRegression:
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": params.l1_ratio, "none": 0.0}[params.penalty]
    strength = 0.0 if params.penalty == "none" else 1.0 / (params.C * rows)
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        regParam=strength,
        elasticNetParam=mix,
        maxIter=params.max_iter,
        standardization=False,
        family="binomial",
    )
    return lr.setWeightCol("weight") if weighted else lr


def fit_logit(
    df: DataFrame,
    features: list[str],
    params: LogitParams = LogitParams(),
    label: str = "label",
    counts: dict[int, int] | None = None,
) -> LogisticRegressionModel:
    """Fit on standardised features; the penalty is scaled to the mean loss.

    ``counts`` are the rows per class, if they are known already.
    """
    data = assemble(df.withColumn("label", F.col(label).cast("double")), features)
    counts = counts or class_counts(df, label)
    rows = sum(counts.values())
    weighted = params.class_weight == "balanced"
    if weighted:
        # Balanced: n / (classes * n_class).
        share = {c: rows / (len(counts) * n) for c, n in counts.items()}
        data = data.withColumn("weight", F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    return _estimator(params, rows, weighted).fit(data)


def predict_probability(model: LogisticRegressionModel, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    scored = model.transform(assemble(df, features, model.getFeaturesCol()))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def coefficients(model: LogisticRegressionModel) -> tuple[list[float], float]:
    return [float(v) for v in model.coefficients], float(model.intercept)


def linear_logit(weights: list[float], intercept: float, features: list[str]) -> Column:
    z = F.lit(float(intercept))
    for w, f in zip(weights, features):
        z = z + F.lit(float(w)) * F.col(f"`{f}`")
    return z


def linear_attribution(df: DataFrame, weights: list[float], features: list[str], key: str = "row_id") -> DataFrame:
    """Exact attribution of a linear logit: ``w_j * (x_j - mean_j)``, one row per feature."""
    means = df.agg(F.array(*[F.avg(f"`{f}`") for f in features])).scalar()
    parts = [
        F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f"`{f}`") - F.col("_means")[i])).alias("value"))
        for i, (f, w) in enumerate(zip(features, weights))
    ]
    return df.withColumn("_means", means).select(key, F.explode(F.array(*parts)).alias("a")).select(key, "a.feature", "a.value")


def expand_grid(grid: dict[str, list] = LOGIT_GRID) -> list[LogitParams]:
    names = list(grid)
    return [LogitParams(**dict(zip(names, values))) for values in product(*grid.values())]


def _family(s: LogitParams) -> tuple:
    """What the fitted optimum depends on; equal for settings that differ in nothing but the iteration limit."""
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": s.l1_ratio, "none": None}[s.penalty]
    return (None, None, s.class_weight) if mix is None else (float(s.C), mix, s.class_weight)


def _fit_of(s: LogitParams, fold: int, counts: dict[int, int], stops: list[int]) -> Fit:
    c, mix, _ = _family(s)
    rows = sum(counts.values())
    strength = 0.0 if c is None or not rows else 1.0 / (c * rows)
    weights = (1.0, 1.0)
    if s.class_weight == "balanced":
        weights = tuple(rows / (len(counts) * counts[k]) if k in counts else 1.0 for k in (0, 1))
    return Fit(fold, weights, strength * (mix or 0.0), strength * (1.0 - (mix or 0.0)), stops)


def _held_out(models: np.ndarray, features: list[str]) -> Column:
    """Probabilities of a row under every model (model, fold, coefficients), by that row's fold."""

    @F.pandas_udf("array<double>")
    def score(fold: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        own = models[:, fold.to_numpy()]
        z = np.einsum("mrk,rk->rm", own[..., :-1], x) + own[..., -1].T
        return pd.Series(list(1.0 / (1.0 + np.exp(-z))))

    return score("fold", *[F.col(f"`{f}`").cast("double") for f in features])


#: Scores that one task of a search orders.
SCORES = 250_000


def score_parts(spark: SparkSession, scores: int) -> int:
    """Tasks for so many scores: what a task holds does not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-scores // SCORES))


def grid_search(
    df: DataFrame,
    features: list[str],
    grid: dict[str, list] | list[LogitParams] = LOGIT_GRID,
    scorer: str = "boyce",
    folds: int = 5,
    label: str = "label",
    key: str = "row_id",
    parallelism: int = 4,
) -> tuple[LogitParams, DataFrame]:
    """Cross-validated search; returns the best settings and the mean score of each.

    Folds come from a hash of the key. All fits advance together, one pass over the rows per step
    (``logit_many``), whence ``parallelism`` is not used any more. Settings that give the same model
    in every fold are fitted and scored once: C where there is no penalty, and iteration limits
    that no fold reaches. Then every model scores its held-out fold in one pass and the
    metric is taken per (model, fold) in one aggregation. A score of NaN ranks last.
    """
    settings = grid if isinstance(grid, list) else expand_grid(grid)
    data = fold_column(df.select(key, label, *features), key, folds).persist()
    try:
        sizes = data.groupBy("fold", label).agg(F.count("*").alias("n")).collect()
        families: dict[tuple, list[int]] = {}
        for i, s in enumerate(settings):
            families.setdefault(_family(s), []).append(i)
        jobs, fixed = {}, {}
        for family, members in families.items():
            stops = sorted({settings[i].max_iter for i in members})
            for fold in range(folds):
                counts: dict[int, int] = {}
                for r in sizes:
                    if r["fold"] != fold:
                        counts[int(r[label])] = counts.get(int(r[label]), 0) + r["n"]
                job = _fit_of(settings[members[0]], fold, counts, stops)
                if len(counts) > 1:
                    jobs[family, fold] = job
                else:
                    # One class only: its probability is 1, as in fit_logit.
                    only = np.append(np.zeros(len(features)), np.inf if 1 in counts else -np.inf)
                    fixed[family, fold] = {stop: only for stop in stops}
        fit_many(data, features, label, list(jobs.values()))
        fitted = {job: fit.at for job, fit in jobs.items()} | fixed
        # Models by their coefficients in all folds.
        models: dict[bytes, np.ndarray] = {}
        model_of = []
        for s in settings:
            each = np.stack([fitted[_family(s), fold][s.max_iter] for fold in range(folds)])
            models.setdefault(each.tobytes(), each)
            model_of.append(list(models).index(each.tobytes()))
        held_out = _held_out(np.stack(list(models.values())), features)
        parts = score_parts(df.sparkSession, len(models) * sum(r["n"] for r in sizes))
        # The rows are dealt as well, since each becomes a score per model.
        scores = data.repartition(parts, key).select(label, "fold", F.posexplode(held_out).alias("setting", "p"))
        metric = {"boyce": boyce_index, "roc_auc": roc_auc}[scorer]
        value = {"boyce": "boyce", "roc_auc": "auc"}[scorer]
        means = metric(scores, "p", label, by=["setting", "fold"], parts=parts).groupBy("setting").agg(F.avg(value).alias("score")).collect()
        by_model = {r["setting"]: r["score"] for r in means}
        result = sorted(
            ({"setting": i, "score": by_model[m]} for i, m in enumerate(model_of)),
            key=lambda r: (r["score"] != r["score"], -r["score"] if r["score"] == r["score"] else 0.0, r["setting"]),
        )
    finally:
        data.unpersist()
    rows = [
        (r["setting"], float(s.C), s.penalty, s.class_weight, s.max_iter, r["score"])
        for r in result
        for s in [settings[r["setting"]]]
    ]
    table = df.sparkSession.createDataFrame(
        rows, "setting int, C double, penalty string, class_weight string, max_iter int, score double"
    )
    return settings[result[0]["setting"]], table
