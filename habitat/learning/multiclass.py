"""Species as classes: multi-class network, one-vs-rest, sigmoid calibration."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitat.functions.losses import sigmoid
from habitat.learning.logit import assemble
from habitat.learning.mlp_many import OneHidden, fit_many, probabilities


def index_classes(df: DataFrame, column: str) -> tuple[DataFrame, list]:
    """Add ``label`` (0, 1, ...) in the order of the class names, and return the names.

    The classes are a table joined by name; rows without a class have no label. The names are read because
    every network below has an output for each of them.
    """
    names = df.select(F.col(column).alias("_class")).na.drop().distinct()
    ranked = names.withColumn("label", (F.row_number().over(Window.orderBy("_class")) - 1).cast("double"))
    out = df.join(ranked, F.col(column) == F.col("_class"), "left").drop("_class")
    return out, [r["_class"] for r in ranked.orderBy("label").collect()]


def _best(scores: str) -> Column:
    return (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("double")


def fit_mlp_multiclass(df: DataFrame, features: list[str], classes: int, hidden: int = 100, max_iter: int = 500, seed: int = 1) -> OneHidden:
    """One hidden layer and one output per class; ``label`` holds 0..classes-1."""
    return fit_many(df, features, "label", classes, [None], hidden, max_iter, seed)[0]


def predict_classes(model: OneHidden, df: DataFrame, features: list[str]) -> DataFrame:
    """Add ``prediction`` and ``probabilities`` (one per class)."""
    scored = df.withColumn("probabilities", probabilities([model], features))
    return scored.select(*df.columns, _best("probabilities").alias("prediction"), "probabilities")


def fit_ovr(df: DataFrame, features: list[str], classes: int, hidden: int = 100, max_iter: int = 500, seed: int = 1) -> list[OneHidden]:
    """One two-class network per class; all advance together, one pass over the rows per step."""
    return fit_many(df, features, "label", 2, list(range(classes)), hidden, max_iter, seed)


def predict_ovr(models: list[OneHidden], df: DataFrame, features: list[str]) -> DataFrame:
    """Independent class probabilities scaled to a sum of 1, and the largest as ``prediction``.

    The models score in one call on the same rows, so nothing is joined.
    """
    scored = df.withColumn("_raw", probabilities(models, features, 1))
    total = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
    shares = F.transform("_raw", lambda p: F.coalesce(F.try_divide(p, total), F.lit(1.0 / len(models))))
    scored = scored.withColumn("probabilities", shares)
    return scored.select(*df.columns, _best("probabilities").alias("prediction"), "probabilities")


def calibrate_sigmoid(df: DataFrame, classes: int, scores: str = "probabilities", max_iter: int = 100) -> list[tuple[float, float]]:
    """Slope and offset per class, fitted to the class's score on smoothed targets.

    A target of the class is (n+ + 1) / (n+ + 2) and of the rest 1 / (n- + 2); each row
    enters as a weighted pair of both outcomes.
    """
    counts = {int(r["label"]): r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    fits = []
    for c in range(classes):
        n = counts.get(c, 0)
        target = F.when(F.col("label") == c, (n + 1.0) / (n + 2.0)).otherwise(1.0 / (total - n + 2.0))
        data = assemble(df.select(F.col(scores)[c].alias("_s"), target.alias("_t")), ["_s"])
        pairs = F.array(
            F.struct(F.lit(1.0).alias("y"), F.col("_t").alias("w")),
            F.struct(F.lit(0.0).alias("y"), (1.0 - F.col("_t")).alias("w")),
        )
        data = data.select("features", F.explode(pairs).alias("e")).select("features", "e.y", "e.w")
        model = LogisticRegression(labelCol="y", weightCol="w", maxIter=max_iter, standardization=False).fit(data)
        fits.append((float(model.coefficients[0]), float(model.intercept)))
    return fits


def apply_calibration(df: DataFrame, fits: list[tuple[float, float]], scores: str = "probabilities") -> DataFrame:
    """Calibrated probabilities, scaled to a sum of 1, and the new ``prediction``."""
    raw = [sigmoid(F.lit(a) * F.col(scores)[c] + F.lit(b)) for c, (a, b) in enumerate(fits)]
    out = df.withColumn("_cal", F.array(*raw))
    total = F.aggregate("_cal", F.lit(0.0), lambda a, v: a + v)
    out = out.withColumn(scores, F.transform("_cal", lambda v: v / total)).drop("_cal")
    return out.withColumn("prediction", _best(scores))
