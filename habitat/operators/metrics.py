"""Model metrics: Boyce index, ROC AUC, merged metric, ensembles, correlations.

Scores are reduced to counts per group and score by a partial aggregation
before anything is ordered, and no window ever spans all scores of a group.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Score buckets per power of two; see _bucket.
BUCKETS = 1 << 20


def _with_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join on group columns; with no groups the single right row is a scalar subquery."""
    if by:
        return left.join(right, by)
    names = right.columns
    row = right.select(F.struct(*names).alias("_row")).scalar()
    return left.withColumn("_row", row).select(*left.columns, *[F.col(f"_row.{n}").alias(n) for n in names])


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; null where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def score_counts(df: DataFrame, p: str, label: str, by: list[str], parts: int | None = None) -> DataFrame:
    """Presences ``_one`` and backgrounds ``_zero`` per group, bucket ``_b`` and score ``_p``; rows without a score are left out.

    ``parts`` deals the scores into so many tasks, for callers that know their number; equal scores then
    meet as rows. Without it they are counted before they move.
    """
    score = F.col(p).cast("double") + 0.0
    scored = df.filter(F.col(p).isNotNull()).select(
        *by, score.alias("_p"), (F.col(label) == 1).cast("long").alias("_one"), (F.col(label) == 0).cast("long").alias("_zero")
    )
    scored = scored.withColumn("_b", _bucket(F.col("_p"))).withColumn("_c", F.floor(F.col("_b") / 1024))
    if parts:
        scored = scored.repartition(parts, *by, "_c")
    return scored.groupBy(*by, "_c", "_b", "_p").agg(F.sum("_one").alias("_one"), F.sum("_zero").alias("_zero"))


def boyce_index(df: DataFrame, p: str = "p", label: str = "label", bins: int = 10, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Boyce index per group, as column ``boyce``.

    Equal-width bins over all scores of the group, the last one closed. Correlation
    of bin middle and presence/background ratio over bins that hold background.
    0 with fewer than two different presence scores or two such bins; NaN where the
    ratio is the same in all of them.
    """
    by = list(by or [])
    return _boyce(score_counts(df, p, label, by, parts).drop("_b", "_c"), bins, by)


def _boyce(counts: DataFrame, bins: int, by: list[str]) -> DataFrame:
    # Equal scores share a bin, so both passes work on counts per score.
    present = F.when(F.col("_one") > 0, F.col("_p"))
    range_ = counts.groupBy(*by).agg(
        F.min("_p").alias("_lo"), F.max("_p").alias("_hi"), F.min(present).alias("_plo"), F.max(present).alias("_phi")
    ).withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("_hi")).otherwise(F.col("_lo") + i * F.col("_step"))

    scored = _with_groups(counts, range_, by)
    guess = F.floor((F.col("_p") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins)))
    guess = F.when(F.col("_hi") > F.col("_lo"), F.least(guess, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    scored = scored.withColumn("_g", guess)
    # The edges decide, not the rounded quotient.
    fixed = (
        F.when(F.col("_p") < edge(F.col("_g")), F.col("_g") - 1)
        .when((F.col("_g") < bins - 1) & (F.col("_p") >= edge(F.col("_g") + 1)), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    binned = (
        scored.withColumn("_b", fixed)
        .groupBy(*by, "_b")
        .agg(
            F.sum("_one").alias("_one"),
            F.sum("_zero").alias("_zero"),
            *[F.first(c).alias(c) for c in ("_lo", "_hi", "_plo", "_phi", "_step")],
        )
    )
    middle = (edge(F.col("_b")) + edge(F.col("_b") + 1)) / 2
    held = F.col("_zero") > 0
    ratio = F.when(held, F.col("_one") / F.col("_zero"))
    out = binned.groupBy(*by).agg(
        correlation(F.when(held, middle), ratio).alias("_corr"),
        F.sum(held.cast("int")).alias("_bins"),
        F.coalesce(F.max(F.col("_phi") > F.col("_plo")), F.lit(False)).alias("_varies"),
    )
    value = F.when(F.col("_varies") & (F.col("_bins") >= 2), F.coalesce(F.col("_corr"), F.lit(float("nan")))).otherwise(0.0)
    return out.select(*by, value.alias("boyce"))


def _place(size: Column) -> Column:
    """Order-preserving bucket of a size: straight lines between powers of two."""
    power = F.floor(F.log2(F.greatest(size, F.lit(1e-300))))
    place = (power + 1000.0) * BUCKETS + F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * BUCKETS)
    return F.when(size < 1e-300, F.lit(0)).otherwise(place).cast("long")


def _bucket(p: Column) -> Column:
    """Order-preserving bucket of a score, fine near 0 and near 1 alike.

    Equal scores share a bucket and a larger score never gets a smaller one. Scores
    that crowd at either end of the scale of probabilities still spread.
    """
    middle = 2 * 999 * BUCKETS
    return (
        F.when(p < 0, -_place(-p))
        .when(p <= 0.5, _place(p))
        .when(p <= 1, F.lit(middle) - _place(F.lit(1.0) - p))
        .otherwise(F.lit(middle) + _place(p))
    )


def roc_auc(df: DataFrame, p: str = "p", label: str = "label", by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Area under the ROC curve per group, as column ``auc``; ties count one half.

    A group with one class only gives 0. Wins over lower background are summed in three
    levels, each from the sums of the one before: the scores of one bucket, the buckets of
    one coarse bucket, and the coarse buckets. ``parts`` as in ``score_counts``.
    """
    by = list(by or [])
    return _auc(score_counts(df, p, label, by, parts), by)


def _auc(counts: DataFrame, by: list[str]) -> DataFrame:
    def level(rows: DataFrame, group: list[str], order: str) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        wins = F.col("_w") + F.col("_one") * F.coalesce(F.sum("_zero").over(window), F.lit(0))
        won = rows.withColumn("_w", wins)
        return won.groupBy(*group).agg(F.sum("_w").alias("_w"), F.sum("_one").alias("_one"), F.sum("_zero").alias("_zero"))

    scores = counts.withColumn("_w", F.col("_one") * F.col("_zero") / 2)
    out = level(level(level(scores, [*by, "_c", "_b"], "_p"), [*by, "_c"], "_b"), by, "_c")
    pairs = F.col("_one").cast("double") * F.col("_zero")
    return out.select(*by, F.coalesce(F.try_divide(F.col("_w"), pairs), F.lit(0.0)).alias("auc"))


def merged_metric(df: DataFrame, auc: str = "auc", boyce: str = "boyce") -> DataFrame:
    """Add both metrics on the scale to 1 and their mean, ``mixed``."""
    scaled_auc, scaled_boyce = (F.col(auc) - 0.5) / 0.5, (F.col(boyce) + 1.0) / 2
    return df.withColumns(
        {"auc_norm": scaled_auc, "boyce_norm": scaled_boyce, "mixed": (scaled_auc + scaled_boyce) / 2}
    )


def evaluate(df: DataFrame, p: str = "p", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Both metrics and their mean per group, from one table of counts per score."""
    by = list(by or [])
    counts = score_counts(df, p, label, by)
    return merged_metric(_with_groups(_auc(counts, by), _boyce(counts.drop("_b", "_c"), 10, by), by))


def ensemble_mean(scores: DataFrame, key: list[str], p: str = "p", name: str = "probability") -> DataFrame:
    return scores.groupBy(*key).agg(F.avg(p).alias(name))


def widen_scores(scores: DataFrame, models: list[str], key: list[str], p: str = "p") -> DataFrame:
    """One row per record with one column per model."""
    return scores.groupBy(*key).agg(*[F.max(F.when(F.col("model") == m, F.col(p))).alias(m) for m in models])


def subsets(models: list[str]) -> dict[str, list[str]]:
    """All non-empty subsets by name, small ones first."""
    return {
        "+".join(chosen): list(chosen) for size in range(1, len(models) + 1) for chosen in combinations(models, size)
    }


def subset_scores(wide: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """Mean probability of every subset: one row per record and subset, no shuffle."""
    def mean(chosen: list[str]) -> Column:
        total = F.col(chosen[0])
        for m in chosen[1:]:
            total = total + F.col(m)
        return total / F.lit(float(len(chosen)))

    cases = [F.struct(F.lit(name).alias("ensemble"), mean(chosen).alias("p")) for name, chosen in subsets(models).items()]
    return wide.select(*keep, F.explode(F.array(*cases)).alias("_s")).select(*keep, "_s.ensemble", "_s.p")


def evaluate_ensembles(wide: DataFrame, models: list[str], label: str = "label", by: list[str] | None = None) -> DataFrame:
    """AUC, Boyce and mixed metric of every ensemble, best first, in one job."""
    by = list(by or [])
    long = subset_scores(wide, models, [*by, label])
    scored = evaluate(long, "p", label, [*by, "ensemble"])
    best_first = F.desc_nulls_last(F.nullif(F.col("mixed"), F.lit(float("nan"))))
    return scored.select(*by, "ensemble", "auc", "boyce", "mixed").orderBy(*by, best_first, "ensemble")


def corr_with(df: DataFrame, target: str = "probability", columns: list[str] | None = None) -> DataFrame:
    """Correlation of every column with ``target``, in one pass, highest first.

    A constant column has no correlation (null) and comes last.
    """
    columns = columns or [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double")]
    one = df.agg(*[correlation(F.col(f"`{c}`").cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("corr")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.feature", "r.corr").orderBy(F.desc("corr"), "feature")


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") * 100.0 / total).alias("share"))


def classification_report(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages.

    All rows come from the table of (label, prediction) counts.
    """
    cells = df.groupBy(F.col(label).cast("string").alias("_y"), F.col(predicted).cast("string").alias("_q")).agg(
        F.count("*").alias("_n")
    )
    sides = cells.select("_n", F.explode(F.array(
        F.struct(F.col("_y").alias("class"), F.lit(True).alias("true"), (F.col("_y") == F.col("_q")).alias("hit")),
        F.struct(F.col("_q").alias("class"), F.lit(False).alias("true"), F.lit(False).alias("hit")),
    )).alias("s")).select("_n", "s.*")
    per = sides.groupBy("class").agg(
        F.sum(F.when(F.col("hit"), F.col("_n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("true"), F.col("_n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("true"), F.col("_n")).otherwise(0)).alias("_said"),
    )
    zero = F.lit(0.0)
    per = per.withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("_said")), zero),
            "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero),
        }
    ).withColumn(
        "f1",
        F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero),
    )
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in scores], total.alias("support"))
    weighted = per.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in scores],
        total.alias("support"),
    )
    accuracy = per.agg(
        F.lit("accuracy").alias("class"),
        *[(F.sum("tp") / total).alias(c) for c in scores],
        total.alias("support"),
    )
    classes = per.select("class", *scores, "support")
    return classes.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def top_features(df: DataFrame, k: int, by: str = "importance") -> DataFrame:
    return df.orderBy(F.desc(by), "feature").limit(k)


def metrics_long(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row per key and metric: ``metric``, ``value``."""
    return df.unpivot([key], metrics, "metric", "value")
