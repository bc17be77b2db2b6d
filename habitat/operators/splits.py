"""Train/test split and standardisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.config import ENV_VARS, SEED, TEST_SHARE


def hash_share(key: str, seed: int):
    """First 32 bits of a seeded digest of the key, as a share of 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_rows(
    df: DataFrame, key: str = "row_id", share: float = TEST_SHARE, seed: int = SEED, name: str = "is_test"
) -> DataFrame:
    """Mark test rows by a hash of the key: no shuffle, same answer on every run."""
    return df.withColumn(name, hash_share(key, seed) < F.lit(float(share)))


def fold_column(df: DataFrame, key: str, folds: int, seed: int = SEED, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.floor(hash_share(key, seed + 1) * folds).cast("int"))


def fit_scaler(df: DataFrame, columns: list[str] = ENV_VARS, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation per feature, one row each, in one aggregation."""
    by = by or []
    stats = [F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    wide = df.groupBy(*by).agg(*stats)
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.std").alias("std")) for c in columns]
    )
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.feature", "r.mean", "r.std")


def apply_scaler(df: DataFrame, params: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Standardise the columns named in ``params``; a deviation of 0 divides by 1.

    ``params`` has one row per feature (and group), so it is small whatever the
    size of ``df``. With no groups its rows are read once and become literals.
    """
    by = by or []
    if not by:
        rows = [(r["feature"], r["mean"], r["std"]) for r in params.select("feature", "mean", "std").collect()]
        return df.withColumns(
            {f: (F.col(f) - F.lit(m)) / F.lit(s if s else 1.0) for f, m, s in rows}
        )
    features = [r["feature"] for r in params.select("feature").distinct().collect()]
    picks = []
    for f in features:
        hit = F.col("feature") == f
        picks += [F.max(F.when(hit, F.col("mean"))).alias(f"_m_{f}"), F.max(F.when(hit, F.col("std"))).alias(f"_s_{f}")]
    wide = params.groupBy(*by).agg(*picks)
    joined = df.join(wide, by, "left")
    scaled = joined.withColumns(
        {f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}")) for f in features}
    )
    return reduce(lambda d, f: d.drop(f"_m_{f}", f"_s_{f}"), features, scaled)
