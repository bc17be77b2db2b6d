"""Feature attribution of a model's logit by sampled feature orders.

For a record and an order of the features, features are switched one by one from
a baseline record to the record itself; the change of the logit at each switch is
that feature's share. Shares add up to the difference of the two logits exactly,
and their mean over orders and baselines estimates the Shapley value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.learning.mlp import Network, logits
from habitat.operators.cleaning import sample_n

BASELINE_ROWS = 50
#: Rows that a baseline may have: every task holds it, and every record meets each of them.
MOST_BASELINE = 1000


def _keys(seeds: np.ndarray, k: int, d: int) -> np.ndarray:
    """Random numbers per record and feature for its ``k``-th order, mixed from the record's seed."""
    x = seeds[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(d, dtype=np.uint64) + np.uint64(k * d + 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shapley(
    df: DataFrame,
    nets: list[Network],
    features: list[str],
    orders: int = 8,
    baseline: DataFrame | None = None,
    key: str = "row_id",
    seed: int = 42,
    baseline_rows: int = BASELINE_ROWS,
) -> DataFrame:
    """Attribution per record and feature (``key, feature, value``), mean over models.

    A given ``baseline`` is used whole and refused above ``MOST_BASELINE`` rows; the default is a
    sample of ``baseline_rows``. Each record draws its own orders from its key, at least ``orders``, and
    as many for each baseline row, so that for a linear model the mean is exact.
    """
    base_df = baseline if baseline is not None else sample_n(df, baseline_rows, key, seed)
    base = base_df.select(*[F.col(f"`{f}`").cast("double") for f in features]).limit(MOST_BASELINE + 1).toPandas().to_numpy()
    if not 0 < len(base) <= MOST_BASELINE:
        raise ValueError(f"the baseline needs 1 to {MOST_BASELINE} rows")
    d = len(features)
    orders = -(-orders // len(base)) * len(base)

    @F.pandas_udf("array<double>")
    def share(draw: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros_like(x)
        rows, seeds = np.arange(len(x)), draw.to_numpy().astype(np.uint64)
        for k in range(orders):
            order = np.argsort(_keys(seeds, k, d), axis=1)
            current = np.broadcast_to(base[k % len(base)], x.shape).copy()
            before = np.mean([logits(n, current) for n in nets], axis=0)
            for step in range(d):
                j = order[:, step]
                current[rows, j] = x[rows, j]
                after = np.mean([logits(n, current) for n in nets], axis=0)
                total[rows, j] += after - before
                before = after
        return pd.Series(list(total / orders))

    draw = F.xxhash64(F.lit(seed), F.col(key))
    scored = df.select(key, share(draw, *[F.col(f"`{f}`").cast("double") for f in features]).alias("_v"))
    names = F.array(*[F.lit(f) for f in features])
    return scored.select(key, F.posexplode("_v").alias("_i", "value")).select(
        key, F.element_at(names, F.col("_i") + 1).alias("feature"), "value"
    )


def importance(attribution: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (
        attribution.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature")
    )
