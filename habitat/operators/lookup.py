"""Key joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, results: DataFrame, key: str = "row_id") -> DataFrame:
    """Left join of per-record results; a record without one gets nulls."""
    return df.join(results, key, "left")


def lookup_first(df: DataFrame, ref: DataFrame, keys: list[str], value: str, order: str, default=None) -> DataFrame:
    """Value of the first reference row (by ``order``) with equal keys, else ``default``.

    The reference is cut to one row per key by a partial aggregation, so the join
    never multiplies rows. A null value of the first row stays null.
    """
    first = ref.groupBy(*keys).agg(F.min_by(F.struct(value), F.col(order)).alias("_first"))
    out = df.join(first, keys, "left")
    picked = F.when(F.col("_first").isNotNull(), F.col(f"_first.{value}"))
    if default is not None:
        picked = picked.otherwise(F.lit(default))
    return out.select(*df.columns, picked.alias(value))
