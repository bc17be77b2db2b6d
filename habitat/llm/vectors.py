"""What the two vector searches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v array<double>, dim): vectors without null or non-finite components; zero vectors only if ``zero``."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(~bad & (F.size("v") > 0))
    if not zero:
        out = out.filter(F.exists("v", lambda x: x != 0))
    return out.withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of one length as a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(array) == 0:
        return np.zeros((0, 0), dtype=kind)
    return array.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(array), -1)


def best(found: DataFrame, k: int, highest: bool) -> DataFrame:
    """(query_id, vec_id, score), copies merged, to the ``k`` best of each query with their rank; ties to the smaller id."""
    pairs = found.groupBy("query_id", "vec_id").agg((F.max if highest else F.min)("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc() if highest else F.col("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
