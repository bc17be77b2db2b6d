"""Point lattices and resampling of lattice values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitat.functions.projection import bng_to_wgs84
from habitat.operators.polygons import load_polygon_edges, points_within


def lattice(spark: SparkSession, extent: tuple[float, float, float, float], step: float = 1000.0) -> DataFrame:
    """Points from the lower bounds up to, not including, the upper bounds."""
    min_x, min_y, max_x, max_y = (float(v) for v in extent)
    nx = max(0, math.ceil((max_x - min_x) / step))
    ny = max(0, math.ceil((max_y - min_y) / step))
    points = spark.range(nx * ny)
    x = F.lit(min_x) + F.pmod(F.col("id"), F.lit(max(nx, 1))) * F.lit(float(step))
    y = F.lit(min_y) + F.floor(F.col("id") / F.lit(max(nx, 1))) * F.lit(float(step))
    return points.select(F.col("id").alias("row_id"), x.alias("x"), y.alias("y"))


def edge_extent(edges: DataFrame) -> tuple[float, float, float, float]:
    row = edges.agg(
        F.min(F.least("x1", "x2")).alias("a"),
        F.min(F.least("y1", "y2")).alias("b"),
        F.max(F.greatest("x1", "x2")).alias("c"),
        F.max(F.greatest("y1", "y2")).alias("d"),
    ).first()
    return tuple(row)


def national_grid(
    spark: SparkSession, edges: DataFrame, step: float = 1000.0, cell: float = 1000.0, names: list[str] | None = None
) -> DataFrame:
    """Lattice points inside the polygons, or those named, as ``longitude, latitude``."""
    edges = edges if names is None else load_polygon_edges(edges, names)
    points = points_within(lattice(spark, edge_extent(edges), step), edges, cell=cell)
    return bng_to_wgs84(points, "x", "y").select("row_id", "longitude", "latitude")


def resample_grid(
    df: DataFrame,
    value: str = "probability",
    x: str = "x",
    y: str = "y",
    origin: tuple[float, float] = (0.0, 0.0),
    spacing: float = 1000.0,
    step: float = 500.0,
    closed: bool = False,
) -> DataFrame:
    """Linear resample of lattice values to a finer lattice.

    Targets run from the least coordinates up to the largest, which they reach only if ``closed``.

    Each node is sent to the up to four lattice cells it is a corner of; a cell then
    writes its own targets. A target needs every corner that carries weight; with one
    corner missing, targets on the triangle of the other three are still linear.
    """
    factor = round(spacing / step)
    if factor < 1 or abs(factor * step - spacing) > 1e-9 * spacing:
        raise ValueError("spacing must be a whole multiple of step")
    i = F.round((F.col(x) - F.lit(float(origin[0]))) / F.lit(float(spacing))).cast("long")
    j = F.round((F.col(y) - F.lit(float(origin[1]))) / F.lit(float(spacing))).cast("long")
    corners = [(0, 0), (1, 0), (0, 1), (1, 1)]
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in corners]))
    nodes = df.filter(F.col(value).isNotNull()).select(i.alias("_i"), j.alias("_j"), F.col(value).alias("_v"))
    cells = (
        nodes.withColumn("_k", moves)
        .groupBy((F.col("_i") - F.col("_k.a")).alias("_ci"), (F.col("_j") - F.col("_k.b")).alias("_cj"))
        .agg(
            *[
                F.max(F.when((F.col("_k.a") == a) & (F.col("_k.b") == b), F.col("_v"))).alias(f"_f{a}{b}")
                for a, b in corners
            ]
        )
    )
    inner = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1)))
    cells = cells.withColumn("_t", inner).withColumns(
        {
            "_u": F.pmod(F.col("_t"), F.lit(factor)) / F.lit(float(factor)),
            "_w": F.floor(F.col("_t") / F.lit(factor)) / F.lit(float(factor)),
        }
    )
    u, w = F.col("_u"), F.col("_w")
    f00, f10, f01, f11 = (F.col(f"_f{a}{b}") for a, b in corners)

    def share(weight: Column, corner: Column) -> Column:
        return F.when(weight > 0, weight * corner).otherwise(F.lit(0.0))

    one = F.lit(1.0)
    bilinear = (
        share((one - u) * (one - w), f00) + share(u * (one - w), f10) + share((one - u) * w, f01) + share(u * w, f11)
    )
    planar = (
        F.when(f11.isNull() & (u + w <= 1), f00 + u * (f10 - f00) + w * (f01 - f00))
        .when(f00.isNull() & (u + w >= 1), f11 + (one - u) * (f01 - f11) + (one - w) * (f10 - f11))
        .when(f10.isNull() & (u <= w), f01 + u * (f11 - f01) + (one - w) * (f00 - f01))
        .when(f01.isNull() & (u >= w), f10 + (one - u) * (f00 - f10) + w * (f11 - f10))
    )
    if not closed:
        ends = df.agg((F.max(i) * factor).alias("x"), (F.max(j) * factor).alias("y"))
        column, row = F.col("_ci") * factor + F.pmod("_t", F.lit(factor)), F.col("_cj") * factor + F.floor(F.col("_t") / F.lit(factor))
        cells = cells.filter((column < ends.select("x").scalar()) & (row < ends.select("y").scalar()))
    out = cells.select(
        (F.lit(float(origin[0])) + (F.col("_ci") + u) * F.lit(float(spacing))).alias("x"),
        (F.lit(float(origin[1])) + (F.col("_cj") + w) * F.lit(float(spacing))).alias("y"),
        F.coalesce(bilinear, planar).alias(value),
    )
    return out.filter(F.col(value).isNotNull())
