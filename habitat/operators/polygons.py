"""Points inside polygons given as edge tables.

A polygon is turned into cell items: for every cell it meets, whether the
cell's reference point is inside, and the edges that pass the cell. A point
then looks only at its own cell: the state of the reference point, flipped once
for each edge between that point and itself. No point meets edges of other
cells, however detailed the polygon is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitat.operators.roads import ENDS, goes_on, segment_cells
from habitat.session import cut_lineage

# Place of the reference point in its cell; uneven, so that round vertices miss it.
REF_X, REF_Y = 0.41421356, 0.57735027


def load_polygon_edges(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(F.col("poly_id").isin(*names))


def _reference_states(edges: DataFrame, cell: float) -> DataFrame:
    """Cells (``poly_id``, ``cx``, ``cy``) whose reference point is inside.

    Per row of cells the edges cut the line through the reference points in a
    few places; between an odd cut and the next one lies the inside.
    """
    size = F.lit(float(cell))
    lo_y, hi_y = F.least("y1", "y2"), F.greatest("y1", "y2")

    def line_after(v: Column) -> Column:
        return F.ceil(v / size - F.lit(REF_Y)).cast("int")

    rows = edges.withColumns({"_r0": line_after(lo_y), "_r1": line_after(hi_y) - 1})
    rows = rows.filter(F.col("_r0") <= F.col("_r1")).withColumn("cy", F.explode(F.sequence("_r0", "_r1")))
    line = (F.col("cy") + F.lit(REF_Y)) * size
    cut = F.col("x1") + (line - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    # First column whose reference point is at or right of the cut.
    cuts = rows.withColumn("_c", F.ceil(cut / size - F.lit(REF_X)).cast("int"))
    # Two cuts between the same two reference points cancel, so a row holds at most
    # as many cuts as the polygon is cells wide.
    cuts = cuts.groupBy("poly_id", "cy", "_c").agg(F.count("*").alias("_n")).filter(F.col("_n") % 2 == 1)
    in_row = Window.partitionBy("poly_id", "cy").orderBy("_c")
    spans = cuts.withColumns({"_i": F.row_number().over(in_row), "_to": F.lead("_c").over(in_row)})
    spans = spans.filter((F.col("_i") % 2 == 1) & F.col("_to").isNotNull())
    return spans.select("poly_id", "cy", F.explode(F.sequence(F.col("_c"), F.col("_to") - 1)).alias("cx"))


def _polygon_items(edges: DataFrame, cell: float) -> DataFrame:
    inside = _reference_states(edges, cell).select("poly_id", "cx", "cy", *[F.lit(None).cast("double").alias(c) for c in ENDS])
    passing = segment_cells(edges, cell).select("poly_id", "cx", "cy", *ENDS)
    return inside.unionByName(passing)


def _crossings(px: Column, py: Column, cell: float) -> Column:
    """Times an edge is met on the way from the cell's reference point to the point.

    The way goes up or down first and then sideways; half-open comparisons count a
    shared vertex once.
    """
    size = F.lit(float(cell))
    rx, ry = (F.col("cx") + F.lit(REF_X)) * size, (F.col("cy") + F.lit(REF_Y)) * size
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    at_ref = y1 + (rx - x1) / F.when(x2 != x1, x2 - x1) * (y2 - y1)
    upright = ((x1 > rx) != (x2 > rx)) & ((at_ref > py) != (at_ref > ry))
    at_point = x1 + (py - y1) / F.when(y2 != y1, y2 - y1) * (x2 - x1)
    level = ((y1 > py) != (y2 > py)) & ((at_point > px) != (at_point > rx))
    return F.coalesce(upright, F.lit(False)).cast("int") + F.coalesce(level, F.lit(False)).cast("int")


def _odd(points: DataFrame, items: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """``keys`` and ``poly_id`` of the points (``_px``, ``_py`` in ``cx``, ``cy``) inside a polygon."""
    flips = F.when(F.col("x1").isNull(), F.lit(1)).otherwise(_crossings(F.col("_px"), F.col("_py"), cell))
    return (
        points.join(items, ["cx", "cy"])
        .groupBy(*keys, "poly_id")
        .agg(F.sum(flips).alias("_flips"))
        .filter(F.col("_flips") % 2 == 1)
        .select(*keys, "poly_id")
    )


def _finer(places: DataFrame, items: DataFrame, hot: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Cut crowded cells into 8 x 8; the smaller cells' reference points are tested like places."""
    fine = cell / 8
    items = items.join(hot, ["cx", "cy"])
    refs = hot.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumns(
        {"fx": F.col("cx") * 8 + F.pmod("_k", F.lit(8)), "fy": F.col("cy") * 8 + F.floor(F.col("_k") / 8).cast("int")}
    )
    refs = refs.withColumns({"_px": (F.col("fx") + REF_X) * F.lit(fine), "_py": (F.col("fy") + REF_Y) * F.lit(fine)})
    inside = _odd(refs, items, cell, ["fx", "fy"]).select(
        "poly_id", F.col("fx").alias("cx"), F.col("fy").alias("cy"), *[F.lit(None).cast("double").alias(c) for c in ENDS]
    )
    edges = items.filter(F.col("x1").isNotNull()).select("poly_id", *ENDS, F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    passing = segment_cells(edges, fine, within=("ox", "oy")).select("poly_id", "cx", "cy", *ENDS)

    def child(value: str, outer: str) -> Column:
        index = F.floor(F.col(value) / F.lit(fine)).cast("int")
        return F.least(F.greatest(index, F.col(outer) * 8), F.col(outer) * 8 + 7)

    places = places.join(hot, ["cx", "cy"]).select("_px", "_py", child("_px", "cx").alias("cx"), child("_py", "cy").alias("cy"))
    return places, inside.unionByName(passing)


def _inside_places(df: DataFrame, edges: DataFrame, x: str, y: str, cell: float, crowded: int) -> DataFrame:
    """Distinct places of ``df`` that lie in at least one polygon."""
    size = F.lit(float(cell))
    places = (
        df.select(F.col(x).alias("_px"), F.col(y).alias("_py"))
        .na.drop("any")
        .distinct()
        .withColumns({"cx": F.floor(F.col("_px") / size).cast("int"), "cy": F.floor(F.col("_py") / size).cast("int")})
    )
    # Copies of an edge cancel in pairs.
    odd = edges.groupBy("poly_id", *ENDS).agg(F.count("*").alias("_n")).filter(F.col("_n") % 2 == 1).drop("_n")
    items = _polygon_items(odd, cell)
    found, last = [], None
    # One aggregation over the edges tells whether any cell is crowded; mostly none is.
    counts = items.groupBy("cx", "cy").agg(F.count("*").alias("_n"))
    while goes_on(most := counts.agg(F.max("_n")).first()[0], crowded, last, cell):
        hot = counts.filter(F.col("_n") > crowded).select("cx", "cy")
        found.append(_odd(places.join(hot, ["cx", "cy"], "left_anti"), items, cell, ["_px", "_py"]))
        places, items = _finer(places, items, hot, cell)
        # What a level leaves is written, so the plan of the next one starts afresh.
        places, items = cut_lineage(places), cut_lineage(items)
        last, cell = most, cell / 8
        counts = items.groupBy("cx", "cy").agg(F.count("*").alias("_n"))
    found.append(_odd(places, items, cell, ["_px", "_py"]))
    return reduce(DataFrame.unionByName, found).select("_px", "_py").distinct()


def points_within(
    df: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", cell: float = 1000.0, crowded: int = 1024
) -> DataFrame:
    """Rows of ``df`` inside any polygon. Edges: ``poly_id, x1, y1, x2, y2``.

    Cells with more than ``crowded`` edges are cut into 8 x 8, as often as needed.
    """
    inside = _inside_places(df, edges, x, y, cell, crowded)
    return df.join(inside, (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py")), "left_semi")


def mask_outside(
    df: DataFrame,
    edges: DataFrame,
    column: str = "probability",
    x: str = "x",
    y: str = "y",
    cell: float = 1000.0,
    crowded: int = 1024,
) -> DataFrame:
    """Keep every row; ``column`` becomes null outside the polygons."""
    inside = _inside_places(df, edges, x, y, cell, crowded).withColumn("_inside", F.lit(True))
    joined = df.join(inside, (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py")), "left")
    masked = F.when(F.col("_inside"), F.col(column)).alias(column)
    return joined.select(*[masked if c == column else F.col(c) for c in df.columns])
