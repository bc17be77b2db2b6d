"""Scoring of the national grid and the finer map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.config import SPECIES, Species
from habitat.functions.projection import to_bng
from habitat.learning.mlp import Network, score_models
from habitat.operators.encoding import align_features, bools_to_int, cast_flags, one_hot
from habitat.operators.grid import resample_grid
from habitat.operators.metrics import corr_with
from habitat.operators.polygons import mask_outside
from habitat.operators.splits import apply_scaler
from habitat.plans.enrich import LAT, LON, Layers, enrich

GRID_DATE = "2025-06-01"


def grid_records(grid: DataFrame, date: str = GRID_DATE) -> DataFrame:
    """Grid points as records of one fixed date."""
    return grid.withColumnsRenamed({"longitude": LON, "latitude": LAT}).withColumn("eventDate", F.lit(date).cast("date"))


def grid_features(
    grid: DataFrame, species: str | Species, layers: Layers, scaler: DataFrame, features: list[str],
    date: str = GRID_DATE, window: int | None = 100, km: float = 1.0,
) -> DataFrame:
    """Enriched, encoded and scaled grid with exactly the training columns."""
    spec = SPECIES[species] if isinstance(species, str) else species
    out = enrich(grid_records(grid, date), spec, layers, window, km=km)
    out = bools_to_int(one_hot(cast_flags(out.dropDuplicates(), spec.flags), "Land_cover"))
    return align_features(apply_scaler(out, scaler), features, keep=["row_id", LAT, LON])


def score_grid(table: DataFrame, nets: dict[str, Network], features: list[str], chosen: tuple[str, ...]) -> DataFrame:
    """Add ``probability``: the mean of the chosen models."""
    picked = {n: nets[n] for n in chosen}
    scored = score_models(table, picked, features, table.columns)
    total = sum((F.col(n) for n in chosen[1:]), F.col(chosen[0]))
    return scored.withColumn("probability", total / F.lit(float(len(chosen)))).drop(*chosen)


def probability_map(
    results: DataFrame, edges: DataFrame, origin: tuple[float, float], spacing: float = 1000.0, step: float = 500.0
) -> DataFrame:
    """Finer map in grid metres; cells outside the polygons are null.

    ``origin`` is any node of the lattice the results lie on.
    """
    points = to_bng(results, LON, LAT, "x", "y")
    return mask_outside(resample_grid(points, "probability", "x", "y", origin, spacing, step), edges, cell=spacing)


def feature_correlations(results: DataFrame) -> DataFrame:
    return corr_with(results.drop("row_id", LAT, LON, "eventDate"), "probability")
