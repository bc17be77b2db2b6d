"""Fixed values of the study: species, covariates, features, model settings."""

from __future__ import annotations

from dataclasses import dataclass

# Land-cover classes by pixel code; code 0 and every other code is Unknown.
LAND_COVER = {
    1: "Deciduous woodland",
    2: "Coniferous woodland",
    3: "Arable",
    4: "Improved grassland",
    5: "Neutral grassland",
    6: "Calcareous grassland",
    7: "Acid grassland",
    8: "Fen",
    9: "Heather",
    10: "Heather grassland",
    11: "Bog",
    12: "Inland rock",
    13: "Saltwater",
    14: "Freshwater",
    15: "Supralittoral rock",
    16: "Supralittoral sediment",
    17: "Littoral rock",
    18: "Littoral sediment",
    19: "Saltmarsh",
    20: "Urban",
    21: "Suburban",
}
UNKNOWN = "Unknown"

# Columns that are standardised.
ENV_VARS = ["BSI", "LST", "MNDWI", "NDBI", "NDSI", "NDVI", "NDWI", "SAVI", "UI"]

# Countries that form the national grid.
COUNTRIES = ["England", "Scotland", "Wales", "Northern Ireland"]

SEED = 42
TEST_SHARE = 0.2


@dataclass(frozen=True)
class LogitParams:
    """Settings of one logistic regression."""

    C: float = 1.0
    penalty: str = "l2"
    class_weight: str | None = None
    max_iter: int = 300
    l1_ratio: float = 0.5


@dataclass(frozen=True)
class Species:
    """What one target species needs: covariates, sites and stored choices."""

    name: str
    covariates: tuple[str, ...]
    wind_turbines: bool = False
    roads: bool = False
    boyce_params: LogitParams = LogitParams()
    auc_params: LogitParams = LogitParams()
    ensemble: tuple[str, ...] = ()

    @property
    def flags(self) -> list[str]:
        out = [f"{c}_presence" for c in self.covariates]
        if self.wind_turbines:
            out.append("wind_turbines_presence")
        if self.roads:
            out.append("near_road")
        return out


# The four deep runs are named loss_metric.
DEEP_RUNS = ("bce_boyce", "eps_boyce", "bce_roc", "eps_roc")

# Per-species covariates, stored best settings and chosen ensembles.
SPECIES = {
    s.name: s
    for s in (
        Species(
            "bat",
            ("ceratopogonidae", "chironomidae", "cats"),
            wind_turbines=True,
            roads=True,
            boyce_params=LogitParams(C=1, penalty="l2"),
            auc_params=LogitParams(C=0.1, penalty="l1"),
            ensemble=("bce_roc",),
        ),
        Species(
            "brown_hare",
            ("winter_wheat",),
            boyce_params=LogitParams(C=0.001, penalty="l1"),
            auc_params=LogitParams(C=100, penalty="l2"),
            ensemble=("bce_boyce", "bce_roc", "eps_roc"),
        ),
        Species(
            "dormice",
            ("hazel", "birch", "beech", "honeysuckle", "oak", "hawthorn"),
            boyce_params=LogitParams(C=100, penalty="l2", class_weight="balanced", max_iter=10000),
            auc_params=LogitParams(C=1, penalty="l1"),
            ensemble=DEEP_RUNS,
        ),
        Species(
            "hedgehog",
            ("badger", "ground_beetles"),
            roads=True,
            boyce_params=LogitParams(C=0.01, penalty="l1", class_weight="balanced"),
            auc_params=LogitParams(C=1, penalty="l2", class_weight="balanced"),
            ensemble=("eps_boyce", "bce_boyce"),
        ),
        Species(
            "red_squirrel",
            ("sitka_spruce", "grey_squirrel"),
            boyce_params=LogitParams(C=0.001, penalty="l2", class_weight="balanced"),
            auc_params=LogitParams(C=100, penalty="l1", class_weight="balanced"),
            ensemble=DEEP_RUNS,
        ),
    )
}

# Grid searched for the logistic models (the solver has no counterpart here).
LOGIT_GRID = {
    "C": [0.001, 0.01, 0.1, 1, 10, 100],
    "penalty": ["l2", "l1", "elasticnet", "none"],
    "max_iter": [300, 700, 1000, 10000],
    "class_weight": [None, "balanced"],
}
