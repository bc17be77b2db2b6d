"""Training and evaluation for one species."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.config import DEEP_RUNS, ENV_VARS, SEED, SPECIES, TEST_SHARE, LogitParams, Species
from habitat.learning.logit import fit_logit, predict_probability
from habitat.learning.mlp import Network, fit_residual_mlp, score_column, score_models
from habitat.operators.encoding import bools_to_int, label_from_type
from habitat.operators.metrics import evaluate, evaluate_ensembles
from habitat.operators.splits import apply_scaler, fit_scaler, split_rows

NOT_FEATURES = {"row_id", "type", "label", "is_test", "decimalLatitude", "decimalLongitude"}


@dataclass
class Prepared:
    """Scaled table with ``label`` and ``is_test``, its scaler and feature order."""

    table: DataFrame
    scaler: DataFrame
    features: list[str]

    @property
    def train(self) -> DataFrame:
        return self.table.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.table.filter("is_test")


def prepare(df: DataFrame, env: list[str] = ENV_VARS, share: float = TEST_SHARE, seed: int = SEED) -> Prepared:
    """Label, split by hash, fit the scaler on training rows and apply it to all."""
    table = split_rows(bools_to_int(label_from_type(df)), "row_id", share, seed)
    scaler = fit_scaler(table.filter(~F.col("is_test")), env)
    table = apply_scaler(table, scaler)
    features = [c for c in table.columns if c not in NOT_FEATURES]
    return Prepared(table, scaler, features)


def train_linear(data: Prepared, species: str | Species | None = None, params: dict[str, LogitParams] | None = None) -> dict:
    """Fit the Boyce-tuned and the AUC-tuned model."""
    if params is None:
        spec = SPECIES[species] if isinstance(species, str) else species
        params = {"boyce": spec.boyce_params, "roc": spec.auc_params}
    return {name: fit_logit(data.train, data.features, p) for name, p in params.items()}


def evaluate_linear(data: Prepared, models: dict) -> DataFrame:
    """Test metrics of each model and of their mean: ``ensemble, auc, boyce, mixed``."""
    scored = data.test
    for name, model in models.items():
        scored = predict_probability(model, scored, data.features, f"p_{name}")
    return evaluate_ensembles(scored.withColumnsRenamed({f"p_{n}": n for n in models}), list(models))


def train_deep(data: Prepared, runs: tuple[str, ...] = DEEP_RUNS, choose_by_metric: bool = False, **options) -> dict[str, Network]:
    """The deep runs, named ``loss_metric``.

    By default both metrics of a loss give the same network, because the lowest
    training loss decides; it is then trained once. ``choose_by_metric`` lets the
    metric on the test rows decide.
    """
    nets: dict[str, Network] = {}
    for run in runs:
        loss, metric = run.split("_")
        same = next((n for r, n in nets.items() if r.startswith(f"{loss}_")), None)
        if same is not None and not choose_by_metric:
            nets[run] = same
            continue
        judge = None
        if choose_by_metric:
            column = {"boyce": "boyce", "roc": "auc"}[metric]

            def judge(net: Network, column: str = column) -> float:
                scored = data.test.select("label", score_column(net, data.features).alias("p"))
                return evaluate(scored).first()[column]

        nets[run] = fit_residual_mlp(data.train, data.features, loss=loss, select_by=judge, **options).network
    return nets


def evaluate_deep(data: Prepared, nets: dict[str, Network]) -> DataFrame:
    """All ensembles of the deep runs on the test rows, best first."""
    scored = score_models(data.test, nets, data.features, ["row_id", "label"])
    return evaluate_ensembles(scored, list(nets))
