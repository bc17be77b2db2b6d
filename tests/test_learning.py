import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from habitat.config import LOGIT_GRID, LogitParams
from habitat.learning import attribution, logit, mlp, mlp_many, multiclass
from habitat.operators import metrics
from habitat.sources import tables

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x = [rng.gauss(0, 1) for _ in NAMES]
        rows.append((i, int(2 * x[0] - x[1] + rng.gauss(0, 1) > 0), *x))
    return spark.createDataFrame(rows, ["row_id", "label", *NAMES]).cache()


def test_logit_reaches_the_optimum(spark, data):
    """The gradient of mean loss + penalty vanishes at the fit."""
    params = LogitParams(C=0.5, class_weight="balanced", max_iter=500)
    model = logit.fit_logit(data, NAMES, params)
    w, b = logit.coefficients(model)
    rows = np.array(data.select("label", *NAMES).collect(), dtype=float)
    y, x = rows[:, 0], rows[:, 1:]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ np.array(w) + b)))
    gradient = 0.5 * ((p - y) * weight) @ x + np.array(w)
    assert np.abs(gradient).max() < 0.05
    scored = logit.predict_probability(model, data, NAMES)
    direct = data.select("row_id", logit.sigmoid(logit.linear_logit(w, b, NAMES)).alias("q"))
    assert scored.join(direct, "row_id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    assert metrics.roc_auc(scored).first().auc > 0.9


def test_l1_drops_the_idle_feature(spark, data):
    w, _ = logit.coefficients(logit.fit_logit(data, NAMES, LogitParams(C=0.03, penalty="l1")))
    assert w[2] == 0.0 and w[0] > 0


def test_grid(spark, data):
    assert len(logit.expand_grid(LOGIT_GRID)) == 192
    settings = [LogitParams(C=1e-6, penalty="l1"), LogitParams(C=1.0)]
    best, table = logit.grid_search(data, NAMES, settings, "roc_auc", folds=3)
    rows = table.collect()
    assert best == settings[1] and rows[0].score > 0.9 and rows[1].score == pytest.approx(0.5)
    assert logit.grid_search(data, NAMES, settings[1:], "boyce", folds=3)[0] == settings[1]


@pytest.mark.parametrize("penalty", ["l2", "l1", "elasticnet", "none"])
@pytest.mark.parametrize("class_weight", [None, "balanced"])
def test_side_by_side_fits_equal_single_ones(data, penalty, class_weight):
    params = LogitParams(C=0.05, penalty=penalty, class_weight=class_weight, max_iter=1000)
    rows = data.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    train = rows.filter("fold != 1")
    fit = logit._fit_of(params, 1, logit.class_counts(train), [1000])
    logit.fit_many(rows, NAMES, "label", [fit])
    w, b = logit.coefficients(logit.fit_logit(train, NAMES, params))
    assert fit.iterations < 50 and np.abs(fit.at[1000] - [*w, b]).max() < 2e-3


def test_settings_of_one_model_share_a_fit(data, monkeypatch):
    """192 settings are 38 models; each setting keeps its own row, and equal models score alike."""
    seen, plain = [], logit.fit_many
    monkeypatch.setattr(logit, "fit_many", lambda d, f, lab, fits: (seen.extend(fits), plain(d, f, lab, fits)))
    _, table = logit.grid_search(data, NAMES, folds=2)
    rows = table.collect()
    assert len(seen) == 38 * 2 and {s for f in seen for s in f.stops} == {300, 700, 1000, 10000}
    assert sorted(r.setting for r in rows) == list(range(192))
    assert len({r.score for r in rows if r.penalty == "none" and r.class_weight is None}) == 1


def test_the_queries_do_the_whole_job(spark, monkeypatch):
    """All settings of the grid, and the network's own size, length and partitions."""
    from habitat.catalog import queries

    monkeypatch.setattr(queries, "_linear_table", lambda *a: spark.range(4).withColumn("is_test", F.col("id") > 2))
    calls = {}
    monkeypatch.setattr(logit, "grid_search", lambda *a, **k: (calls.update(grid=(a[2:], k)), (None, None))[1])
    queries.grid_search(spark, "")
    monkeypatch.setattr(mlp, "fit_residual_mlp", lambda *a, **k: calls.update(mlp=(a[2:], k)) or mlp.Training(None, 0, 0.0, []))
    monkeypatch.setattr(mlp, "score_residual_mlp", lambda *a: spark.createDataFrame([(1, 0, 0.5)], "row_id long, label int, p double"))
    queries.residual_mlp_train(spark, "")
    assert calls == {"grid": ((), {}), "mlp": ((), {})}


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    net = mlp.new_network(3, hidden=4, residual=2, seed=3)
    x, y = rng.normal(size=(6, 3)), np.array([0, 1, 0, 1, 1, 0.0])
    for loss in mlp.LOSSES:
        _, g = mlp.gradient(net, x, y, loss)
        flat = net.flat()
        for k in range(0, len(flat), 5):
            step = np.zeros_like(flat)
            step[k] = 1e-6
            up, down = (mlp.gradient(mlp.unflatten(flat + s, net.shapes), x, y, loss)[0] / 6 for s in (step, -step))
            assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("loss,partitions", [("bce", 1), ("eps", 3)])
def test_training_learns_and_repeats(spark, data, loss, partitions):
    options = dict(loss=loss, hidden=8, epochs=12, partitions=partitions, lr=5e-3)
    run = mlp.fit_residual_mlp(data, NAMES, **options)
    assert run.history[-1] < run.history[0] * 0.8 and run.loss == min(run.history)
    assert metrics.roc_auc(mlp.score_residual_mlp(data, run.network, NAMES)).first().auc > 0.9
    again = mlp.fit_residual_mlp(data.repartition(7), NAMES, **options)
    assert np.allclose(run.network.flat(), again.network.flat())


def test_a_round_of_training_is_one_stage(spark, data):
    """No shuffle files are written round by round, and batches run across blocks."""
    sc, seen = spark.sparkContext, []

    def judge(net):
        jobs = sc.statusTracker().getJobIdsForGroup("rounds")
        seen.append({j: len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs})
        return 0.0

    sc.setJobGroup("rounds", "rounds")
    try:
        mlp.fit_residual_mlp(data, NAMES, hidden=4, epochs=3, partitions=2, select_by=judge)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    last = sorted(set(seen[2]) - set(seen[1]))
    # The shuffle of the rows before the first round is a stage that is skipped.
    assert len(last) == 1 and seen[2][last[0]] <= 2
    blocks = [np.arange(n * 2.0).tobytes() for n in (3, 0, 7, 1)]
    sizes = [len(y) for _, y in mlp._batches(iter(blocks), 2, 4)]
    assert sizes == [4, 4, 3]


def test_steps_in_place_are_those_of_adam():
    rng = np.random.default_rng(1)
    net = mlp.new_network(3, hidden=4, residual=1, seed=5)
    x, y = rng.normal(size=(8, 3)), rng.integers(0, 2, 8).astype(float)
    state = np.concatenate([net.flat(), np.zeros(2 * len(net.flat()))])
    theta, m, v = np.split(state.copy(), 3)
    for t in (1, 2):
        g = mlp.gradient(mlp.unflatten(theta, net.shapes), x, y, "bce")[1] + 0.01 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got, _, rows = mlp._local_epoch(state, net.shapes, 0, [(x, y), (x, y)], "bce", 0.1, 0.01)
    assert rows == 16 and np.allclose(got, np.concatenate([theta, m, v]), rtol=1e-12, atol=1e-15)


def test_early_stop_and_choice_by_metric(spark, data):
    run = mlp.fit_residual_mlp(data, NAMES, hidden=4, epochs=30, patience=1, lr=0.0, partitions=1)
    assert run.epochs == 2
    scores = iter([1.0, 3.0, 2.0])
    chosen = mlp.fit_residual_mlp(data, NAMES, hidden=4, epochs=3, partitions=1, select_by=lambda net: next(scores))
    assert chosen.loss == chosen.history[1]


def test_weights_round_trip_and_joint_scoring(spark, data, tmp_path):
    nets = {"m1": mlp.new_network(3, 4, 2, 1), "m2": mlp.new_network(3, 5, 1, 2)}
    tables.save_weights(mlp.weights_table(spark, nets), str(tmp_path / "w"))
    back = mlp.networks_from_table(tables.load_weights(spark, str(tmp_path / "w")))
    assert all(np.array_equal(nets[k].flat(), back[k].flat()) for k in nets)
    both = mlp.score_models(data, back, NAMES, ["row_id"]).orderBy("row_id").collect()
    alone = mlp.score_residual_mlp(data, nets["m2"], NAMES).orderBy("row_id").collect()
    assert [r.m2 for r in both] == pytest.approx([r.p for r in alone])


def test_attribution_adds_up_and_matches_the_linear_case(spark, data):
    weights = [1.0, -2.0, 0.5]
    linear = mlp.Network([(np.hstack([np.eye(3), -np.eye(3)]), np.zeros(6)), (np.array([[w] for w in weights + [-w for w in weights]]), np.zeros(1))])
    one = data.filter("row_id < 20")
    baseline = data.filter("row_id = 30")
    got = attribution.shapley(one, [linear, linear], NAMES, orders=3, baseline=baseline)
    base = baseline.first()
    for r in got.join(one, "row_id").collect():
        k = NAMES.index(r.feature)
        assert r.value == pytest.approx(weights[k] * (r[r.feature] - base[r.feature]))
    exact = logit.linear_attribution(one, weights, NAMES)
    assert abs(exact.agg(F.sum("value")).first()[0]) < 1e-9
    order = [r.feature for r in attribution.importance(got).collect()]
    assert order[0] == "b" and metrics.top_features(attribution.importance(got), 1).first().feature == "b"


def test_attribution_takes_the_whole_baseline(spark):
    """Mean over all 100 baseline rows, whatever their order; a baseline beyond the limit is refused."""
    one = mlp.Network([(np.array([[1.0, -1.0]]), np.zeros(2)), (np.array([[1.0], [-1.0]]), np.zeros(1))])
    rows = spark.createDataFrame([(1, 1.0)], ["row_id", "a"])
    baseline = spark.range(100).select(F.col("id").cast("double").alias("a"))
    assert attribution.shapley(rows, [one], ["a"], orders=3, baseline=baseline).first().value == pytest.approx(-48.5)
    with pytest.raises(ValueError):
        attribution.shapley(rows, [one], ["a"], baseline=spark.range(1001).select(F.col("id").alias("a")))


def test_multiclass_ovr_and_calibration(spark):
    rng = random.Random(4)
    rows = [(i, "xyz"[i % 3], *[rng.gauss(3.0 * (i % 3 == k), 1) for k in range(3)]) for i in range(150)]
    df, classes = multiclass.index_classes(spark.createDataFrame(rows, ["row_id", "species", *NAMES]), "species")
    assert classes == ["x", "y", "z"]
    scored = multiclass.predict_classes(multiclass.fit_mlp_multiclass(df, NAMES, 3, hidden=6, max_iter=60), df, NAMES)
    report = {r["class"]: r.f1 for r in metrics.classification_report(scored).collect()}
    assert report["accuracy"] > 0.85
    cal = multiclass.apply_calibration(scored, multiclass.calibrate_sigmoid(scored, 3)).collect()
    assert all(sum(r.probabilities) == pytest.approx(1.0) for r in cal)
    assert sum(r.prediction == r.label for r in cal) > 120
    ovr = multiclass.predict_ovr(multiclass.fit_ovr(df, NAMES, 3, hidden=4, max_iter=40), df, NAMES).collect()
    assert all(sum(r.probabilities) == pytest.approx(1.0) for r in ovr)
    assert sum(r.prediction == r.label for r in ovr) > 120


def test_hidden_layer_gradient():
    rng = np.random.default_rng(5)
    shape = mlp_many.Shape(3, 4, 2)
    table = np.column_stack([rng.normal(size=(300, 3)), rng.integers(0, 3, 300)]).astype(np.float32)
    flats = [shape.start(1), shape.start(2)]
    _, slopes = mlp_many.loss_and_gradient(shape, flats, [0, 2], table)
    for k in range(2):
        for j in range(0, shape.size, 3):
            up, down = (mlp_many.loss_and_gradient(shape, [f + (np.arange(shape.size) == j) * e for f in flats], [0, 2], table)[0][k] for e in (1e-2, -1e-2))
            assert slopes[k][j] == pytest.approx((up - down) / 2e-2, abs=0.05)


def test_ovr_passes_do_not_grow_with_the_classes(spark, monkeypatch):
    """All classes are fitted in the same passes over the rows, each as if it were alone."""
    rng = random.Random(4)
    rows = [(i, float(i % 6), *[rng.gauss(3.0 * (i % 3 == k) + i % 2, 1) for k in range(3)]) for i in range(180)]
    df = spark.createDataFrame(rows, ["row_id", "label", *NAMES])
    passes, inner = [], mlp_many._sums
    monkeypatch.setattr(mlp_many, "_sums", lambda *a: passes.append(1) or inner(*a))
    six = multiclass.fit_ovr(df, NAMES, 6, hidden=4, max_iter=15)
    assert len(six) == 6 and len(passes) <= 40
    alone = mlp_many.fit_many(df, NAMES, "label", 2, [4], 4, 15, 1)[0]
    assert np.allclose(six[4].flat(), alone.flat(), rtol=1e-3, atol=1e-3)
    with pytest.raises(Exception, match="null or NaN"):
        multiclass.fit_ovr(df.withColumn("a", F.when(F.col("row_id") > 0, F.col("a"))), NAMES, 6)


def test_sums_of_many_partitions_are_added_in_groups(spark):
    parts = spark.sparkContext.parallelize(range(100), 40).mapPartitions(lambda rows: [(len(v), np.array([float(sum(v))])) for v in [list(rows)]])
    found = mlp_many.in_order(parts)
    assert len(found) <= 7 and sum(n for n, _ in found) == 100 and sum(v for _, v in found) == 4950


def test_training_state_is_single_and_averaged_without_loss(spark, data, monkeypatch):
    states, before = [], mlp._round
    monkeypatch.setattr(mlp, "_round", lambda *a: states.append(a[3]) or before(*a))
    run = mlp.fit_residual_mlp(data, NAMES, hidden=100, epochs=2, partitions=3, lr=0.0)
    start = mlp.new_network(len(NAMES), 100).flat().astype(np.float32)
    assert [s.dtype for s in states] == [np.float32] * 2 and len(start) > mlp.STRIP
    assert np.array_equal(states[1][: len(start)], start) and np.array_equal(run.network.flat(), start)
