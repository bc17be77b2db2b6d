import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from habitat.operators import metrics


def boyce_by_hand(p, y, bins=10):
    p, y = np.array(p), np.array(y)
    if len(np.unique(p[y == 1])) < 2:
        return 0.0
    edges = np.linspace(p.min(), p.max(), bins + 1)
    one, zero = np.histogram(p[y == 1], edges)[0], np.histogram(p[y == 0], edges)[0]
    ok = zero > 0
    if ok.sum() < 2:
        return 0.0
    return float(np.corrcoef(((edges[:-1] + edges[1:]) / 2)[ok], one[ok] / zero[ok])[0, 1])


def auc_by_hand(p, y):
    one = [a for a, b in zip(p, y) if b]
    zero = [a for a, b in zip(p, y) if not b]
    if not one or not zero:
        return 0.0
    return sum((a > b) + (a == b) / 2 for a in one for b in zero) / len(one) / len(zero)


def cases():
    rng = random.Random(11)
    yield "spread", [(rng.random(), int(rng.random() < 0.4)) for _ in range(300)]
    yield "tied", [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(300)]
    yield "tiny", [(10 ** rng.uniform(-12, 0), int(rng.random() < 0.5)) for _ in range(200)]
    yield "ends", [(abs((k % 2) - 10.0 ** -rng.uniform(6, 16)), int(rng.random() < 0.5)) for k in range(200)]
    yield "above_one", [(rng.uniform(0.4, 9), int(rng.random() < 0.5)) for _ in range(200)]
    yield "near_one", [(1 - 10 ** rng.uniform(-12, 0), int(rng.random() < 0.5)) for _ in range(200)]
    yield "signed", [(rng.gauss(0, 1), int(rng.random() < 0.5)) for _ in range(200)] + [(0.0, 1), (-0.0, 0)]
    yield "powers", [(2.0 ** k, k % 2) for k in range(-20, 20)] * 2
    yield "tenths", [(k / 10, int(rng.random() < 0.5)) for k in range(11) for _ in range(9)]
    yield "one_class", [(rng.random(), 1) for _ in range(20)]
    yield "flat_presence", [(0.5, 1)] * 5 + [(rng.random(), 0) for _ in range(20)]
    yield "flat_ratio", [(k / 10 + 0.01, y) for k in range(10) for y in (0, 1)]
    yield "one_bin", [(0.0, 0), (0.0, 0), (0.95, 1), (1.0, 1)]


def test_auc_and_boyce_by_group(spark):
    data = dict(cases())
    rows = [(name, float(p), y) for name, values in data.items() for p, y in values]
    df = spark.createDataFrame(rows, "g string, p double, label int").repartition(5)
    auc = {r.g: r.auc for r in metrics.roc_auc(df, by=["g"]).collect()}
    boyce = {r.g: r.boyce for r in metrics.boyce_index(df, by=["g"]).collect()}
    assert set(auc) == set(boyce) == set(data)
    for name, values in data.items():
        p, y = zip(*values)
        assert auc[name] == pytest.approx(auc_by_hand(p, y), abs=1e-12), name
        assert boyce[name] == pytest.approx(boyce_by_hand(p, y), abs=1e-9, nan_ok=True), name
    turned = {r.g: r.auc for r in metrics.roc_auc(df.withColumn("p", -F.col("p")), by=["g"]).collect()}
    for name in data:
        if auc[name]:
            assert turned[name] == pytest.approx(1 - auc[name])


def test_auc_equals_built_in_evaluator(spark):
    rows = [(random.Random(i).random(), float(i % 3 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, ["p", "label"])
    built_in = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0).evaluate(df)
    assert metrics.roc_auc(df).first().auc == pytest.approx(built_in)


def test_merged(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 1), (0.1, 0), (0.6, 0)], ["p", "label"])
    one = metrics.evaluate(df).first()
    assert one.auc == 0.75 and one.auc_norm == 0.5
    row = metrics.merged_metric(spark.createDataFrame([(0.75, 0.5)], ["auc", "boyce"])).first()
    assert (row.auc_norm, row.boyce_norm, row.mixed) == (0.5, 0.75, 0.625)


def test_powerset(spark):
    assert list(metrics.subsets(["a", "b", "c"])) == ["a", "b", "c", "a+b", "a+c", "b+c", "a+b+c"]
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.5), *[rng.random() for _ in range(4)]) for i in range(120)]
    wide = spark.createDataFrame(rows, ["row_id", "label", "a", "b", "c", "d"])
    out = metrics.evaluate_ensembles(wide, list("abcd")).collect()
    assert len(out) == 15 and [r.mixed for r in out] == sorted((r.mixed for r in out), reverse=True)
    pair = next(r for r in out if r.ensemble == "a+c")
    mean = [(r[2] + r[4]) / 2 for r in rows]
    assert pair.auc == pytest.approx(auc_by_hand(mean, [r[1] for r in rows]))
    long = wide.unpivot(["row_id", "label"], list("abcd"), "model", "p")
    back = metrics.widen_scores(long, list("abcd"), ["row_id", "label"])
    assert back.exceptAll(wide).count() == 0


def test_report(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    out = {r["class"]: r for r in metrics.classification_report(spark.createDataFrame(rows, ["label", "prediction"])).collect()}
    assert out["a"].precision == 0.75 and out["a"].recall == 0.75 and out["a"].support == 4
    assert out["b"].precision == pytest.approx(2 / 3) and out["b"].recall == 1.0
    assert out["c"].f1 == 0.0 and out["accuracy"].f1 == pytest.approx(5 / 7)
    assert out["macro avg"].recall == pytest.approx(1.75 / 3) and out["weighted avg"].recall == pytest.approx(5 / 7)


def test_shares_and_correlations(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 2.0, 4.0), ("y", 3.0, 6.0)], ["k", "a", "probability"])
    assert {r.k: r.n for r in metrics.value_share(df, "k").collect()} == {"x": 2, "y": 1}
    assert [r.corr for r in metrics.corr_with(df).collect()] == pytest.approx([1.0, 1.0])
    flat = metrics.corr_with(df.withColumn("zero", F.lit(0))).collect()
    assert flat[-1].feature == "zero" and flat[-1]["corr"] is None


def test_no_window_spans_a_group_of_raw_scores(spark):
    """Running sums go over buckets, or over the scores of one bucket."""
    df = spark.createDataFrame([("g", 0.1, 1), ("g", 0.2, 0)], ["g", "p", "label"])
    plan = metrics.roc_auc(df, by=["g"])._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in plan.splitlines() if "Window" in line]
    assert len(specs) == 3 and all("_b#" in line or "_c#" in line for line in specs)


def test_scores_dealt_by_their_number(spark):
    """As many tasks as asked for order the scores, and the metrics stay the same."""
    data = dict(cases())
    df = spark.createDataFrame([(name, float(p), y) for name, values in data.items() for p, y in values], "g string, p double, label int")
    for metric in (metrics.roc_auc, metrics.boyce_index):
        dealt = metric(df, by=["g"], parts=37)
        assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
        name = dealt.columns[-1]
        got, plain = ({r.g: r[name] for r in df_.collect()} for df_ in (dealt, metric(df, by=["g"])))
        assert got == pytest.approx(plain, abs=1e-12, nan_ok=True) and set(got) == set(data)
    plan = metrics.roc_auc(df, by=["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
