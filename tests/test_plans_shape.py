"""What plans must not contain, whatever the data."""

import os
import re
from types import SimpleNamespace

import pytest

from __spark_entry__ import queries
from habitat import session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EAGER = {"logit_optimum", "class_shares", "grid_search", "ovr", "calibrate", "mlp_multiclass", "residual_mlp_train", "logit_fit",
         "grid_search_facts", "class_facts", "stored_models", "linear_ensemble"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not found")
@pytest.mark.parametrize("name", sorted(n for n in set(queries()) - EAGER if not re.match(r"op\d+_|pipeline$", n)))
def test_no_join_without_keys(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def fake_session(folder):
    context = SimpleNamespace(getCheckpointDir=lambda: None, applicationId="app-1")
    conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "hdfs:///warehouse"}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf[key] or default), sparkContext=context)


def test_the_named_folder_is_used(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_made", {})
    assert session.shared_folder(fake_session("hdfs:///shared/")) == "hdfs:///shared/habitat-app-1"
    assert session.shared_folder(fake_session(None)) == "hdfs:///warehouse/habitat-app-1"
    monkeypatch.setattr(session, "shared_folder", lambda s: str(tmp_path))
    out = session.cut_lineage(spark.range(5))
    assert out.count() == 5 and str(tmp_path) in out.inputFiles()[0]


def test_the_folder_goes_with_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_made", {str(tmp_path / "own"): spark})
    spark.range(3).write.parquet(str(tmp_path / "own" / "stage"))
    session._remove_folders()
    assert not (tmp_path / "own").exists() and tmp_path.exists()
