"""Occurrence files of many headers; stored models and splits."""

import datetime as dt
import glob
import time

import pytest
from pyspark.sql import functions as F

from habitat.config import LogitParams
from habitat.learning.logit import fit_logit, predict_probability
from habitat.operators.splits import split_rows
from habitat.session import CLEANUP, cut_lineage
from habitat.sources import tables

COLUMNS = ["occurrenceStatus", "year", "eventDate", "species", "decimalLatitude", "decimalLongitude"]


def write(path, order, rows, extra=()):
    lines = ["\t".join([*order, *extra])] + ["\t".join([str(r[c]) for c in order] + ["x" for _ in extra]) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def record(i):
    return {"occurrenceStatus": "PRESENT", "year": 2000 + i % 20, "eventDate": "2020-01-02", "species": f"s{i}", "decimalLatitude": 50 + i / 1000, "decimalLongitude": -1.5}


def test_one_read_for_each_header(spark, tmp_path):
    orders = [COLUMNS, COLUMNS[::-1], COLUMNS[2:] + COLUMNS[:2]]
    for i in range(60):
        write(tmp_path / f"file {i}.tsv", orders[i % 3], [record(i), record(100 + i)], ("note",) if i % 3 == 1 else ())
    (tmp_path / "empty.tsv").write_text("")
    paths = [str(tmp_path / f"file {i}.tsv") for i in range(60)] + [str(tmp_path / "empty.tsv")]
    groups = tables.files_by_header(spark, paths)
    assert len(groups) == 3 and sorted(len(g) for g in groups) == [20, 20, 20]
    out = tables.read_occurrences(spark, paths, with_file=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan csv") == 3
    got = {r.species: (r.year, r.decimalLatitude, r.decimalLongitude, r.file_name) for r in out.collect()}
    assert len(got) == 120 and got["s7"] == (2007, 50.007, -1.5, "file%207.tsv") and got["s159"][0] == 2019


def test_first_rows_of_each_file(spark, tmp_path):
    for i in range(2):
        write(tmp_path / f"{i}.tsv", COLUMNS, [record(10 * i + k) for k in range(5)])
    out = tables.read_occurrences(spark, [str(tmp_path / f"{i}.tsv") for i in range(2)], rows=2)
    assert sorted(r.species for r in out.collect()) == ["s0", "s1", "s10", "s11"]


def test_files_without_lines_are_an_empty_table(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("")
    out = tables.read_occurrences(spark, [str(tmp_path / n) for n in "ab"])
    assert out.columns == COLUMNS and out.count() == 0


def rows(spark):
    x = spark.range(200).select(F.col("id").alias("row_id"), (F.pmod(F.col("id") * 37, F.lit(101)) / 50 - 1).alias("a"), (F.pmod(F.col("id") * 53, F.lit(97)) / 48 - 1).alias("b"))
    return x.withColumn("label", (F.col("a") + 0.3 * F.col("b") > 0).cast("int"))


def test_stored_models_score_alike_and_keep_their_versions(spark, tmp_path):
    data, folder = rows(spark), str(tmp_path / "store")
    for n, c in enumerate((0.01, 1.0)):
        model = fit_logit(data, ["a", "b"], LogitParams(C=c))
        assert tables.save_model(model, folder, "linear", ["a", "b"], first=n == 0) == n + 1
    assert tables.save_model(model, folder, "other", ["a", "b"]) == 1
    want = {r.row_id: r.p for r in predict_probability(model, data, ["a", "b"]).collect()}
    got = tables.load_model(spark, folder, "linear").transform(data)
    assert all(want[r.row_id] == r.probability[1] for r in got.collect())
    old = tables.load_model(spark, folder, "linear", version=1).transform(data)
    assert any(want[r.row_id] != r.probability[1] for r in old.collect())
    assert tables.model_versions(spark, folder).count() == 3
    with pytest.raises(ValueError):
        tables.load_model(spark, folder, "linear", version=9)


def test_a_stored_split_is_joined_by_key(spark, tmp_path):
    data = split_rows(rows(spark))
    tables.save_split(data, str(tmp_path / "split"))
    more = data.drop("is_test").unionByName(spark.createDataFrame([(999, 0.0, 0.0, 1)], "row_id long, a double, b double, label int"))
    again = {r.row_id: r.is_test for r in tables.join_split(more, str(tmp_path / "split")).collect()}
    assert again.pop(999) is None and again == {r.row_id: r.is_test for r in data.collect()}


def test_stages_keep_their_types(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2), 0.1), (2, None, None)], "k long, day date, v double")
    tables.write_stage(df, str(tmp_path / "s.csv"), fmt="csv")
    assert sorted(map(tuple, tables.read_stage(spark, str(tmp_path / "s.csv"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_a_written_step_leaves_no_shuffle_files(spark):
    folders = list(spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    before, setting = files(), spark.conf.get(CLEANUP, None)
    table = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 7 and spark.conf.get(CLEANUP, None) == setting
