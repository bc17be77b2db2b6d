import datetime as dt
import json

from pyspark.sql import functions as F

from habitat.config import LAND_COVER, SPECIES
from habitat.operators import cleaning, encoding, lookup, splits
from habitat.sources import tables

HEADER = "gbifID\tspecies\toccurrenceStatus\tdecimalLatitude\tdecimalLongitude\teventDate\tyear\n"
LINES = [
    "1\tA\tPRESENT\t51.0\t-1.0\t2023-05-01\t2023",
    "2\tA\tABSENT\t51.0\t-1.0\t2023-05-01\t2023",
    "3\tA\tPRESENT\t51.0\t-1.0\t2021-05-01\t2021",
    "4\tA\tPRESENT\t51.0\t-1.0\t2023-05-01T10:00\t2023",
    "5\tA\tPRESENT\t\t-1.0\t2023-05-01\t2023",
    "6\tA\tPRESENT\t51.0\t-1.0\t2023-5-1\t2023",
    '7\tA "quoted\tPRESENT\t51.0\t-1.0\t2022-01-01\t2022',
]


def test_read_and_clean(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER + "\n".join(LINES) + "\n")
    rows = cleaning.clean_occurrences(tables.read_occurrences(spark, str(path))).collect()
    assert sorted(r.species for r in rows) == ["A", 'A "quoted']
    assert {r.eventDate for r in rows} == {dt.date(2023, 5, 1), dt.date(2022, 1, 1)}
    assert tables.read_occurrences(spark, str(path), rows=3).count() == 3


def test_files_with_other_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + LINES[0] + "\n")
    (tmp_path / "b.csv").write_text(
        "year\teventDate\tspecies\toccurrenceStatus\tdecimalLongitude\tdecimalLatitude\n2024\t2024-01-02\tB\tPRESENT\t-2.0\t52.0\n"
    )
    out = cleaning.clean_occurrences(
        tables.read_occurrences(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], with_file=True), extra=("file_name",)
    )
    got = {r.file_name: (r.species, r.decimalLatitude) for r in out.collect()}
    assert got == {"a.csv": ("A", 51.0), "b.csv": ("B", 52.0)}


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "occ")
    df = spark.createDataFrame([("PRESENT", 2023, "2023-01-01", "A", 1.0, 2.0, "x")],
                               "occurrenceStatus string, year int, eventDate string, species string, decimalLatitude double, decimalLongitude double, other string")
    tables.write_stage(df, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = cleaning.clean_occurrences(tables.read_stage(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(occurrenceStatus,PRESENT)" in plan and "GreaterThanOrEqual(year,2022)" in plan
    assert "other" not in plan.split("ReadSchema")[1]


def test_predicate_request(spark):
    df = spark.createDataFrame(
        [("PRESENT", "GB", "x", 2023), ("PRESENT", "GB", "y", 2023), ("PRESENT", "FR", "x", 2023), ("PRESENT", "GB", "x", 2021)],
        ["occurrenceStatus", "countryCode", "scientificName", "year"],
    )
    request = json.dumps({"format": "SIMPLE", "predicate": {"type": "and", "predicates": [
        {"type": "equals", "key": "OCCURRENCE_STATUS", "value": "PRESENT"},
        {"type": "in", "key": "COUNTRY", "values": ["GB"]},
        {"type": "in", "key": "SCIENTIFIC_NAME", "values": ["x", "z"]},
        {"type": "greaterThanOrEquals", "key": "YEAR", "value": "2022"},
    ]}})
    assert [tuple(r) for r in cleaning.predicate_filter(df, request).collect()] == [("PRESENT", "GB", "x", 2023)]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], ["x", "y"])
    b = spark.createDataFrame([(3,)], ["x"])
    rows = {r.type: (r.x, r.y) for r in cleaning.label_union(a, b).collect()}
    assert rows == {"presence": (1, 2), "background": (3, None)}


def test_null_and_nan_and_duplicates_go(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (float("nan"), "a"), (None, "a"), (2.0, None)], ["x", "y"])
    assert [tuple(r) for r in cleaning.drop_null_and_duplicate(df).collect()] == [(1.0, "a")]


def test_near_flag_edges(spark):
    df = spark.createDataFrame([(500.0,), (500.1,), (None,)], "distance_to_road double")
    assert [r.near_road for r in cleaning.near_flag(df).collect()] == [1, 0, 0]


def test_one_hot_rows_sum_to_one_and_decode(spark):
    df = spark.createDataFrame([(c,) for c in LAND_COVER.values()], ["Land_cover"])
    hot = encoding.bools_to_int(encoding.one_hot(df))
    assert len(hot.columns) == 21
    assert all(sum(r) == 1 for r in hot.collect())
    back = {r[0] for r in encoding.one_hot_decode(hot).select("Land_cover").collect()}
    assert back == set(LAND_COVER.values())


def test_land_cover_name(spark):
    df = spark.createDataFrame([(0,), (1,), (21,), (22,), (None,)], "k int")
    names = [r[0] for r in df.select(encoding.land_cover_name(F.col("k"))).collect()]
    assert names == ["Unknown", "Deciduous woodland", "Suburban", "Unknown", "Unknown"]


def test_align(spark):
    df = spark.createDataFrame([(1, 2, True)], ["id", "extra", "b"])
    out = encoding.align_features(df, ["b", "gone"], keep=["id"])
    assert out.columns == ["id", "b", "gone"] and tuple(out.first()) == (1, 1.0, 0.0)


def test_lookup_first_keeps_first_and_default(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], ["k"])
    ref = spark.createDataFrame([(1, 10.0, 2), (1, 20.0, 1), (2, None, 1), (2, 5.0, 2)], "k int, v double, o int")
    got = {r.k: r.v for r in lookup.lookup_first(left, ref, ["k"], "v", "o", default=0.0).collect()}
    assert got == {1: 20.0, 2: None, 3: 0.0}


def test_split_is_stable_and_about_a_fifth(spark):
    df = spark.range(10000).withColumnRenamed("id", "row_id")
    a = splits.split_rows(df).filter("is_test")
    assert a.count() == 1987
    assert a.repartition(7).exceptAll(splits.split_rows(df.repartition(3)).filter("is_test")).count() == 0


def test_scaler(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 10.0, 1.0), ("b", 30.0, 2.0)], ["g", "x", "y"])
    params = splits.fit_scaler(df, ["x", "y"])
    out = splits.apply_scaler(df, params).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(out[0]) < 1e-12 and abs(out[1] - 1) < 1e-12
    constant = df.filter("g = 'a'")
    assert {r.y for r in splits.apply_scaler(constant, splits.fit_scaler(constant, ["y"])).collect()} == {0.0}
    by = splits.apply_scaler(df, splits.fit_scaler(df, ["x", "y"], by=["g"]), by=["g"])
    assert sorted((r.g, r.x) for r in by.collect()) == [("a", -1.0), ("a", 1.0), ("b", -1.0), ("b", 1.0)]


def test_scaler_and_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (3.0,)], ["x"])
    tables.save_scaler(splits.fit_scaler(df, ["x"]), str(tmp_path / "s"))
    row = tables.load_scaler(spark, str(tmp_path / "s")).first()
    assert (row.feature, row["mean"], row["std"]) == ("x", 2.0, 1.0)
    tables.write_stage(df, str(tmp_path / "c"), fmt="csv")
    assert tables.read_stage(spark, str(tmp_path / "c"), df.schema).count() == 2


def test_species_table():
    assert SPECIES["bat"].flags == [
        "ceratopogonidae_presence", "chironomidae_presence", "cats_presence", "wind_turbines_presence", "near_road"
    ]
    assert SPECIES["hedgehog"].flags == ["badger_presence", "ground_beetles_presence", "near_road"]
    assert len(SPECIES) == 5
