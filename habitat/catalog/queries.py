"""Named queries: one or more per operator, over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from habitat.catalog import inputs as I
from habitat.config import ENV_VARS, LAND_COVER, LogitParams, Species
from habitat.functions import geo, losses, spectral
from habitat.functions.projection import bng_to_wgs84, to_bng, to_irish_grid
from habitat.learning import attribution, logit, mlp, multiclass
from habitat.operators import cleaning, encoding, grid, lookup, metrics, polygons, radius, raster, roads, scenes, splits
from habitat.plans import enrich, score_grid, train
from habitat.session import shared_folder
from habitat.sources import tables

REQUEST = {
    "predicate": {
        "type": "and",
        "predicates": [
            {"type": "equals", "key": "STATUS", "value": "F"},
            {"type": "in", "key": "PRIORITY", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]},
            {"type": "greaterThanOrEquals", "key": "YEAR", "value": "1997"},
        ],
    }
}
COVER_COLUMNS = [f"Land_cover_{v}" for v in sorted(LAND_COVER.values())]
COUNTRIES = ["NATION_1", "NATION_2", "NATION_5", "NATION_9"]
LINEAR_WEIGHTS = [0.5, -1.0, 0.25, 2.0, -0.75, 1.5, -0.1, 0.3, 1.0]


# --- cleaning and encoding ---------------------------------------------------

def occurrence_clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_occurrences(I.raw_occurrences(spark, sf), min_year=1997, extra=("row_id",))


def occurrence_count_since(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.clean_occurrences(I.raw_occurrences(spark, sf), min_year=None)
    return out.filter(F.year("eventDate") >= 1999).agg(F.count("*").alias("n"))


def operational_sites(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.operational_sites(I.site_register(spark, sf))


def predicate_filter(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    columns = {"STATUS": "o_orderstatus", "PRIORITY": "o_orderpriority", "YEAR": "year"}
    return cleaning.predicate_filter(orders, REQUEST, columns).select("o_orderkey", "o_orderstatus", "o_orderpriority", "year")


def dedup_union_label(spark: SparkSession, sf: str) -> DataFrame:
    events = I.table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    presence = cleaning.drop_null_and_duplicate(events.filter(F.col("event_type") == "purchase"))
    background = cleaning.drop_null_and_duplicate(events.filter(F.col("event_type") != "purchase"))
    return encoding.label_from_type(cleaning.label_union(presence.drop("event_type"), background))


def one_hot_flags(spark: SparkSession, sf: str) -> DataFrame:
    parts = I.table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_retailprice") > 1000).cast("int").alias("near_road"),
        encoding.land_cover_name(F.pmod(F.col("p_size"), F.lit(23))).alias("Land_cover"),
    )
    parts = encoding.drop_unknown(parts)
    hot = encoding.bools_to_int(encoding.one_hot(encoding.cast_flags(parts, ["near_road"])))
    return encoding.align_features(hot, ["near_road", "cats_presence", *COVER_COLUMNS], keep=["p_partkey"])


def one_hot_decode(spark: SparkSession, sf: str) -> DataFrame:
    parts = I.table(spark, sf, "part").select(
        "p_partkey", encoding.land_cover_name(F.pmod(F.col("p_size"), F.lit(23))).alias("Land_cover")
    )
    return encoding.one_hot_decode(encoding.one_hot(parts)).select("p_partkey", "Land_cover")


def one_hot_drop_first(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return encoding.bools_to_int(encoding.one_hot(orders, "status", ["F", "O", "P"], drop_first=True))


def numeric_cast(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"),
                                                 F.col("o_orderpriority").alias("text"))
    return encoding.to_numeric(orders, ["level", "text"])


def type_split(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of the presence side of a labelled table."""
    orders = I.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "presence").otherwise("background").alias("type")
    return enrich.coordinates_only(orders.select(kind, *I.place("o_orderkey")), "presence")


def occurrence_files(spark: SparkSession, sf: str) -> DataFrame:
    """The raw records as two tab-separated files with their own headers, read and cleaned."""
    folder = f"{shared_folder(spark)}/occurrences-{uuid.uuid4().hex}"
    raw = I.raw_occurrences(spark, sf).drop("row_id")
    present = F.col("occurrenceStatus") == "PRESENT"
    paths = []
    for name, part in (("a", raw.filter(present)), ("b", raw.filter(~present).select(*sorted(raw.columns)))):
        paths.append(f"{folder}/{name}")
        part.write.option("sep", "\t").option("header", True).csv(paths[-1])
    return cleaning.clean_occurrences(tables.read_occurrences(spark, paths), min_year=1997)


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def first_file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 rows of each of two files, which hold the first thousand present and absent orders."""
    raw = I.raw_occurrences(spark, sf)
    paths = []
    for status in ("PRESENT", "ABSENT"):
        paths.append(_fresh(spark, status))
        own = raw.filter(F.col("occurrenceStatus") == status).orderBy("row_id").limit(1000).coalesce(1)
        own.orderBy("row_id").drop("row_id").write.option("sep", "\t").option("header", True).csv(paths[-1])
    out = tables.read_occurrences(spark, paths, rows=200)
    return out.select("occurrenceStatus", "year", "species", "decimalLongitude")


def stage_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as a parquet stage and as a CSV one, and read again by their schema."""
    rows = I.records(spark, sf)
    parquet, text = _fresh(spark, "stage"), f"{_fresh(spark, 'stage')}.csv"
    tables.write_stage(rows, parquet)
    tables.write_stage(rows, text, fmt="csv")
    kept = tables.read_stage(spark, parquet).unionByName(tables.read_stage(spark, text, rows.schema))
    return kept.groupBy("row_id", "eventDate").agg(F.count("*").alias("copies"), F.round(F.min("decimalLatitude"), 9).alias("latitude"),
                                                   (F.min("decimalLongitude") == F.max("decimalLongitude")).alias("same"))


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.bounds(I.records(spark, sf), "decimalLongitude", "decimalLatitude")


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.sample_n(I.features(spark, sf), 50).select("row_id", "label")


def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.first_n(I.features(spark, sf), 200).select("row_id", "label")


# --- scalar functions --------------------------------------------------------

def spectral_indices(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *I.bands(F.col("l_partkey")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.round(v, 6).alias(k) for k, v in spectral.all_indices().items()]
    )


def aoi_boxes(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = F.col("decimalLatitude"), F.col("decimalLongitude")
    box = {f"flat_{k}": v for k, v in geo.aoi_box(lat, lon).items()}
    true = {f"true_{k}": v for k, v in geo.aoi_box_geodesic(lat, lon).items()}
    return I.records(spark, sf).select("row_id", *[F.round(v, 6).alias(k) for k, v in {**box, **true}.items()])


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.records(spark, sf).withColumns(geo.tile_id(F.col("decimalLatitude"), F.col("decimalLongitude")))
    box = geo.padded_tile_box(F.col("tile_x"), F.col("tile_y"))
    return rows.select("row_id", "tile_x", "tile_y", *[F.round(v, 6).alias(k) for k, v in box.items()])


def loss_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.features(spark, sf).withColumn("z", F.col("NDVI") * 10.0)
    y = F.col("label").cast("double")
    return rows.agg(
        F.round(F.avg(losses.sigmoid(F.col("z"))), 6).alias("mean_p"),
        F.round(F.avg(losses.bce_eps(losses.sigmoid(F.col("z")), y)), 6).alias("eps_loss"),
        F.round(F.avg(losses.bce_logits(F.col("z"), y)), 6).alias("bce_loss"),
    )


def to_bng_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = to_bng(I.records(spark, sf), "decimalLongitude", "decimalLatitude")
    return out.select("row_id", F.round("easting_gb", 3).alias("easting_gb"), F.round("northing_gb", 3).alias("northing_gb"))


def to_irish(spark: SparkSession, sf: str) -> DataFrame:
    out = to_irish_grid(I.records(spark, sf), "decimalLongitude", "decimalLatitude")
    return out.select("row_id", F.round("easting_ni", 3).alias("easting_ni"), F.round("northing_ni", 3).alias("northing_ni"))


def from_bng_grid(spark: SparkSession, sf: str) -> DataFrame:
    points = I.planar_points(spark, sf).select("row_id", (F.col("x") + 400000.0).alias("x"), (F.col("y") + 200000.0).alias("y"))
    out = bng_to_wgs84(points, "x", "y")
    return out.select("row_id", F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude"))


# --- spatial joins -----------------------------------------------------------

def radius_month_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = radius.radius_month_flags(I.present_records(spark, sf), I.covariates(spark, sf), ["A", "N", "R"])
    return out.select("row_id", "A_presence", "N_presence", "R_presence")


def flagged_share_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: clean, flag by radius and month, share of flagged records per month."""
    clean = cleaning.clean_occurrences(I.raw_occurrences(spark, sf), min_year=1996, extra=("row_id",))
    out = radius.radius_month_flags(clean, I.covariates(spark, sf), ["R"])
    return out.groupBy(F.month("eventDate").alias("month")).agg(
        F.count("*").alias("records"),
        F.sum("R_presence").alias("flagged"),
        F.round(F.avg("R_presence"), 6).alias("share"),
    )


def site_radius_flag(spark: SparkSession, sf: str) -> DataFrame:
    sites = cleaning.operational_sites(I.site_register(spark, sf))
    out = radius.radius_flag(I.records(spark, sf), sites, radius_km=5.0)
    return out.select("row_id", "wind_turbines_presence")


def lookup_first(spark: SparkSession, sf: str) -> DataFrame:
    points = I.table(spark, sf, "customer").select("c_custkey", *I.place("c_custkey"))
    ref = I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", *I.place("o_custkey"))
    keys = ["decimalLatitude", "decimalLongitude"]
    out = lookup.lookup_first(points, ref, keys, "o_totalprice", "o_orderkey", default=0.0)
    return out.select("c_custkey", "o_totalprice")


def attach_results(spark: SparkSession, sf: str) -> DataFrame:
    means = I.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return lookup.attach(I.records(spark, sf).select("row_id"), means)


def least_cloudy_scene(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.least_cloudy_scene(I.records(spark, sf), I.scenes(spark, sf)).select("row_id", "scene_id")


def least_cloudy_anywhere(spark: SparkSession, sf: str) -> DataFrame:
    everywhere = I.scenes(spark, sf).select("scene_id", "acq_date", "cloud_pct")
    return scenes.least_cloudy_scene(I.records(spark, sf), everywhere).select("row_id", "scene_id")


def aoi_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = scenes.aoi_mean(I.scene_records(spark, sf), I.scene_pixels(spark, sf), km=10.0, tile=16.0)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in spectral.INDEX_NAMES])


def aoi_mean_of_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of whole band values are exact, so the indices need no rounding."""
    out = scenes.aoi_mean(I.scene_records(spark, sf), I.scene_pixels(spark, sf), km=10.0, mode="ratio_of_means", tile=16.0)
    return out.select("l_orderkey", "l_linenumber", *spectral.INDEX_NAMES)


def lst_mean(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.lst_mean(I.records(spark, sf), I.lst_pixels(spark, sf), km=10.0, digits=6).select("row_id", "LST")


def nearest_segment(spark: SparkSession, sf: str) -> DataFrame:
    out = roads.nearest_segment_distance(I.planar_points(spark, sf), I.segments(spark, sf), max_m=2000.0)
    out = cleaning.near_flag(out, metres=500.0)
    return out.select("row_id", F.round("distance_to_road", 6).alias("distance_to_road"), "near_road")


def raster_point(spark: SparkSession, sf: str) -> DataFrame:
    pixels, first, second = I.rasters(spark, sf)
    points = I.raster_points(spark, sf, first, second)
    return raster.raster_at_point(points, pixels, first, second).select("row_id", "class", "Land_cover")


def raster_window_mode(spark: SparkSession, sf: str) -> DataFrame:
    pixels, first, second = I.rasters(spark, sf)
    points = I.raster_points(spark, sf, first, second)
    return raster.raster_window(points, pixels, first, second, size=10).select("row_id", "class", "Land_cover")


def points_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.points_within(I.planar_points(spark, sf), I.polygon_edges(spark, sf)).select("row_id")


def masked_grid(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.mask_outside(I.planar_points(spark, sf), I.polygon_edges(spark, sf)).select("row_id", "probability")


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    return grid.lattice(spark, grid.edge_extent(I.segments(spark, sf)), 1000.0).select(
        F.round("x", 3).alias("x"), F.round("y", 3).alias("y")
    )


def national_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = grid.national_grid(spark, I.polygon_edges(spark, sf), step=500.0)
    return out.select(F.round("longitude", 7).alias("longitude"), F.round("latitude", 7).alias("latitude"))


def country_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The national grid of four named countries."""
    out = grid.national_grid(spark, I.polygon_edges(spark, sf), step=500.0, names=COUNTRIES)
    return out.select(F.round("longitude", 7).alias("longitude"), F.round("latitude", 7).alias("latitude"))


def grid_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lattice points before and after the polygon filter."""
    edges = I.polygon_edges(spark, sf)
    points = grid.lattice(spark, grid.edge_extent(edges), 1000.0)
    inside = polygons.points_within(points, edges)
    return points.agg(F.count("*").alias("points")).withColumn("inside", inside.agg(F.count("*")).scalar())


def points_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """Points within the extent of four named polygons."""
    edges = polygons.load_polygon_edges(I.polygon_edges(spark, sf), [f"NATION_{i}" for i in (1, 2, 5, 9)])
    a, b, c, e = (F.lit(v) for v in grid.edge_extent(edges))
    points = I.planar_points(spark, sf)
    return points.filter(geo.within_box(F.col("x"), F.col("y"), a, b, c, e)).select("row_id")


def probability_map(spark: SparkSession, sf: str) -> DataFrame:
    """Finer map of the lattice values, null outside the polygons."""
    out = polygons.mask_outside(grid.resample_grid(I.lattice_values(spark, sf)), I.polygon_edges(spark, sf))
    return out.select("x", "y", F.round("probability", 4).alias("probability"))


def resample_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = grid.resample_grid(I.lattice_values(spark, sf))
    return out.select("x", "y", F.round("probability", 4).alias("probability"))


# --- metrics -----------------------------------------------------------------

def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_rows(I.records(spark, sf).select("row_id"))


def scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    train = splits.split_rows(I.features(spark, sf)).filter(~F.col("is_test"))
    return splits.fit_scaler(train).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def scaler_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_rows(I.features(spark, sf))
    scaled = splits.apply_scaler(rows, splits.fit_scaler(rows.filter(~F.col("is_test"))))
    return scaled.select("row_id", *[F.round(c, 6).alias(c) for c in ENV_VARS])


def saved_scaler(spark: SparkSession, sf: str) -> DataFrame:
    """The scaler written, read back and applied."""
    rows = splits.split_rows(I.features(spark, sf))
    path = f"{shared_folder(spark)}/scaler-{uuid.uuid4().hex}"
    tables.save_scaler(splits.fit_scaler(rows.filter(~F.col("is_test"))), path)
    scaled = splits.apply_scaler(rows, tables.load_scaler(spark, path))
    return scaled.select("row_id", *[F.round(c, 6).alias(c) for c in ENV_VARS])


def boyce_index(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.boyce_index(I.order_scores(spark, sf), by=["species"])
    return out.select("species", F.round("boyce", 6).alias("boyce"))


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.roc_auc(I.order_scores(spark, sf), "tied", by=["species"])
    return out.select("species", F.round("auc", 6).alias("auc"))


def merged_metric(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.evaluate(I.order_scores(spark, sf), "p", by=["species"])
    return out.select("species", *[F.round(c, 6).alias(c) for c in ("auc", "boyce", "auc_norm", "boyce_norm", "mixed")])


def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metrics_long(merged_metric(spark, sf).select("species", "auc_norm", "boyce_norm", "mixed"), "species", ["auc_norm", "boyce_norm", "mixed"])


def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    long = I.model_scores(spark, sf).unpivot(["row_id"], I.MODELS, "model", "p")
    out = metrics.ensemble_mean(long, ["row_id"])
    return out.select("row_id", F.round("probability", 8).alias("probability"))


def high_probability(spark: SparkSession, sf: str) -> DataFrame:
    long = I.model_scores(spark, sf).unpivot(["row_id"], I.MODELS, "model", "p")
    return long.filter(F.col("p") > 0.6)


def ensemble_powerset(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.evaluate_ensembles(I.model_scores(spark, sf), I.MODELS)
    return out.select("ensemble", *[F.round(c, 6).alias(c) for c in ("auc", "boyce", "mixed")])


def feature_corr(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.features(spark, sf).withColumnRenamed("UI", "probability").drop("row_id")
    return metrics.corr_with(rows).select("feature", F.round("corr", 6).alias("corr"))


def value_share(spark: SparkSession, sf: str) -> DataFrame:
    parts = I.table(spark, sf, "part").select(encoding.land_cover_name(F.pmod(F.col("p_size"), F.lit(23))).alias("Land_cover"))
    return metrics.value_share(parts, "Land_cover").select("Land_cover", "n", F.round("share", 6).alias("share"))


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as samples: true class is the language, predicted one is decided by length."""
    docs = I.table(spark, sf, "documents")
    guess = F.when(F.col("n_chars") < 500, "en").when(F.col("n_chars") < 1500, "de").otherwise("fr")
    out = metrics.classification_report(docs.select(F.col("lang").alias("label"), guess.alias("prediction")))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# --- learning ----------------------------------------------------------------

def _linear_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_rows(I.features(spark, sf))
    return splits.apply_scaler(rows, splits.fit_scaler(rows.filter(~F.col("is_test"))))


def logit_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _linear_table(spark, sf)
    model = logit.fit_logit(rows.filter(~F.col("is_test")), ENV_VARS, LogitParams(C=1, class_weight="balanced"))
    return logit.predict_probability(model, rows, ENV_VARS).select("row_id", "label", F.round("p", 4).alias("p"))


def logit_score(spark: SparkSession, sf: str) -> DataFrame:
    z = logit.linear_logit(LINEAR_WEIGHTS, 0.1, ENV_VARS)
    return I.features(spark, sf).select("row_id", F.round(losses.sigmoid(z), 6).alias("p"))


def linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    out = logit.linear_attribution(I.features(spark, sf), LINEAR_WEIGHTS, ENV_VARS)
    return out.select("row_id", "feature", F.round("value", 6).alias("value"))


def linear_importance(spark: SparkSession, sf: str) -> DataFrame:
    out = attribution.importance(logit.linear_attribution(I.features(spark, sf), LINEAR_WEIGHTS, ENV_VARS))
    return metrics.top_features(out, 5).select("feature", F.round("importance", 6).alias("importance"))


def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting of the grid, best first."""
    _, table = logit.grid_search(_linear_table(spark, sf), ENV_VARS)
    return table


def grid_search_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of a search on any data: every setting scored, best first, the same model scored alike, and the best at least as good as Spark's own fit."""
    rows = _linear_table(spark, sf)
    _, table = logit.grid_search(rows, ENV_VARS, scorer="roc_auc")
    scores = table.agg(
        F.count("*").alias("settings"), F.count("score").alias("scored"), F.countDistinct("penalty").alias("penalties"), F.max("score").alias("_best"),
        F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
    )
    # C plays no part where nothing is penalised.
    alike = table.filter("penalty = 'none'").groupBy("class_weight", "max_iter").agg((F.max("score") - F.min("score")).alias("gap"))
    fixed = LogitParams(C=1, penalty="l2", max_iter=100)
    folds = splits.fold_column(rows, "row_id", 5)
    parts = []
    for k in range(5):
        model = logit.fit_logit(folds.filter(F.col("fold") != k), ENV_VARS, fixed)
        held = logit.predict_probability(model, folds.filter(F.col("fold") == k), ENV_VARS)
        parts.append(metrics.roc_auc(held).select("auc"))
    own = reduce(DataFrame.unionByName, parts).agg(F.avg("auc")).scalar()
    out = scores.withColumns({"none_alike": alike.agg(F.max("gap") < 1e-12).scalar(), "best_not_below_fixed": F.col("_best") >= own - 1e-6})
    return out.drop("_best")


def stored_models(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored models and a stored split: whether rows score the same after reloading."""
    folder = _fresh(spark, "models")
    rows = _linear_table(spark, sf)
    tables.save_split(rows, f"{folder}/split")
    again = tables.join_split(rows.drop("is_test"), f"{folder}/split")
    for n, c in enumerate((0.1, 10.0)):
        model = logit.fit_logit(again.filter(~F.col("is_test")), ENV_VARS, LogitParams(C=c))
        tables.save_model(model, folder, "linear", ENV_VARS, first=n == 0)
    # The second model is the latest version, so both must give the same score.
    now = logit.predict_probability(model, again, ENV_VARS, "before")
    loaded = tables.load_model(spark, folder, "linear").transform(now)
    old = tables.load_model(spark, folder, "linear", version=1).transform(loaded.select(*now.columns, vector_to_array("probability")[1].alias("after")))
    return old.select("row_id", "is_test", (F.col("before") == F.col("after")).alias("same"),
                      vector_to_array("probability")[1].between(0, 1).alias("old_scores"))


def linear_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """The two linear models and their mean on the test rows; each AUC against the share of ordered pairs."""
    rows = I.features(spark, sf)
    kind = F.when(F.col("label") == 1, "presence").otherwise("background")
    data = train.prepare(rows.withColumn("type", kind).drop("label"))
    models = train.train_linear(data, params={"boyce": LogitParams(C=0.1), "roc": LogitParams(C=10, class_weight="balanced")})
    table = train.evaluate_linear(data, models)
    scored = data.test
    for name, model in models.items():
        scored = logit.predict_probability(model, scored, data.features, f"p_{name}")
    scored = scored.withColumn("both", (F.col("p_boyce") + F.col("p_roc")) / 2)
    # Mid-ranks give the share of pairs in order without making the pairs.
    names = {"p_boyce": "boyce", "p_roc": "roc", "both": "boyce, roc"}
    long = scored.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("ensemble"), F.col(c).alias("p")) for c, n in names.items()])).alias("e")).select("label", "e.*")
    ties = long.groupBy("ensemble", "p").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    below = Window.partitionBy("ensemble").orderBy("p")
    ranked = ties.withColumn("mid", F.sum("n").over(below) - (F.col("n") - 1) / 2)
    pairs = ranked.groupBy("ensemble").agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("presences"), (F.sum(F.col("mid") * F.col("pos")) - F.sum("pos") * (F.sum("pos") + 1) / 2).alias("ordered"))
    pairs = pairs.withColumn("share", F.col("ordered") / (F.col("presences") * (F.col("rows") - F.col("presences"))))
    sizes = F.size(F.split("ensemble", "[^a-z]+"))
    matched = table.select(F.regexp_replace("ensemble", "[^a-z]+", ", ").alias("ensemble"), "auc").join(pairs, "ensemble", "left")
    return matched.select(sizes.alias("models"), "rows", "presences", (F.abs(F.col("auc") - F.col("share")) < 1e-9).alias("auc_is_share_of_pairs"))


def fixed_network(shift: int = 0) -> mlp.Network:
    """Small network with weights from a rule, for scoring against SQL."""
    def matrix(rows: int, cols: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.indices((rows, cols))
        return ((i * 7 + j * 3 + layer * 5 + shift) % 11 - 5) / 4.0, ((np.arange(cols) * 3 + layer) % 5 - 2) / 8.0

    return mlp.Network([matrix(9, 3, 0), matrix(3, 3, 1), matrix(3, 3, 2), matrix(3, 1, 3)])


def score_models(spark: SparkSession, sf: str) -> DataFrame:
    """Two networks in one pass, and their mean."""
    nets = {"m1": fixed_network(), "m2": fixed_network(2)}
    out = score_grid.score_grid(I.features(spark, sf), nets, ENV_VARS, ("m1", "m2"))
    return out.select("row_id", F.round("probability", 6).alias("probability"))


def residual_mlp_score(spark: SparkSession, sf: str) -> DataFrame:
    out = mlp.score_residual_mlp(I.features(spark, sf), fixed_network(), ENV_VARS)
    return out.select("row_id", F.round("p", 6).alias("p"))


def residual_mlp_train(spark: SparkSession, sf: str) -> DataFrame:
    rows = _linear_table(spark, sf)
    run = mlp.fit_residual_mlp(rows.filter(~F.col("is_test")), ENV_VARS)
    return mlp.score_residual_mlp(rows, run.network, ENV_VARS).select("row_id", "label", F.round("p", 4).alias("p"))


def shapley(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.shapley(I.features(spark, sf), [fixed_network()], ENV_VARS)


def shapley_total(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of a record add up to its logit less the mean logit of the baseline."""
    rows = I.features(spark, sf)
    shares = attribution.shapley(rows, [fixed_network()], ENV_VARS, baseline=cleaning.sample_n(rows, 50))
    return shares.groupBy("row_id").agg(F.round(F.sum("value"), 6).alias("total"))


def logit_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of both parts; whether the gradient vanishes at the fit and ranks its training rows."""
    rows = _linear_table(spark, sf)
    fitted = rows.filter(~F.col("is_test"))
    model = logit.fit_logit(fitted, ENV_VARS, LogitParams(C=1, class_weight="balanced"))
    weights, intercept = logit.coefficients(model)
    scored = fitted.withColumn("p", losses.sigmoid(logit.linear_logit(weights, intercept, ENV_VARS)))
    n = F.count("*")
    balance = [F.sum(F.when(F.col("label") == c, F.col("p") - c).otherwise(0.0)) * n / (2 * F.sum((F.col("label") == c).cast("int"))) for c in (0, 1)]
    slopes = [
        sum(F.sum(F.when(F.col("label") == c, (F.col("p") - c) * F.col(v)).otherwise(0.0)) * n / (2 * F.sum((F.col("label") == c).cast("int"))) for c in (0, 1)) + w
        for v, w in zip(ENV_VARS, weights)
    ]
    largest = scored.agg((F.greatest(*[F.abs(g) for g in (balance[0] + balance[1], *slopes)]) / n).alias("g")).scalar()
    ranked = metrics.roc_auc(scored).select("auc").scalar()
    parts = rows.groupBy("is_test").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("presences"))
    return parts.withColumns({"converged": largest < 1e-3, "above_chance": ranked > 0.5})


def class_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows by class, and whether the shares of the one-vs-rest models add up for all of them."""
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v)
    return ovr(spark, sf).groupBy("species").agg(F.count("*").alias("n"), F.bool_and(F.abs(total - 1.0) < 1e-9).alias("sums_to_one"))


def _species_table(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list]:
    """Scaled training and held-out rows with their class numbers, and the classes."""
    rows, classes = multiclass.index_classes(I.class_features(spark, sf), "species")
    rows = splits.split_rows(rows)
    scaled = splits.apply_scaler(rows, splits.fit_scaler(rows.filter(~F.col("is_test"))))
    return scaled.filter(~F.col("is_test")), scaled.filter("is_test"), classes


def mlp_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """Report on the held-out rows."""
    known, test, classes = _species_table(spark, sf)
    model = multiclass.fit_mlp_multiclass(known, ENV_VARS, len(classes))
    return metrics.classification_report(multiclass.predict_classes(model, test, ENV_VARS))


def ovr(spark: SparkSession, sf: str) -> DataFrame:
    known, test, classes = _species_table(spark, sf)
    models = multiclass.fit_ovr(known, ENV_VARS, len(classes))
    return multiclass.predict_ovr(models, test, ENV_VARS).select("row_id", "species", "prediction", "probabilities")


def class_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows per class under the multi-class network, and what must hold of its calibration.

    Calibration minimises each class's loss on the rows it is fitted to, so there it is not above that of any constant score.
    """
    train_rows, test, classes = _species_table(spark, sf)
    model = multiclass.fit_mlp_multiclass(train_rows, ENV_VARS, len(classes))
    fitted = multiclass.predict_classes(model, train_rows, ENV_VARS)
    fits = multiclass.calibrate_sigmoid(fitted, len(classes))
    held = multiclass.apply_calibration(multiclass.predict_classes(model, test, ENV_VARS), fits)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v)
    best = F.array_max("probabilities") == F.element_at("probabilities", F.col("prediction").cast("int") + 1)
    counts = held.groupBy("species").agg(F.count("*").alias("n"), F.bool_and((F.abs(total - 1) < 1e-9) & best).alias("shares_and_best"))
    each = F.array(*[F.struct(F.lit(name).alias("species"), F.col("label").alias("label"), F.lit(float(c)).alias("c"),
                              losses.sigmoid(F.lit(a) * F.col("probabilities")[c] + F.lit(b)).alias("q")) for c, (name, (a, b)) in enumerate(zip(classes, fits))])
    rows = fitted.select(F.explode(each).alias("e")).select("e.*")
    hit = (F.col("label") == F.col("c")).cast("double")
    # The targets are smoothed as in the fit.
    target = F.when(hit == 1, (F.col("_n") + 1) / (F.col("_n") + 2)).otherwise(1 / (F.col("_rows") - F.col("_n") + 2))
    sizes = rows.groupBy("species").agg(F.sum(hit).alias("_n"), F.count("*").alias("_rows"))
    rows = rows.join(sizes, "species").withColumn("_t", target)
    mean = Window.partitionBy("species")
    rows = rows.withColumn("_m", F.avg("_t").over(mean))
    def loss(q):
        return F.sum(-F.col("_t") * F.ln(q) - (1 - F.col("_t")) * F.ln(1 - q))

    judged = rows.groupBy("species").agg((loss(F.col("q")) <= loss(F.col("_m")) * (1 + 1e-6)).alias("calibration_not_above_constant"))
    return counts.join(judged, "species")


def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the training rows' scores, applied to the held-out rows."""
    known, test, classes = _species_table(spark, sf)
    model = multiclass.fit_mlp_multiclass(known, ENV_VARS, len(classes))
    fits = multiclass.calibrate_sigmoid(multiclass.predict_classes(model, known, ENV_VARS), len(classes))
    out = multiclass.apply_calibration(multiclass.predict_classes(model, test, ENV_VARS), fits)
    return out.select("row_id", "species", "prediction", "probabilities")


# --- stages ------------------------------------------------------------------

def enriched_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every enrichment step over the orders, written out between the steps."""
    pixels, first, second = I.rasters(spark, sf)
    roads_at = I.segments(spark, sf).select(
        *[(F.col(c) + (330000.0 if c[0] == "x" else 12000.0)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    )
    layers = enrich.Layers(
        scenes=I.scenes(spark, sf).select("acq_date", "cloud_pct", F.col("supplier").alias("scene_id")),
        scene_pixels=I.scene_pixels(spark, sf),
        lst_pixels=I.lst_pixels(spark, sf),
        covariates=I.covariates(spark, sf),
        raster=pixels,
        first_raster=replace(first, x0=320000.0, y0=140000.0, res=1000.0),
        second_raster=replace(second, x0=545000.0, y0=-5000.0, res=2000.0),
        sites=cleaning.operational_sites(I.site_register(spark, sf)),
        roads=roads_at,
    )
    spec = Species("orders", ("A", "N", "R"), wind_turbines=True, roads=True)
    out = enrich.enrich(I.records(spark, sf), spec, layers, window=10, km=10.0)
    shown = [F.round(c, 6).alias(c) for c in (*spectral.INDEX_NAMES, "LST")]
    return out.select("row_id", "eventDate", *shown, *spec.flags, "Land_cover")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        occurrence_clean, occurrence_count_since, operational_sites, predicate_filter, dedup_union_label,
        one_hot_flags, one_hot_decode, one_hot_drop_first, numeric_cast, type_split, occurrence_files, first_file_rows, stage_tables, bounds, sample_rows, first_rows,
        spectral_indices, aoi_boxes, tiles, loss_columns, to_bng_grid, to_irish, from_bng_grid,
        radius_month_flags, flagged_share_by_month, site_radius_flag, lookup_first, attach_results,
        least_cloudy_scene, least_cloudy_anywhere, aoi_mean, aoi_mean_of_bands, lst_mean, nearest_segment,
        raster_point, raster_window_mode, points_in_polygon, masked_grid, lattice, national_grid, country_grid, grid_counts, points_in_box,
        resample_grid, probability_map,
        hash_split, scaler_fit, scaler_apply, saved_scaler, boyce_index, roc_auc, merged_metric, metrics_long, ensemble_mean,
        high_probability, ensemble_powerset, feature_corr, value_share, class_report,
        logit_fit, logit_score, linear_attribution, linear_importance, grid_search, grid_search_facts, stored_models, linear_ensemble,
        score_models, residual_mlp_score, residual_mlp_train, shapley, shapley_total, logit_optimum, class_shares, mlp_multiclass, ovr, calibrate, class_facts, enriched_records,
    )
}
