"""The driver tables seen as study inputs.

Places come from a key ``k``: latitude 50 + (7919 k mod 100003) / 100003 and
longitude -3 + (104729 k mod 100003) / 100003; planar places are those offsets
times 100 km.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitat.config import ENV_VARS
from habitat.operators.raster import RasterMeta

MODELS = ["m1", "m2", "m3", "m4"]
BAND_PRIMES = {"b2": 7919, "b3": 104729, "b4": 1299709, "b8": 15485863, "b11": 32452843}

#: Parts of the 64 embedding values, by number of parts; the last one takes the rest.
BLOCKS = {n: [(i * (64 // n), 64 if i == n - 1 else (i + 1) * (64 // n)) for i in range(n)] for n in (9, 4)}


def block_mean(i: int, blocks: int) -> Column:
    """Mean of the ``i``-th of ``blocks`` parts of an embedding."""
    start, end = BLOCKS[blocks][i]
    total = F.aggregate(F.slice("embedding", start + 1, end - start), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return total / F.lit(float(end - start))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _offset(key: Column, prime: int) -> Column:
    return F.pmod(key.cast("long") * prime, F.lit(100003)) / F.lit(100003.0)


def lat_of(key: Column) -> Column:
    return F.lit(50.0) + _offset(key, 7919)


def lon_of(key: Column) -> Column:
    return F.lit(-3.0) + _offset(key, 104729)


def x_of(key: Column) -> Column:
    return _offset(key, 104729) * 100000.0


def y_of(key: Column) -> Column:
    return _offset(key, 7919) * 100000.0


def place(key: str) -> list[Column]:
    return [lat_of(F.col(key)).alias("decimalLatitude"), lon_of(F.col(key)).alias("decimalLongitude")]


def raw_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw records: status F is PRESENT, low priority has a date with a time."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", "PRESENT").otherwise("ABSENT").alias("occurrenceStatus"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(date, F.lit("T10:00"))).otherwise(date).alias("eventDate"),
        F.col("o_orderpriority").alias("species"),
        F.when(F.col("o_totalprice") >= 20000, lat_of(F.col("o_orderkey"))).alias("decimalLatitude"),
        lon_of(F.col("o_orderkey")).alias("decimalLongitude"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as clean records."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), *place("o_orderkey"), F.to_date("o_orderdate").alias("eventDate")
    )


def present_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of status F (PRESENT) as clean records."""
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("row_id"), *place("o_orderkey"), F.to_date("o_orderdate").alias("eventDate")
    )


def covariates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("covariate"), *place("l_partkey"), F.to_date("l_shipdate").alias("eventDate")
    )


def site_register(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.when(F.col("s_acctbal") > 0, "Operational").otherwise("Planned").alias("DEVSTATSHT"),
        lat_of(F.col("s_suppkey")).alias("LAT"),
        lon_of(F.col("s_suppkey")).alias("LNG"),
    )


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scenes with a footprint of 0.1 to 0.6 degrees."""
    half = F.col("l_quantity") / 100.0 + 0.05
    lat, lon = lat_of(F.col("l_partkey")), lon_of(F.col("l_partkey"))
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene_id"),
        F.to_date("l_shipdate").alias("acq_date"),
        F.col("l_extendedprice").alias("cloud_pct"),
        F.col("l_suppkey").alias("supplier"),
        (lat - half).alias("lat_min"),
        (lat + half).alias("lat_max"),
        (lon - half).alias("lon_min"),
        (lon + half).alias("lon_max"),
    )


def bands(key: Column) -> list[Column]:
    return [(F.pmod(key.cast("long") * p, F.lit(1000)) + 1).cast("double").alias(b) for b, p in BAND_PRIMES.items()]


def scene_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"),
        lat_of(F.col("l_orderkey")).alias("lat"),
        lon_of(F.col("l_orderkey")).alias("lon"),
        *bands(F.col("l_partkey")),
    )


def scene_records(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as records whose scene is already known."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey").alias("scene_id"), *place("l_partkey")
    )


def lst_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("acq_date"),
        lat_of(F.col("l_partkey")).alias("lat"),
        lon_of(F.col("l_partkey")).alias("lon"),
        (F.lit(14000) + F.pmod(F.col("l_orderkey"), F.lit(1000))).cast("double").alias("lst_raw"),
    )


def rasters(spark: SparkSession, sf: str) -> tuple[DataFrame, RasterMeta, RasterMeta]:
    """Orders as the first raster (first quarter without data), parts as the second."""
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    height1 = orders.agg(F.max("o_orderkey")).first()[0] // 125 + 1
    height2 = part.agg(F.max("p_partkey")).first()[0] // 50 + 1
    row1 = F.floor(F.col("o_orderkey") / 125).cast("int")
    col2 = F.pmod(F.col("p_partkey"), F.lit(50)).cast("int")
    one = orders.select(
        F.lit("gb").alias("raster_id"),
        row1.alias("row"),
        F.pmod(F.col("o_orderkey"), F.lit(125)).cast("int").alias("col"),
        F.when(row1 * 4 < height1, 0).otherwise(F.pmod(F.col("o_custkey"), F.lit(22))).cast("int").alias("class"),
    )
    two = part.select(
        F.lit("ni").alias("raster_id"),
        F.floor(F.col("p_partkey") / 50).cast("int").alias("row"),
        col2.alias("col"),
        F.when(col2 < 15, 0).otherwise(F.pmod(F.col("p_size"), F.lit(22))).cast("int").alias("class"),
    )
    return (
        one.unionByName(two),
        RasterMeta("gb", 0.0, 0.0, 10.0, int(height1), 125),
        RasterMeta("ni", 0.0, 0.0, 10.0, int(height2), 50),
    )


def raster_points(spark: SparkSession, sf: str, first: RasterMeta, second: RasterMeta) -> DataFrame:
    """Customers as points on and a little off both rasters."""
    k = F.col("c_custkey")

    def across(prime: int, extent: int) -> Column:
        return (F.pmod(k * prime, F.lit(extent + 4)) * 10 - 15).cast("double")

    return table(spark, sf, "customer").select(
        k.alias("row_id"),
        across(104729, first.width).alias("easting_gb"),
        (-across(7919, first.height)).alias("northing_gb"),
        across(31, second.width).alias("easting_ni"),
        (-across(17, second.height)).alias("northing_ni"),
    )


def planar_points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("row_id"), x_of(k).alias("x"), y_of(k).alias("y"), F.col("o_totalprice").alias("probability")
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("seg_id"), x_of(k).alias("x1"), y_of(k).alias("y1"), x_of(k + 1).alias("x2"), y_of(k + 1).alias("y2")
    )


def polygon_edges(spark: SparkSession, sf: str) -> DataFrame:
    """One diamond with a diamond hole per nation, as eight edges."""
    k = F.col("n_nationkey")
    ring = F.explode(F.array(F.lit(1.0), F.lit(0.5)))
    base = table(spark, sf, "nation").select(
        F.col("n_name").alias("poly_id"), x_of(k).alias("cx"), y_of(k).alias("cy"), (F.lit(5000.0) + k * 400).alias("r"), ring.alias("f")
    )
    rad = F.col("r") * F.col("f")
    east, north = (F.col("cx") + rad, F.col("cy")), (F.col("cx"), F.col("cy") + rad)
    west, south = (F.col("cx") - rad, F.col("cy")), (F.col("cx"), F.col("cy") - rad)
    sides = [(east, north), (north, west), (west, south), (south, east)]
    edges = F.array(
        *[F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in sides]
    )
    return base.select("poly_id", F.explode(edges).alias("e")).select("poly_id", "e.*")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings, in means of nine parts, as the environmental columns with a 0/1 label."""
    columns = [block_mean(i, len(ENV_VARS)).alias(c) for i, c in enumerate(ENV_VARS)]
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.when(F.col("label") < 3, 1).otherwise(0).alias("label"), *columns
    )


def class_features(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with the original label as the species name."""
    columns = [block_mean(i, len(ENV_VARS)).alias(c) for i, c in enumerate(ENV_VARS)]
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.concat(F.lit("species_"), F.col("label").cast("string")).alias("species"), *columns
    )


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Four scores per embedding, one column per model."""
    picks = [
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(block_mean(i, len(MODELS)) * -20.0)), 6).alias(m)
        for i, m in enumerate(MODELS)
    ]
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.when(F.col("label") < 3, 1).otherwise(0).alias("label"), *picks
    )


def order_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as scored records of five species."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("species"),
        F.col("o_totalprice").alias("p"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("tied"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


def lattice_values(spark: SparkSession, sf: str) -> DataFrame:
    """Orders on a 1 km lattice; pending orders are nodes without a value."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (F.floor(k / 125) * 1000.0).alias("x"),
        (F.pmod(k, F.lit(125)) * 1000.0).alias("y"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("probability"),
    )
