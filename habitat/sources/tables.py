"""Sources and sinks: occurrence text files, stage tables, scalers, model weights."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OCCURRENCE_SCHEMA = T.StructType(
    [
        T.StructField("occurrenceStatus", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("eventDate", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("decimalLatitude", T.DoubleType()),
        T.StructField("decimalLongitude", T.DoubleType()),
    ]
)
SITE_SCHEMA = T.StructType(
    [
        T.StructField("DEVSTATSHT", T.StringType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LNG", T.DoubleType()),
    ]
)


def read_occurrences(
    spark: SparkSession, paths: str | list[str], rows: int | None = None, with_file: bool = False
) -> DataFrame:
    """Tab-separated occurrence files with a header; columns are found by name.

    Real files have more columns, in any order, so all header columns are read as
    text and the six used ones are cast; column pruning keeps the parser on those.
    ``rows`` takes the first rows of each file, before any filter.

    Files may order their columns differently. The first lines of all files come from one distributed pass over their
    first blocks, and all files with the same header are one read, so a thousand small files cost as
    many reads as they have headers. Files without a line have no rows.
    """
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in OCCURRENCE_SCHEMA]
    extra = [F.col("_metadata.file_name").alias("file_name")] if with_file else []

    def one(files: list[str]) -> DataFrame:
        raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(files)
        return raw.select(*columns, *extra)

    if isinstance(paths, str) or len(paths) == 1 or rows is not None:
        # A folder that one writer made has one header; a limit holds for each path.
        parts = [one([p]) for p in ([paths] if isinstance(paths, str) else paths)]
        return reduce(DataFrame.unionByName, parts if rows is None else [p.limit(rows) for p in parts])
    parts = [one(files) for files in files_by_header(spark, paths)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], OCCURRENCE_SCHEMA)


def files_by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The files below ``paths``, grouped by their first line; one pass, however many files there are."""
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")
    )
    heads = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    # One name for each file, which the listing has on the driver anyway.
    found = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [[unquote(f) for f in r["files"]] for r in found]


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stage table: parquet, or comma CSV with a given schema for imports."""
    if path.endswith(".csv") or schema is not None:
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema is not None else reader).csv(path)
    return spark.read.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Pixel, scene and segment tables; filters on partition columns prune files."""
    return spark.read.parquet(path)


def write_raster(raster: DataFrame, path: str, block: int = 1000) -> None:
    """Pixel table laid out by raster and block, for pruned window reads."""
    blocks = raster.withColumns(
        {
            "block_row": F.floor(F.col("row") / F.lit(block)).cast("int"),
            "block_col": F.floor(F.col("col") / F.lit(block)).cast("int"),
        }
    )
    blocks = blocks.repartition("raster_id", "block_row", "block_col")
    write_stage(blocks, path, ["raster_id", "block_row", "block_col"])


def save_scaler(params: DataFrame, path: str) -> None:
    write_stage(params.select("feature", "mean", "std"), path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_weights(weights: DataFrame, path: str) -> None:
    """Network weights: ``model_id, layer, i, j, w``."""
    write_stage(weights.select("model_id", "layer", "i", "j", "w"), path, ["model_id"])


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


MODEL_VERSIONS = "name string, version int, kind string, features array<string>, path string"


def model_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The table of stored models: ``name, version, kind, features, path``."""
    return spark.read.schema(MODEL_VERSIONS).parquet(f"{folder}/versions")


def save_model(model: Model, folder: str, name: str, features: list[str], first: bool = False) -> int:
    """Store a fitted model with the assembly of its features, and enter it as the next version of ``name``.

    ``first`` says that the folder holds no models yet. The entry is written last: a model that is listed is whole.
    """
    spark = SparkSession.builder.getOrCreate()
    version = 1
    if not first:
        last = model_versions(spark, folder).filter(F.col("name") == name).agg(F.max("version")).first()[0]
        version += last or 0
    path = f"{folder}/models/{name}-{version}"
    PipelineModel([VectorAssembler(inputCols=features, outputCol=model.getFeaturesCol()), model]).write().overwrite().save(path)
    entry = spark.createDataFrame([(name, version, type(model).__name__, features, path)], MODEL_VERSIONS)
    entry.write.mode("append").parquet(f"{folder}/versions")
    return version


def load_model(spark: SparkSession, folder: str, name: str, version: int | None = None) -> PipelineModel:
    """The stored model of that version, or the latest one; it takes the feature columns and assembles them itself."""
    known = model_versions(spark, folder).filter(F.col("name") == name)
    known = known if version is None else known.filter(F.col("version") == version)
    row = known.orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"no stored model {name!r} of version {version or 'any'}")
    return PipelineModel.load(row["path"])


def save_split(df: DataFrame, path: str, key: str = "row_id", name: str = "is_test") -> None:
    """Store which rows are test rows, by key."""
    write_stage(df.select(key, name), path)


def join_split(df: DataFrame, path: str, key: str = "row_id", name: str = "is_test") -> DataFrame:
    """Add the stored mark; rows that the stored split does not know get a null and belong to neither side."""
    return df.join(df.sparkSession.read.parquet(path).select(key, name), key, "left")
