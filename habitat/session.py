"""Session helpers: the settings the operators count on."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot cells are split at run time, also below an aggregation.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Whether Spark removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "habitat", master: str | None = None, **extra: str) -> SparkSession:
    """Build or fetch a session. ``extra`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset it lies in the warehouse, which all machines share as well. The folder is
    removed when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/habitat-{spark.sparkContext.applicationId}"
    if folder not in _made:
        _made[folder] = spark
    return folder


_made: dict[str, SparkSession] = {}


@atexit.register
def _remove_folders() -> None:
    for folder, spark in _made.items():
        try:
            jvm = spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except (Py4JError, OSError):  # the JVM has gone first
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Operators read their input more than once, so a chain of them without a cut
    would multiply in the plan. A written table also outlives lost executors and
    gives the next joins a true size. The shuffle files behind it go when it is
    written, so a chain holds on disk what one of its steps moves.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
