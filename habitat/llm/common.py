"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from habitat.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 8 << 20

cut = cut_lineage


def free(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/stage-" in folder:
                path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, or an empty one for a null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; the folds of labelled rows."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None],
               schema: str | T.StructType, text: str | None = "text", most: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` to Arrow batches cut so that each holds about ``most`` bytes of ``text``, or of numbers where that is a list.

    A single row longer than that makes a batch of its own. A StructType as ``schema`` keeps the names of all columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, most):
                out = fn(piece)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        give_back()

    if not isinstance(schema, T.StructType):
        return df.mapInArrow(run, schema)
    # Names with dots would be taken apart on the way.
    plain = [c.replace(".", "\0") for c in df.columns]
    inner = T.StructType([T.StructField(f.name.replace(".", "\0"), f.dataType) for f in schema])
    return df.toDF(*plain).mapInArrow(run, inner).toDF(*schema.names)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: a worker that waits for the next one counts for its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over the batches of a task, its memory returned when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, text: str | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    if text is None:
        yield batch
        return
    column = batch.column(text)
    lengths = pc.multiply(pc.list_value_length(column), 8) if pa.types.is_list(column.type) else pc.binary_length(column)
    sizes = np.asarray(lengths.fill_null(0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def clear_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns that are added for a while."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def unit(key: str) -> float:
    """A fixed number in [0, 1) for a key."""
    return zlib.crc32(key.encode()) / 2**32
