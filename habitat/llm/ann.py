"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Each table turns a unit vector by three rounds of random signs and a fast Hadamard transform and files it under
the nearest signed axis. A query looks under its nearest axes of each table; all vectors
found there are ranked by their exact distance. Large buckets are split, and queries visit all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.llm.common import cut
from habitat.llm.vectors import best, matrix, usable

#: Tables, axes that a query visits in each, and vectors in a part of a bucket.
TABLES, PROBES, PART = 12, 8, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signed_axes(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Numbers of the ``probes`` nearest signed axes of each row in each table; axis i is i, its negative d + i."""
    n, dim = x.shape
    d = 1 << max(dim - 1, 0).bit_length()
    unit = np.zeros((n, d))
    # Scaled first, so that the norm of huge or tiny vectors neither overflows nor vanishes.
    unit[:, :dim] = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    signs = np.random.default_rng(1000 + dim).choice([-1.0, 1.0], size=(tables, 3, d))
    probes = min(probes, 2 * d)
    out = np.empty((n, tables, probes), dtype=np.int32)
    for t in range(tables):
        y = unit
        for s in signs[t]:
            y = hadamard(y * s)
        both = np.concatenate([y, -y], axis=1)
        if probes == 1:
            out[:, t, 0] = both.argmax(axis=1)
        else:
            out[:, t] = np.argsort(-both, axis=1, kind="stable")[:, :probes]
    return out


def _filed(rows: DataFrame, probes: int, tables: int) -> DataFrame:
    """(vec_id, v, dim, table, axis): a row for each table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                axes = signed_axes(matrix(own.column("v")), tables, probes)
                flat = pa.array(axes.reshape(len(axes), -1).tolist(), pa.list_(pa.int32()))
                yield pa.record_batch([own.column("vec_id"), own.column("v"), own.column("dim"), flat], ["vec_id", "v", "dim", "axes"])

    done = rows.mapInArrow(run, "vec_id long, v array<double>, dim int, axes array<int>")
    filed = done.select("vec_id", "v", "dim", F.posexplode("axes").alias("place", "axis"))
    per_table = F.least(F.lit(probes), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("dim").cast("double"))) + 1)).cast("int")
    return filed.select("vec_id", "v", "dim", F.floor(F.col("place") / per_table).cast("int").alias("table"), "axis")


def _search(members: DataFrame, asked: DataFrame, k: int, parts: DataFrame) -> DataFrame:
    """Exact distances inside each part of a bucket; the ``k`` nearest of each query and part."""
    key = ["dim", "table", "axis"]
    left = members.join(parts, key).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    right = asked.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).drop("parts")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        if not have.num_rows or not want.num_rows:
            return schema.empty_table()
        have = have.sort_by("vec_id")
        x, ids, out = matrix(have.column("v")), have.column("vec_id").to_numpy(), []
        first = np.flatnonzero(np.append(True, np.diff(ids) != 0))
        ids = ids[first]
        for q, query in zip(want.column("vec_id").to_pylist(), matrix(want.column("v"))):
            score = np.minimum.reduceat(np.sqrt(((x - query) ** 2).sum(axis=1)), first)
            other = np.flatnonzero(ids != q)
            if len(other) > k:
                other = other[score[other] <= np.partition(score[other], k - 1)[k - 1]]
            top = other[np.lexsort((ids[other], score[other]))[:k]]
            out.append((np.full(len(top), q), ids[top], score[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    group = [*key, "part"]
    return left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query, by Euclidean distance.

    Both inputs have vec_id and embedding; other columns are not read. Vectors that are null, zero or hold null or
    non-finite components take no part. Rows with the query's id are its own and no candidates; an id that
    repeats counts once, with its nearest vector. Vectors meet those of their own length only. A query
    with fewer than ``k`` finds visits all axes of one table, and so every vector. Every vector is indexed.
    """
    members = cut(_filed(usable(table, zero=False), 1, tables))
    # One row for each bucket of each table: fixed by the dimension.
    parts = cut(members.groupBy("dim", "table", "axis").agg(F.ceil(F.count("*") / PART).alias("parts")))
    asked = usable(queries, zero=False)
    found = cut(best(_search(members, _filed(asked, probes, tables), k, parts), k, highest=False))
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut(asked.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    every = short.withColumn("table", F.lit(0)).join(parts.filter("table = 0").select("dim", "axis"), "dim")
    rest = best(_search(members.filter("table = 0"), every, k, parts), k, highest=False)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
