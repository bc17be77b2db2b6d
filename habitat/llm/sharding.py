"""Shards of near-equal bytes by histogram sort.

A document's key is 24 bits of its text's hash, then 39 bits of its id's hash: equal texts lie together,
and a splitter can still fall inside a large group of them. Each pass counts the exact bytes and rows
below candidate keys in every partition; the sums narrow the range of each splitter until it is
within tolerance. Then one exchange sends every row to its piece of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitat.llm.common import clear_prefix, cut, whole_text

SHARDS = 40
#: Bytes that each row counts besides its text.
ROW_BYTES = 16
KEY_BITS, ID_BITS = 63, 39
#: Splitters may miss their place by this share of a shard; those of pieces by that of a piece.
TOLERANCE, PIECE_TOLERANCE = 0.001, 0.2
#: A shard is sorted in pieces of about so many bytes; the number of pieces, and so what the driver holds, is bounded.
PIECE_BYTES, MOST_PIECES = 32 << 20, 16_384
PROBES = 64


def sort_key(text: Column, doc_id: str = "doc_id") -> Column:
    high = F.shiftrightunsigned(F.xxhash64(text), 64 - (KEY_BITS - ID_BITS))
    low = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 64 - ID_BITS)
    return F.shiftleft(high, ID_BITS).bitwiseOR(low)


def _below(keyed: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe. Partitions send sums, one row per bucket between probes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1), np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column("key").to_numpy(), side="right")
            size += np.bincount(at, weights=batch.column("size").to_numpy(), minlength=len(size))
            rows += np.bincount(at, minlength=len(rows))
        full = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(full), pa.array(size[full].astype(np.int64)), pa.array(rows[full])], ["bucket", "size", "rows"])

    counts = keyed.select("key", "size").mapInArrow(run, "bucket long, size long, rows long")
    found = counts.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toPandas()
    out = np.zeros((2, len(probes) + 1), dtype=np.int64)
    out[:, found["bucket"].to_numpy(dtype=np.int64)] = found[["size", "rows"]].to_numpy(dtype=np.int64).T
    sums = out.cumsum(axis=1)
    return sums[0, :-1], sums[1, :-1]


@dataclass
class Splitters:
    """Sorted keys; a row lies in the range numbered by the keys that are not above its own."""

    keys: np.ndarray
    rows: np.ndarray


def _search(keyed: DataFrame, total: tuple[int, int], goals: np.ndarray, row_weight: np.ndarray, tolerance: np.ndarray) -> Splitters:
    """For each goal the key below which bytes + row_weight * rows come nearest to it, to the tolerance or to the last bit."""
    n = len(goals)
    low, high = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    under = np.zeros((2, n), dtype=np.int64)
    over = np.array(total, dtype=np.int64)[:, None].repeat(n, axis=1)
    opened = np.ones(n, dtype=bool)
    first = True
    while opened.any():
        if first:
            probes = np.linspace(0, float(1 << KEY_BITS), max(64 * PROBES, 8 * n) + 1)[1:-1].astype(np.int64)
        else:
            step = ((high[opened] - low[opened]) // (PROBES + 1)).clip(1)
            probes = (low[opened, None] + step[:, None] * np.arange(1, PROBES + 1)).ravel()
            probes = probes[(probes > low[opened].repeat(PROBES)) & (probes < high[opened].repeat(PROBES))]
        first = False
        probes = np.unique(probes)
        size, rows = _below(keyed, probes)
        for i in np.flatnonzero(opened):
            a, b = np.searchsorted(probes, low[i], side="right"), np.searchsorted(probes, high[i], side="left")
            weight = size[a:b] + row_weight[i] * rows[a:b]
            j = int(np.searchsorted(weight, goals[i], side="right"))
            if j > 0:
                low[i], under[:, i] = probes[a + j - 1], (size[a + j - 1], rows[a + j - 1])
            if j < b - a:
                high[i], over[:, i] = probes[a + j], (size[a + j], rows[a + j])
        miss = [np.abs(w[0] + row_weight * w[1] - goals) for w in (under, over)]
        opened &= (np.minimum(*miss) > tolerance) & (high - low > 1)
    nearer = miss[0] <= miss[1]
    return Splitters(np.where(nearer, low, high), np.where(nearer, under[1], over[1]))


def plan(keyed: DataFrame, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the shards' splitters, keys of all cuts, and the rows below each cut."""
    size, rows = keyed.agg(F.sum("size"), F.count("*")).first()
    size, rows = int(size or 0), int(rows)
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    pieces = int(min(max(size // PIECE_BYTES, 4 * shards), max(MOST_PIECES, shards)))
    mean = 3 * size / rows  # mostly by rows, so that a piece of short copies does not hold many more of them
    goals = np.concatenate([size * np.arange(1, shards) / shards, (size + mean * rows) * np.arange(1, pieces) / pieces])
    weight = np.concatenate([np.zeros(shards - 1), np.full(pieces - 1, mean)])
    tolerance = np.concatenate([np.full(shards - 1, TOLERANCE * size / shards), np.full(pieces - 1, PIECE_TOLERANCE * (size + mean * rows) / pieces)])
    found = _search(keyed, (size, rows), goals, weight, tolerance)
    cuts, at = np.unique(found.keys, return_index=True)
    return np.sort(found.keys[:shards - 1]), cuts, found.rows[at]


def assign(keyed: DataFrame, splitters: tuple[np.ndarray, np.ndarray, np.ndarray], key: str = "key", prefix: str = "") -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have their key; the rows are exchanged once, by piece."""
    bounds, cuts, rows = splitters

    @F.pandas_udf("piece int, shard int, start long")
    def place(keys: pd.Series) -> pd.DataFrame:
        keys = keys.to_numpy()
        piece, shard = np.searchsorted(cuts, keys, side="right"), np.searchsorted(bounds, keys, side="right")
        below = np.concatenate([[0], rows])
        # Every shard's splitter is a cut, so the rows below it are known.
        base = np.concatenate([[0], below[np.searchsorted(cuts, bounds, side="right")]])
        return pd.DataFrame({"piece": piece.astype(np.int32), "shard": shard.astype(np.int32), "start": below[piece] - base[shard]})

    at = prefix + "at"
    within = Window.partitionBy(f"{at}.piece").orderBy(key, F.col(f"{prefix}id"))
    slot = (F.col(f"{at}.start") + F.row_number().over(within) - 1).cast("long")
    return keyed.withColumn(at, place(F.col(key))).withColumn(f"{prefix}slot", slot).withColumn(f"{prefix}shard", F.col(f"{at}.shard")).drop(at)


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text()
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), sort_key(text).alias("key"))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts are empty. Rows that repeat both id and text have one key and lie in one shard. With fewer
    rows than shards some shards stay empty; an empty table gives no rows. Other columns are not read.
    """
    keyed = cut(_keyed(docs))
    placed = assign(keyed, plan(keyed, shards))
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with all columns, and ``shard`` and ``slot`` (columns of those names are replaced)."""
    splitters = plan(cut(_keyed(docs).select("size", "key")), shards)
    own = clear_prefix(docs)
    keyed = docs.withColumn(own + "key", sort_key(whole_text())).withColumn(own + "id", F.col("doc_id"))
    placed = assign(keyed, splitters, own + "key", own)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*keep, F.col(own + "shard").alias("shard"), F.col(own + "slot").alias("slot"))
