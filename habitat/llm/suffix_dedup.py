"""Remove bytes of repeated 100-byte strings, found in suffix orders.

Every 100-byte string has one anchor: of its 32-byte strings the one with the least hash. So equal strings share their
anchor, and an anchor with the text around it, a slice, stands for the run of strings that it anchors.

1. Anchors are counted by key; those that occur once are done with.
2. Of equal slices all but the earliest repeat it whole.
3. Where an anchor has several slices, these are suffix-sorted together by linear grouping construction;
   neighbours in that order with a common prefix of 100 bytes are equal strings, and all but the
   earliest of them repeat. An anchor with many slices is sorted in blocks, whose
   earliest strings then meet by their 128-bit digests.

Nothing of an anchor is gathered in one task but a block of slices; copies are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.llm.common import cut, map_slices, whole_text
from habitat.llm.grouping import suffix_orders

LENGTH, KMER = 100, 32
#: Strings whose anchors are compared at a time; 23 bits hold their places.
CHUNK, PLACE_BITS = 4 << 20, 23
#: Bytes of short texts whose anchors are found side by side.
BESIDE = 256 << 10
#: Slices in a block, and bytes of slices for a task's group.
BLOCK, GROUP_BYTES = 32, 4 << 20
#: Cells that are sorted side by side.
CELLS = 1 << 20
_BYTE = np.random.default_rng(77).integers(0, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of KMER bytes, by doubling their length."""
    h, s, factor = _BYTE[data], 1, np.array([_FACTOR])
    while s < KMER:
        h = h[:-s] * factor + h[s:]
        factor = factor * factor
        s *= 2
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _anchor_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each string of KMER bytes, and for each of LENGTH bytes the place of the least of them in it."""
    key = _kmer_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, s, width = (key & ~low) | np.arange(len(key), dtype=np.uint64), 1, LENGTH - KMER + 1
    while 2 * s <= width:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if s < width:
        least = np.minimum(least[:s - width], least[width - s:])
    return key, (least & low).astype(np.int64)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last) of each anchor: ``first`` and ``last`` are the starts of the strings that it anchors."""
    parts = []
    for a in range(0, len(data) - LENGTH + 1, CHUNK):
        own = np.frombuffer(data, dtype=np.uint8)[a:a + CHUNK + LENGTH - 1]
        key, place = _anchor_places(own)
        edge = np.flatnonzero(np.diff(place)) + 1
        first, last = np.append(0, edge), np.append(edge - 1, len(place) - 1)
        parts.append((key[place[first]].astype(np.int64), place[first] + a, first + a, last + a))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _all_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, key, place, first, last) of the anchors of several texts, those of ``anchors``; short texts are handled side by side."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= BESIDE):
            size += len(texts[b])
            b += 1
        sizes = np.fromiter(map(len, texts[a:b]), dtype=np.int64, count=b - a)
        if size > BESIDE:
            key, place, first, last = anchors(texts[a])
            yield np.full(len(key), a), key, place, first, last
        elif size >= LENGTH:
            key, place = _anchor_places(np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8))
            ends = np.cumsum(sizes)
            text = np.repeat(np.arange(b - a), sizes)[:len(place)]
            # Strings that lie in one text.
            start = np.flatnonzero(np.arange(len(place)) + LENGTH <= ends[text])
            if len(start):
                edge = np.flatnonzero(np.diff(place[start])) + 1
                first, last = start[np.append(0, edge)], start[np.append(edge - 1, len(start) - 1)]
                text, place = text[first], place[first]
                begin = (ends - sizes)[text]
                yield text + a, key[place].astype(np.int64), place - begin, first - begin, last - begin
        a = b


def _keys(texts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [key for _, key, _, _, _ in _all_anchors(batch.column("data").to_pylist())]
        return pa.record_batch([pa.array(np.concatenate(found))], ["key"]) if found else None

    return map_slices(texts.select("data"), run, "key long", text="data")


def _slices(texts: DataFrame) -> DataFrame:
    """(key, slice, doc, first, last): the slice by a hash of its bytes and of the anchor's place in them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        own, found = batch.column("data").to_pylist(), []
        docs = np.array(batch.column("doc").to_pylist(), dtype=np.int64)
        for text, key, place, first, last in _all_anchors(own):
            ends, seeds = (last + LENGTH).tolist(), (place - first).tolist()
            digest = [xxhash.xxh3_64_intdigest(own[t][a:b], p) for t, a, b, p in zip(text.tolist(), first.tolist(), ends, seeds)]
            found.append((key, np.array(digest, dtype=np.uint64).astype(np.int64), docs[text], first, last))
        columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
        return pa.record_batch(columns, ["key", "slice", "doc", "first", "last"]) if found else None

    return map_slices(texts, run, "key long, slice long, doc long, first long, last long", text="data")


def _packed(texts: DataFrame) -> DataFrame:
    """The same rows with ``data`` compressed for the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        data = pa.array([pack(t) for t in batch.column("data").to_pylist()], pa.binary())
        return batch.set_column(batch.schema.get_field_index("data"), "data", data)

    return map_slices(texts, run, texts.schema, text="data")


def _repeats(blocks: list[tuple[list[bytes], list[int], list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For sets of blocks (slices, docs, first starts): block number, slice number, start in the slice and whether it repeats an earlier string.

    Blocks of like size are sorted side by side. Slices are joined by the symbol 1 and end with 0; shorter texts are
    filled in front with a symbol above all others.
    """
    length = [sum(map(len, b[0])) + len(b[0]) + 1 for b in blocks]
    by_size = np.argsort(length, kind="stable")[::-1]
    a = 0
    while a < len(by_size):
        n = length[by_size[a]]
        b = a + 1
        while b < len(by_size) and (b - a) * n < CELLS and length[by_size[b]] * 10 >= 8 * n:
            b += 1
        chosen = by_size[a:b].tolist()
        a = b
        text = np.full((len(chosen), n), 258, dtype=np.int64)
        piece = np.full((len(chosen), n), -1, dtype=np.int32)
        start = np.zeros((len(chosen), n), dtype=np.int32)
        for row, k in enumerate(chosen):
            at = n - length[k]
            for i, s in enumerate(blocks[k][0]):
                text[row, at:at + len(s)] = np.frombuffer(s, dtype=np.uint8).astype(np.int64) + 2
                text[row, at + len(s)] = 1
                piece[row, at:at + len(s) - LENGTH + 1] = i
                start[row, at:at + len(s) - LENGTH + 1] = np.arange(len(s) - LENGTH + 1)
                at += len(s) + 1
            text[row, n - 1] = 0
        order = suffix_orders(text)
        row, rank = np.nonzero(np.take_along_axis(piece, order.astype(np.int64), axis=1) >= 0)
        at = order[row, rank].astype(np.int64)
        cells = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16).ravel(), LENGTH)
        spot = row * n + at
        same = np.zeros(len(spot), dtype=bool)
        for c in range(1, len(spot), 1 << 16):
            d = min(len(spot), c + (1 << 16))
            same[c:d] = (row[c:d] == row[c - 1:d - 1]) & (cells[spot[c:d]] == cells[spot[c - 1:d - 1]]).all(axis=1)
        kind = np.cumsum(~same)
        number, own, offset = np.array(chosen)[row], piece[row, at].astype(np.int64), start[row, at].astype(np.int64)
        place = (np.cumsum([0] + [len(blocks[k][1]) for k in chosen[:-1]]))[row] + own
        doc, base = (np.concatenate([np.array(blocks[k][c], dtype=np.int64) for k in chosen])[place] for c in (1, 2))
        by = np.lexsort((base + offset, doc, kind))
        repeated = np.ones(len(by), dtype=bool)
        repeated[by[np.append(True, np.diff(kind[by]) != 0)]] = False
        yield number, own, offset, repeated


def _sort_blocks(slices: DataFrame, groups: int) -> DataFrame:
    """(doc, first, last) of the runs of repeats, and (digest, doc, first) of the earliest strings of keys with several blocks."""
    schema = pa.schema([("doc", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("digest", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("block", "ascending"), ("doc", "ascending"), ("first", "ascending")])
        key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        texts, docs, firsts = (table.column(c).to_pylist() for c in ("bytes", "doc", "first"))
        several = table.column("blocks").to_numpy() > 1
        edges = np.append(np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(block) != 0))), len(key)).tolist()
        blocks = [(texts[a:b], docs[a:b], firsts[a:b]) for a, b in zip(edges, edges[1:])]
        out: list[tuple] = []
        for number, own, offset, repeated in _repeats(blocks):
            row = np.array(edges)[number] + own
            by = np.lexsort((offset, row))
            by = by[repeated[by]]
            if len(by):
                new = np.append(True, (np.diff(row[by]) != 0) | (np.diff(offset[by]) != 1))
                first, last = by[new], by[np.append(np.flatnonzero(new)[1:], len(by)) - 1]
                out += [(docs[r], firsts[r] + a, firsts[r] + b, None) for r, a, b in zip(row[first].tolist(), offset[first].tolist(), offset[last].tolist())]
            for r, a in zip(*(x[~repeated & several[row]].tolist() for x in (row, offset))):
                out.append((docs[r], firsts[r] + a, firsts[r] + a, xxhash.xxh3_128_digest(texts[r][a:a + LENGTH])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out else schema.empty_table()

    grouped = slices.withColumn("group", F.pmod(F.xxhash64("key", "block"), F.lit(groups)))
    return grouped.groupBy("group").applyInArrow(run, "doc long, first long, last long, digest binary")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, id, data): ``doc`` orders the documents.

    That is doc_id itself, unless an id is null or has several texts: then texts are numbered by id, null last, and by text hash.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    hashed = texts.select("id", F.xxhash64("text").alias("h"))
    odd = hashed.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("id is null or lo <> hi")
    if odd.isEmpty():
        return texts.select(F.col("id").alias("doc"), "id", F.col("text").cast("binary").alias("data"))
    ranked = hashed.distinct().orderBy(F.col("id").asc_nulls_last(), "h").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    places = cut(docs.sparkSession.createDataFrame(ranked, "at long, h long, doc long"))
    return cut(texts.withColumn("own", F.xxhash64("text")).join(places, F.col("id").eqNullSafe(F.col("at")) & (F.col("own") == F.col("h"))).select("doc", "id", F.col("text").cast("binary").alias("data")))


def repeats(texts: DataFrame) -> DataFrame:
    """(doc, first, last): starts of 100-byte strings that also start earlier, in runs."""
    source = texts.select("doc", "data")
    often = _keys(source).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    found = cut(_slices(source).join(often, "key"))
    heads = cut(found.groupBy("key", "slice").agg(F.min(F.struct("doc", "first", "last")).alias("head")))
    copies = found.join(heads, ["key", "slice"]).filter("struct(doc, first) > struct(head.doc, head.first)").select("doc", "first", "last")
    kinds = heads.groupBy("key").agg(F.count("*").alias("slices")).filter("slices > 1")
    asked = cut(heads.join(kinds, "key").select("key", "slice", "head.doc", "head.first", "head.last", F.ceil(F.col("slices") / BLOCK).alias("blocks")))
    total = asked.agg(F.sum(F.col("last") - F.col("first") + LENGTH)).first()[0] or 0
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("key", "slice", "first", "last", "blocks")).alias("asked"))

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack, rows = zstandard.ZstdDecompressor().decompress, []
        for doc, data, each in zip(*(batch.column(c).to_pylist() for c in ("doc", "data", "asked"))):
            data = unpack(data)
            rows += [(r["key"], r["slice"] % r["blocks"], r["blocks"], doc, r["first"], data[r["first"]:r["last"] + LENGTH]) for r in each]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "block", "blocks", "doc", "first", "bytes"])

    # Rows of one document and text are one; each gives its slices once.
    once = _packed(source).join(wanted, "doc").dropDuplicates(["doc"])
    slices = map_slices(once, fetch, "key long, block long, blocks long, doc long, first long, bytes binary", text="data")
    sorted_ = cut(_sort_blocks(slices, max(1, total // GROUP_BYTES)))
    heads = sorted_.filter("digest is not null")
    earliest = heads.groupBy("digest").agg(F.min(F.struct("doc", "first")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    late = heads.join(earliest, "digest").filter("struct(doc, first) > head").select("doc", "first", "last")
    return copies.unionByName(sorted_.filter("digest is null").select("doc", "first", "last")).unionByName(late)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Null texts are empty; texts under 100 bytes lose nothing. Rows that repeat id and text are one document and share its
    result. Texts that share an id count as documents one after another, by a hash of the text; null ids come last.
    ``kept`` has the remaining bytes. An empty table gives no rows; other columns are not read.
    """
    texts = _texts(docs)
    runs = cut(repeats(texts)).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack, rows = zstandard.ZstdDecompressor().decompress, []
        for data, each in zip(*(batch.column(c).to_pylist() for c in ("data", "runs"))):
            data = np.frombuffer(unpack(data), dtype=np.uint8)
            edge = np.zeros(len(data) + 1, dtype=np.int64)
            if each:
                np.add.at(edge, [r["first"] for r in each], 1)
                np.add.at(edge, [r["last"] + LENGTH for r in each], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = data[~gone].tobytes()
            spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
            rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        columns = [batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
        return pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return map_slices(_packed(texts).join(runs, "doc", "left"), run, schema, text="data")

