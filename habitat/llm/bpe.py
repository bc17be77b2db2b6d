"""Byte-level BPE through a global shuffle of distinct words.

Texts are cut into pre-tokens. A block, some millions of them in one task, numbers its distinct words; a document becomes
the sequence of its words' numbers, in order of position. The distinct words of all blocks are shuffled by hash, so
that each meets its copies and is encoded once. The ids go back to the blocks, where the
sequences turn into token ids. Decoding joins ids with the token-byte table, which has the
fixed size of the vocabulary, inside each task.

A block is computed once for its words and once for its sequences, so ``docs`` must be the read of a
written table, whose partitions are the same both times; a block that comes out differently fails loudly.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.llm.common import give_back, giving_back, slices, whole_text

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A block ends at so many distinct words or pre-tokens.
BLOCK_WORDS, BLOCK_TOKENS = 300_000, 6_000_000
#: Text whose pre-tokens are Python strings at the same time.
FOUND_BYTES = 1 << 20
#: Text for each group of distinct words that are encoded together.
GROUP_BYTES = 16 << 20
#: Ids whose digests are taken at a time; a document's own stay together.
DIGEST_IDS = 1 << 20


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank, leftmost first, until no pair has a rank.

    The pairs wait in a heap over linked parts, so a long word takes n log n steps.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            rank = ranks.get(word[i:end[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))
        if before[i] >= 0:
            rank = ranks.get(word[before[i]:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes of unsigned numbers, plane by plane."""
    data = np.ascontiguousarray(values)
    return zstandard.compress(data.view(np.uint8).reshape(-1, data.itemsize).T.tobytes(), 3)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[tuple[int, list[bytes], np.ndarray, list[tuple]]]:
    """(id, words, group of each word, chunks of documents) of each block of a partition.

    A chunk has ids, numbers of pre-tokens and the packed sequence of word numbers.
    """
    words_of = regex.compile(public_tokenizers.PATTERN).findall
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    numbers, chunks, tokens, k = _Numbers(), [], 0, 0

    def close() -> tuple[int, list[bytes], np.ndarray, list[tuple]]:
        words = [w.encode("utf-8", "surrogatepass") for w in numbers]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        name = xxhash.xxh3_64_intdigest(hashes.tobytes() + np.array([part, k], dtype=np.int64).tobytes())
        return int(np.uint64(name).astype(np.int64)), words, (hashes % np.uint64(groups)).astype(np.uint32), chunks

    for batch in batches:
        for piece in slices(batch, "text", FOUND_BYTES):
            found = [words_of(t) for t in piece.column("text").to_pylist()]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            seq = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(found)), dtype=np.uint32, count=int(counts.sum()))
            chunks.append((piece.column("doc_id").to_pylist(), counts, _pack(seq)))
            tokens += len(seq)
            del found, seq
            if len(numbers) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                yield close()
                numbers, chunks, tokens, k = _Numbers(), [], 0, k + 1
    if chunks:
        yield close()


def _distinct_words(texts: DataFrame, groups: int) -> DataFrame:
    """(block, part, words): the distinct words of each block, by hash group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, group, _ in _blocks(batches, groups):
            order = np.argsort(group, kind="stable")
            parts, starts = np.unique(group[order], return_index=True)
            data = []
            for own in np.split(order, starts[1:]) if len(order) else []:
                mine = [words[i] for i in own.tolist()]
                sizes = _pack(np.array([len(w) for w in mine], dtype=np.uint32))
                data.append(len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(mine), 3))
            if data:
                yield pa.record_batch([pa.array([block] * len(data), pa.int64()), pa.array(parts.astype(np.int64)), pa.array(data, pa.binary())], ["block", "part", "words"])

    return texts.mapInArrow(giving_back(run), "block long, part long, words binary")


def _encode_words(distinct: DataFrame, ranks: str) -> DataFrame:
    """(block, part, ids): each distinct word of a group is encoded once, for all blocks that have it."""

    def encoded(table: pa.Table) -> pa.Table:
        table_of, known, out = load_ranks(ranks), {}, []
        for data in table.column("words").to_pylist():
            cut = 4 + int.from_bytes(data[:4], "little")
            ends = np.cumsum(_unpack(data[4:cut], np.uint32)).tolist()
            text, a, flat, counts = zstandard.decompress(data[cut:]), 0, [], []
            for b in ends:
                word = text[a:b]
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = merge(word, table_of)
                flat += ids
                counts.append(len(ids))
                a = b
            sizes = _pack(np.array(counts, dtype=np.uint32))
            out.append(len(sizes).to_bytes(4, "little") + sizes + _pack(np.array(flat, dtype=np.uint32)))
        return pa.table([table.column("block"), table.column("part"), pa.array(out, pa.binary())], ["block", "part", "ids"])

    def run(table: pa.Table) -> pa.Table:
        out = encoded(table)
        give_back()
        return out

    return distinct.groupBy("part").applyInArrow(run, "block long, part long, ids binary")


def _sequences(texts: DataFrame, groups: int) -> DataFrame:
    """(block, parts, docs, counts, seq): rows with the documents of each block; one row has the group of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["block", "parts", "docs", "counts", "seq"]
        for block, _, group, chunks in _blocks(batches, groups):
            rows = [(block, _pack(group), [], [], b"")] + [(block, None, ids, counts, seq) for ids, counts, seq in chunks]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(giving_back(run), "block long, parts binary, docs array<long>, counts array<long>, seq binary")


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids array<int>.

    Null texts are empty and have no ids. Repeated rows give repeated results; a null doc_id is kept. Other
    columns are not read. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(64, size // GROUP_BYTES)
    encoded = _encode_words(_distinct_words(texts, groups), ranks)

    def ids_of(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        parts = [p for p in left.column("parts").to_pylist() if p is not None]
        if not parts:
            if left.num_rows == 0:
                raise ValueError("a block of words without its sequences: the input changed between two reads")
            return schema.empty_table()
        group = _unpack(parts[0], np.uint32)
        size = np.zeros(len(group), dtype=np.int64)
        order = np.argsort(group, kind="stable")
        at = dict(zip(*(x.tolist() for x in np.unique(group[order], return_index=True))))
        answers = {}
        for part, data in zip(right.column("part").to_pylist(), right.column("ids").to_pylist()):
            cut = 4 + int.from_bytes(data[:4], "little")
            own = _unpack(data[4:cut], np.uint32)
            size[order[at[part]:at[part] + len(own)]] = own
            answers[part] = _unpack(data[cut:], np.uint32)
        if answers.keys() != at.keys():
            raise ValueError("sequences of a block without their words: the input changed between two reads")
        flat = np.concatenate([answers[p] for p in sorted(answers)]).astype(np.int32) if answers else np.zeros(0, dtype=np.int32)
        start = np.empty(len(group), dtype=np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        names, bounds, pieces, used = [], [0], [], 0
        del answers
        for ids, counts, seq in zip(*(left.column(c).to_pylist() for c in ("docs", "counts", "seq"))):
            if not ids:
                continue
            words = _unpack(seq, np.uint32)
            n = size[words]
            ends = np.cumsum(n)
            pieces.append(flat[np.repeat(start[words] - (ends - n), n) + np.arange(int(n.sum()))])
            edge = np.concatenate([[0], ends])[np.cumsum(counts)] + used
            names += ids
            bounds += edge.tolist()
            used = bounds[-1]
        del flat, start, size, group, order
        values = pa.array(np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32))
        del pieces
        # Arrays of 32-bit offsets; a block's ids stay far below their range.
        return pa.table([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)], schema=schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ids_of(left, right)
        give_back()
        return out

    return _sequences(texts, groups).groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, "doc_id long, ids array<int>")


def _token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary), by a join with the token-byte table inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(ranks).__getitem__
        for batch in batches:
            data = [b"".join(map(token, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.mapInArrow(giving_back(run), "doc_id long, data binary")


def _joined(table: pa.Array, ids: pa.Array, edges: np.ndarray) -> list[memoryview]:
    """The entries of ``table`` at ``ids``, those between two edges side by side."""
    taken = table.take(ids)
    _, offsets, data = taken.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64, count=len(taken) + 1)[edges].tolist() if len(taken) else [0] * len(edges)
    data = memoryview(data or b"")
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def digests(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = pa.array(_token_bytes(ranks), pa.large_binary())
        name = pa.array([b"%d," % i for i in range(len(token))], pa.large_binary())
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("ids")).fill_null(0), dtype=np.int64)
            part = (np.cumsum(sizes) - sizes) // DIGEST_IDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                ids, edges = batch.column("ids").slice(a, b - a).flatten(), np.append(0, np.cumsum(sizes[a:b]))
                # Each name ends with a comma; the last one of a document is left off.
                named = [hashlib.sha256(x[:-1]).hexdigest() for x in _joined(name, ids, edges)]
                plain = [hashlib.sha256(x).hexdigest() for x in _joined(token, ids, edges)]
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(named, pa.string()), pa.array(plain, pa.string())]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(giving_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
