"""Hard negatives from an inverted multi-index, exact.

Vectors are cut into two halves and each half is filed under its nearest code of a codebook of its own, so a pair of
codes names a cell. For a code, the inner product of the anchor's half with the centre, plus the lengths of that half and of
the largest residual multiplied, bounds what any row of the code can score in this half; two such bounds add up to
the bound of a cell. A heap over the two sorted lists of half bounds (the multi-sequence) gives the cells by falling
bound and stops at the first cell below the anchor's bar: no row behind it can matter.

Bars come from a bounded sample of rows. In the first pass the bar is the last of the sample's best positives. In the
second one the windows of scores are known, and the bar of each is the last of the sample's best rows inside it, or else
its lower end. Any bar taken from real rows is safe: the true list ends at it or above. So the sample moves cost, never results.

Cells are packed into blocks of bounded size, larger cells are cut into parts, and an anchor goes only to blocks that hold
cells it visits. Where vectors have no clusters (random ones in many dimensions) the bounds are wide and nearly every cell is visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from habitat.llm.common import cut
from habitat.llm.vectors import matrix

SCALE = 256
#: Rows that the codebooks are fitted on and, among them, rows that bars come from (those of least hash).
SAMPLE, BAR_ROWS = 20_000, 4_096
#: Rows aimed at in a cell, most codes of a half, rounds of the fit.
CELL_ROWS, MOST_CODES, ROUNDS = 256, 128, 6
#: Numbers in a block of rows, anchors that a block meets at a time, scores held at a time.
BLOCK_VALUES, ASKED, TILE = 1 << 21, 8_192, 1 << 20
#: Multiplier that spreads ids over chunks.
SPREAD = 0x9E3779B97F4A7C15
#: Below any score, and above any.
LOW, HIGH = -(2**62), 2**62


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: in floats where all sums stay whole numbers there."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def prepare(table: DataFrame) -> DataFrame:
    """(vec_id, label, v array<long>, dim): the rows that take part, one for each id."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id is not null and label is not null and v is not null").filter(~bad & (F.size("v") > 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")))
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return least.select("vec_id", "r.label", "r.v", F.size("r.v").alias("dim"))


def _codes(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of at most ``k`` groups of the rows, by a few rounds of nearest centres and means."""
    centres = x[np.random.default_rng(7).permutation(len(x))[:k]].astype(np.float64)
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centres, centres) - 2 * (x @ centres.T)).argmin(axis=1)


class Index:
    """Codebooks, largest residuals, cells and blocks of the rows of one length; all of bounded size."""

    def __init__(self, centres: list[np.ndarray]) -> None:
        self.centres = centres
        self.radii = [np.zeros(len(c)) for c in centres]
        self.rows = np.zeros((len(centres[0]), len(centres[1])), dtype=np.int64)
        self.block = np.zeros_like(self.rows)
        self.parts = np.ones_like(self.rows)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        cut_at = self.centres[0].shape[1]
        return [x[:, :cut_at].astype(np.float64), x[:, cut_at:].astype(np.float64)]

    def file(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Codes and lengths of the residuals of both halves."""
        codes, left = [], []
        for half, centres in zip(self.halves(x), self.centres):
            codes.append(_nearest(half, centres))
            left.append(np.linalg.norm(half - centres[codes[-1]], axis=1))
        return codes, left

    def lay_out(self, size: int, first: int) -> int:
        """Number the blocks from ``first`` on: cells side by side up to ``size`` rows, larger ones in parts of their own."""
        at, held = first, 0
        for i, j in zip(*np.nonzero(self.rows)):
            n = int(self.rows[i, j])
            parts = -(-n // size)
            if held and held + n > size:
                at, held = at + 1, 0
            self.block[i, j], self.parts[i, j] = at, parts
            if parts > 1:
                at += parts
            else:
                held += n
        return at + 1

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """What a row of each code can score in each half at the most, for each anchor."""
        return [
            half @ centres.T + np.linalg.norm(half, axis=1)[:, None] * radii
            for half, centres, radii in zip(self.halves(anchors), self.centres, self.radii)
        ]


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs of codes by falling sum of their half bounds: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    left, right = first[a].tolist(), second[b].tolist()
    heap = [(-(left[0] + right[0]), 0, 0)]
    while heap:
        bound, x, y = heappop(heap)
        yield -bound, a[x], b[y]
        if y + 1 < len(b):
            heappush(heap, (-(left[x] + right[y + 1]), x, y + 1))
        if y == 0 and x + 1 < len(a):
            heappush(heap, (-(left[x + 1] + right[0]), x + 1, 0))


def visited(first: np.ndarray, second: np.ndarray, bar: int) -> list[tuple[int, int]]:
    """The cells whose rows can reach ``bar``; the heap stops at the first bound that is certainly lower."""
    out = []
    for bound, i, j in cells_by_bound(first, second):
        if bound + 1e-6 * (1 + abs(bound)) < bar:
            break
        out.append((i, j))
    return out


def build(rows: DataFrame) -> tuple[DataFrame, dict[int, Index], DataFrame]:
    """The rows with cell and block, the index for each length of vectors, and the rows that bars come from.

    To the driver come codebooks (fitted on ``SAMPLE`` rows), one row for each cell, and for lengths that the sample missed one cell each.
    """
    sample = cut(rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE))
    most = max(1, min(MOST_CODES, int((rows.count() / CELL_ROWS) ** 0.5)))

    def fit(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(found.sort_values("vec_id")["v"].to_list()).astype(np.float64)
        at = x.shape[1] // 2
        codes = [_codes(h, most) for h in (x[:, :at], x[:, at:])]
        return pd.DataFrame([(int(key[0]), h, list(c)) for h in range(2) for c in codes[h]], columns=["dim", "half", "centre"])

    books: dict[int, Index] = {}
    fitted = sample.groupBy("dim").applyInPandas(fit, "dim int, half int, centre array<double>").collect()
    for dim in {r.dim for r in fitted}:
        own = [[r.centre for r in fitted if r.dim == dim and r.half == h] for h in range(2)]
        books[dim] = Index([np.array(c, dtype=np.float64).reshape(len(c), -1 if len(c[0]) else 0) for c in own])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                book = books.get(int(dim)) or _plain(int(dim))
                codes, left = book.file(matrix(mine.column("v"), np.int64))
                columns = [*mine.columns, *(pa.array(c.astype(np.int32)) for c in codes), *(pa.array(r) for r in left)]
                yield pa.record_batch(columns, [*mine.schema.names, "i", "j", "r1", "r2"])

    filed = cut(rows.mapInArrow(file, "vec_id long, label long, v array<long>, dim int, i int, j int, r1 double, r2 double"))
    at = 0
    for c in filed.groupBy("dim", "i", "j").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect():
        book = books.setdefault(c.dim, _plain(c.dim))
        book.rows[c.i, c.j] = c.n
        book.radii[0][c.i] = max(book.radii[0][c.i], c.r1)
        book.radii[1][c.j] = max(book.radii[1][c.j], c.r2)
    for dim in sorted(books):
        at = books[dim].lay_out(max(256, BLOCK_VALUES // dim), at)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, i, j, salt = (batch.column(c).to_numpy() for c in ("dim", "i", "j", "salt"))
            block, cell = np.zeros(len(dims), dtype=np.int64), np.zeros(len(dims), dtype=np.int32)
            for dim in np.unique(dims):
                own, book = dims == dim, books[int(dim)]
                block[own] = book.block[i[own], j[own]] + salt[own] % book.parts[i[own], j[own]]
                cell[own] = i[own] * book.rows.shape[1] + j[own]
            yield pa.record_batch([pa.array(block), pa.array(cell), *(batch.column(c) for c in ("vec_id", "label", "v"))], ["block", "cell", "vec_id", "label", "v"])

    salted = filed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    placed = salted.mapInArrow(place, "block long, cell int, vec_id long, label long, v array<long>")
    return placed, books, sample.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(BAR_ROWS)


def _plain(dim: int) -> Index:
    """One cell for vectors of a length that the sample does not hold."""
    return Index([np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))])


def _tops(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each owner: highest score, then smallest id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    return order[rank < k]


def _tiles(x: np.ndarray, anchors: np.ndarray, visits: list[tuple[slice, np.ndarray]]) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
    """(anchors, rows, scores), at most about ``TILE`` scores at a time."""
    for rows, who in visits:
        n = max(1, rows.stop - rows.start)
        step = max(1, TILE // n)
        for at in range(0, len(who), step):
            some = who[at : at + step]
            yield some, rows, products(anchors[some], x[rows])


def _ask(placed: DataFrame, anchors: DataFrame, books: dict[int, Index], bar_of: Callable[[pa.RecordBatch], np.ndarray],
         extra: list[tuple[str, pa.DataType]], kernel: Callable, schema: pa.Schema, many: int) -> DataFrame:
    """Send the anchors (with columns ``extra``) to the blocks of the cells they visit; ``kernel`` finds their rows in a block."""
    names = [n for n, _ in extra]
    sent = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())),
                      ("cells", pa.list_(pa.int32())), *extra])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                book, bars = books[int(dim)], bar_of(mine)
                first, second = book.bounds(matrix(mine.column("v"), np.int64))
                at, block, chunk, cells = [], [], [], []
                for n, own in enumerate(mine.column("vec_id").to_pylist()):
                    wanted: dict[int, list[int]] = {}
                    for i, j in visited(first[n], second[n], bars[n]):
                        if book.rows[i, j]:
                            for part in range(book.parts[i, j]):
                                wanted.setdefault(int(book.block[i, j]) + part, []).append(i * book.rows.shape[1] + j)
                    for b, c in wanted.items():
                        at.append(n)
                        block.append(b)
                        chunk.append((own * SPREAD >> 32) % many)
                        cells.append(c)
                take = pa.array(at, pa.int64())
                yield pa.record_batch(
                    [pa.array(block, pa.int64()), pa.array(chunk, pa.int32()), *(mine.column(c).take(take) for c in ("vec_id", "label", "v")),
                     pa.array(cells, pa.list_(pa.int32())), *(mine.column(c).take(take) for c in names)], schema=sent)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        rows = rows.sort_by([("cell", "ascending")])
        cell = rows.column("cell").to_numpy()
        who = np.repeat(np.arange(asked.num_rows), np.asarray([len(c) for c in asked.column("cells").to_pylist()]))
        where = asked.column("cells").combine_chunks().flatten().to_numpy()
        order = np.argsort(where, kind="stable")
        who, where = who[order], where[order]
        visits = []
        for c in np.unique(where):
            a, b = np.searchsorted(cell, [c, c + 1])
            x, y = np.searchsorted(where, [c, c + 1])
            if b > a:
                visits.append((slice(int(a), int(b)), who[x:y]))
        return kernel(rows, asked, _tiles(matrix(rows.column("v"), np.int64), matrix(asked.column("v"), np.int64), visits))

    types = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    ddl = ", ".join(f"{f.name} {types[f.type]}" for f in sent)
    routed = anchors.mapInArrow(route, ddl)
    left = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))) if many > 1 else placed.withColumn("chunk", F.lit(0))
    out = ", ".join(f"{f.name} {types[f.type]}" for f in schema)
    return left.groupBy("block", "chunk").cogroup(routed.groupBy("block", "chunk")).applyInArrow(run, out)


def hard_negatives(table: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``table`` has vec_id, embedding and label; other columns are not read, ``anchors`` is an SQL condition on vec_id. Components
    become floor(256 x); a row's score is its inner product with the anchor (which must fit a long). An anchor's
    positives are its ``positives`` best other rows of its label; for each, the ``negatives`` best rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score are returned. Ties go to the smaller vec_id.

    Rows with a null id, label or vector, an empty one, or a null or non-finite component take no part. Of rows that repeat
    an id one takes part, that of least label and then least vector. Vectors meet those of their own length only.
    Fewer rows than asked for are all returned; a positive without any gives no row, and an empty table none.
    """
    rows = cut(prepare(table))
    placed, books, sample = build(rows)
    chosen = rows.filter(anchors)
    many = max(1, -(-chosen.count() // ASKED))
    # Bounded by BAR_ROWS.
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    bar_rows = sample.collect()
    for dim in {r.dim for r in bar_rows}:
        own = [r for r in bar_rows if r.dim == dim]
        known[dim] = np.array([r.v for r in own], dtype=np.int64), np.array([r.vec_id for r in own]), np.array([r.label for r in own])

    def sampled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores with the sample's rows, and which of them are others of the same and of another label."""
        v, ids, labels = matrix(batch.column("v"), np.int64), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        x, own, of = known.get(v.shape[1], (np.zeros((0, v.shape[1]), dtype=np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return products(v, x), (of == labels[:, None]) & (own != ids[:, None]), of != labels[:, None]

    def kth(score: np.ndarray, k: int, low_end: np.ndarray) -> np.ndarray:
        """The ``k``-th highest of each row, or ``low_end`` where that is higher."""
        if score.shape[1] < k:
            return low_end
        return np.maximum(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k], low_end)

    # First pass: the best rows of the same label.
    def with_bar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                score, same, _ = sampled(mine)
                bar = kth(np.where(same, score, LOW), positives, np.full(mine.num_rows, LOW))
                yield pa.record_batch([*mine.columns, pa.array(bar)], [*mine.schema.names, "bar"])

    barred = chosen.mapInArrow(with_bar, "vec_id long, label long, v array<long>, dim int, bar long")
    found = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def best_same(mine: pa.Table, asked: pa.Table, tiles: Iterator) -> pa.Table:
        ids, label = mine.column("vec_id").to_numpy(), mine.column("label").to_numpy()
        who, of, bar = asked.column("vec_id").to_numpy(), asked.column("label").to_numpy(), asked.column("bar").to_numpy()
        held = [np.zeros(0, dtype=np.int64)] * 3
        for some, at, score in tiles:
            good = (label[at] == of[some][:, None]) & (ids[at] != who[some][:, None]) & (score >= bar[some][:, None])
            a, r = np.nonzero(good)
            held = [np.concatenate(p) for p in zip(held, (who[some][a], ids[at][r], score[a, r]))]
            if len(held[0]) > TILE:
                held = [h[_tops(held[0], held[2], held[1], positives)] for h in held]
        kept = _tops(held[0], held[2], held[1], positives)
        return pa.table([pa.array(h[kept]) for h in held], schema=found)

    pairs = _ask(placed, barred, books, lambda b: b.column("bar").to_numpy(), [("bar", pa.int64())], best_same, found, many)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id")
    tops = cut(pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives))

    # Second pass: the best rows of other labels inside each positive's window.
    listed = tops.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p"))
    windows = chosen.join(listed, F.col("vec_id") == F.col("anchor_id"))
    windows = windows.select("vec_id", "label", "v", "dim", F.col("p.positive_id").alias("pos"), F.col("p.score").alias("scores"))

    def padded(column: pa.Array, fill: int) -> np.ndarray:
        return np.array([x + [fill] * (positives - len(x)) for x in column.to_pylist()], dtype=np.int64).reshape(-1, positives)

    def ends(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest whole score of each window; one that holds nothing ends before it starts."""
        real = scores != LOW
        safe = np.where(real, scores, 0)
        return np.where(real, -(-low * safe // 100), HIGH), np.where(real, high * safe // 100, LOW)

    def with_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                score, _, other = sampled(mine)
                least, most = ends(padded(mine.column("scores"), LOW))
                for w in range(positives):
                    inside = other & (score <= most[:, w][:, None]) & (score >= least[:, w][:, None])
                    least[:, w] = kth(np.where(inside, score, LOW), negatives, least[:, w])
                least = np.where(least > most, HIGH, least)
                lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in (least, most)]
                yield pa.record_batch([*(mine.column(c) for c in ("vec_id", "label", "v", "dim", "pos")), *lists],
                                      ["vec_id", "label", "v", "dim", "pos", "least", "most"])

    barred = windows.mapInArrow(with_bars, "vec_id long, label long, v array<long>, dim int, pos array<long>, least array<long>, most array<long>")
    result = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def best_other(mine: pa.Table, asked: pa.Table, tiles: Iterator) -> pa.Table:
        ids, label = mine.column("vec_id").to_numpy(), mine.column("label").to_numpy()
        who, of = asked.column("vec_id").to_numpy(), asked.column("label").to_numpy()
        pos, least, most = padded(asked.column("pos"), 0), padded(asked.column("least"), HIGH), padded(asked.column("most"), LOW)
        floor, roof = least.min(axis=1), most.max(axis=1)
        held = [np.zeros(0, dtype=np.int64)] * 3

        def tightest(h: list[np.ndarray]) -> list[np.ndarray]:
            kept = _tops(h[0], h[2], h[1], negatives)
            return [x[kept] for x in h]

        for some, at, score in tiles:
            good = (label[at] != of[some][:, None]) & (score >= floor[some][:, None]) & (score <= roof[some][:, None])
            a, r = np.nonzero(good)
            s = score[a, r]
            for w in range(positives):
                own = some[a]
                fit = (s >= least[own, w]) & (s <= most[own, w])
                held = [np.concatenate(p) for p in zip(held, (own[fit] * positives + w, ids[at][r[fit]], s[fit]))]
            if len(held[0]) > TILE:
                held = tightest(held)
        slot, negative, score = tightest(held)
        return pa.table([pa.array(who[slot // positives]), pa.array(pos[slot // positives, slot % positives]), pa.array(negative), pa.array(score)], schema=result)

    def lowest(batch: pa.RecordBatch) -> np.ndarray:
        return padded(batch.column("least"), HIGH).min(axis=1)

    lists = pa.list_(pa.int64())
    near = _ask(placed, barred, books, lowest, [("pos", lists), ("least", lists), ("most", lists)], best_other, result, many)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    scored = tops.select("anchor_id", "positive_id", F.col("score").alias("positive_score"))
    out = near.join(scored, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
