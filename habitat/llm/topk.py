"""Exact top-k by inner product over impact-ordered posting segments, score at a time.

Components become integers, floor(256 x), and a posting's impact is the size of its component. A block of vectors keeps its
postings in ``LEVELS`` segments of falling quantised impact (quantiles of the block's impacts), and for every vector the norm of
what follows each segment. Queries take segment by segment, many queries at once. The sum so far, plus the query's norm
times the norm that is left of a vector, bounds its score from above (Cauchy-Schwarz); the vectors that lead
are scored exactly on the way and give the bar. A query stops when that proves all but a few
vectors out of the top k, and scores those exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.llm.vectors import best, matrix, usable

SCALE = 256
#: Vectors and queries in a block, segments, vectors rescored at most (as a share of a block), and queries handled at once.
BLOCK, LEVELS, RESCORED, AT_ONCE = 8192, 8, 64, 256


class Segments:
    """The postings of one block; ``read`` of ``asked`` postings were taken by the queries so far."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.unique = bool((np.diff(self.ids) != 0).all())
        whole = self.x.astype(np.float64)
        impact = np.abs(whole)
        edges = np.quantile(impact, np.arange(LEVELS - 1, 0, -1) / LEVELS)
        level = (impact[:, :, None] < edges).sum(axis=2).astype(np.int8)
        self.segments, self.left, self.size = [], [], []
        for s in range(LEVELS):
            own = level == s
            self.segments.append(np.where(own, whole, 0.0))
            self.size.append(int(own.sum()))
            self.left.append(np.sqrt(np.where(level > s, whole * whole, 0.0).sum(axis=1)))
        self.norm = np.sqrt((whole * whole).sum(axis=1))
        self.read = self.asked = 0

    def _bars(self, lead: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Exact k-th best score among the distinct ids of the leading rows of each query; minus infinity where they are fewer."""
        n = lead.shape[1]
        most = min(4 * k, n)
        rows = np.argpartition(lead, n - most, axis=1)[:, n - most:]
        score = np.einsum("mrd,md->mr", self.x[rows], queries).astype(np.float64)
        score[self.ids[rows] == own[:, None]] = -np.inf
        if not self.unique:
            by = np.lexsort((-score, self.ids[rows]), axis=1)
            score = np.take_along_axis(score, by, axis=1)
            held = np.take_along_axis(self.ids[rows], by, axis=1)
            score[:, 1:][held[:, 1:] == held[:, :-1]] = -np.inf
        return np.partition(score, most - k, axis=1)[:, most - k] if most >= k else np.full(len(queries), -np.inf)

    def _exact(self, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.x[rows] @ query
        top = np.lexsort((self.ids[rows], -score))
        top = top[np.sort(np.unique(self.ids[rows[top]], return_index=True)[1])[:k]]
        return self.ids[rows[top]], score[top]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the ``k`` best for each query, ties to the smaller id; the vector with its ``own`` id is left out."""
        n, few = len(self.x), max(4 * k, len(self.x) // RESCORED)
        out: list = [None] * len(queries)
        live = np.arange(len(queries))
        weights = queries.astype(np.float64)
        size = np.sqrt((weights * weights).sum(axis=1))
        sums = np.zeros((len(queries), n))
        bars = np.full(len(queries), -np.inf)
        other = self.ids[None, :] != own[:, None]
        self.asked += len(queries) * self.x.size
        for s, segment in enumerate(self.segments):
            sums += weights @ segment.T
            self.read += len(live) * self.size[s]
            if s in (0, LEVELS // 2 - 1):
                bars = np.maximum(bars, self._bars(np.where(other, sums, -np.inf), queries[live], own[live], k))
            # Rounding of the sums is far below this share of both norms.
            possible = (sums + size[:, None] * (self.left[s] + 1e-9 * self.norm) >= bars[:, None]) & other
            done = possible.sum(axis=1) <= few if s < LEVELS - 1 else np.ones(len(live), dtype=bool)
            for i in done.nonzero()[0]:
                out[live[i]] = self._exact(queries[live[i]], possible[i].nonzero()[0], k)
            if done.any():
                go = ~done
                live, weights, size, sums, bars, other = live[go], weights[go], size[go], sums[go], bars[go], other[go]
            if not len(live):
                break
        return out


def top_products(table: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query, ties to the smaller id.

    Both inputs have vec_id and embedding; other columns are not read. Vectors that are null, empty or hold null or
    non-finite components take no part. Rows with the query's id are its own and no candidates; an id that repeats
    counts once, with its best vector. Vectors meet those of their own length only. Fewer candidates
    than ``k`` are all returned. Vectors and queries both go in blocks of about ``block`` different rows, by a hash of id and vector,
    and every block of one meets every block of the other.
    """
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    have, want = (usable(t, zero=True).withColumn("v", whole).dropDuplicates(["vec_id", "v"]) for t in (table, queries))
    blocks, turns = (max(1, -(-t.count() // block)) for t in (have, want))

    def dealt(df: DataFrame, own: str, count: int, each: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")
        return df.withColumn(own, place).withColumn(each, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = dealt(have, "block", blocks, "turn", turns), dealt(want, "turn", turns, "block", blocks)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        if not mine.num_rows or not asked.num_rows:
            return schema.empty_table()
        index, out = Segments(matrix(mine.column("v"), np.int64), mine.column("vec_id").to_numpy()), []
        ids, vectors = asked.column("vec_id").to_numpy(), matrix(asked.column("v"), np.int64)
        for a in range(0, len(ids), AT_ONCE):
            own = ids[a:a + AT_ONCE]
            for q, (found, score) in zip(own, index.top(vectors[a:a + AT_ONCE], own, k)):
                out.append((np.full(len(found), q), found, score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    by = ["dim", "block", "turn"]
    found = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(run, "query_id long, vec_id long, score long")
    return best(found, k, highest=True)
