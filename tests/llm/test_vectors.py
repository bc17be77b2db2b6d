"""The two vector searches against brute force."""

import math

import numpy as np
import pytest

from habitat.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 32))).astype(np.float32)
    x[500:1500] = x[500]  # a third of the rows are one vector
    return x, spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], SCHEMA).repartition(4)


def test_nearest_recall_and_scores(clustered):
    x, table = clustered
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x, hit, total = x.astype(np.float64), 0, 0
    for q in range(0, len(x), 100):
        rows = sorted(got[q])
        assert [r for r, *_ in rows] == list(range(1, 11)) and q not in [v for _, v, _ in rows]
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in rows)
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        bar = np.sort(np.delete(d, q))[9]
        hit += sum(s <= bar + 1e-12 for _, _, s in rows)
        total += 10
    assert hit / total >= 0.9


def test_nearest_of_copies_is_exact(clustered):
    _, table = clustered
    rows = ann.nearest(table, table.filter("vec_id = 600")).collect()
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank)] == list(range(500, 510))


def odd_table(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, []),
            (8, [-1.0, 0.5, 0.25]), (9, [2.0, 2.0]), (100, [1.0, 0.0, 2.0]), (100, [1.0, 0.0, 2.0]), (None, [1.0, 1.0, 1.0]), (200, [0.0, 0.0, 0.0])]
    return spark.createDataFrame([(i, v, None, 1.0) for i, v in rows], SCHEMA)


def test_nearest_of_odd_rows(spark):
    table = odd_table(spark)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(table, table.filter("vec_id % 100 = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 8), (100, 1, 0), (100, 2, 1), (100, 3, 8)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def plain_top(x, ids, q, k):
    w = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    s = w @ w[list(ids).index(q)]
    return [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != q][:k]


def test_top_products_are_exact(clustered):
    x, table = clustered
    got = {}
    for r in sorted(topk.top_products(table, table.filter("vec_id % 50 = 0"), block=700).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.arange(len(x))
    assert got == {q: plain_top(x, ids, q, 5) for q in range(0, len(x), 50)}


def test_top_products_of_odd_rows(spark):
    table = odd_table(spark)
    got = {}
    for r in sorted(topk.top_products(table, table.filter("vec_id % 50 = 0")).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    own = 256 * 256 * 5
    assert got[0] == [(1, own), (100, own), (3, 0), (200, 0), (8, 256 * (-256) + 512 * 64)]
    assert [v for v, _ in got[200]] == [0, 1, 3, 8, 100]
    assert topk.top_products(table.limit(0), table.limit(0)).count() == 0


def test_segments_stop_early_and_stay_exact():
    rng = np.random.default_rng(3)
    for scale in (1, 40):
        x = rng.integers(-scale, scale + 1, size=(500, 8))
        x[:, 0] *= 50
        ids = rng.permutation(10_000)[:500]
        index = topk.Segments(x, ids)
        queries = np.stack([*x[:20], np.zeros(8, dtype=np.int64)])
        for query, got in zip(queries, index.top(queries, np.full(len(queries), -1), 5)):
            s = x @ query
            want = [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s))][:5]
            assert list(zip(got[0].tolist(), got[1].tolist())) == want


def test_segments_of_repeated_ids_and_few_rows():
    rng = np.random.default_rng(4)
    for n in (1, 3, 40):
        x, ids = rng.integers(-4, 5, size=(n, 3)), rng.integers(0, max(1, n // 3) + 1, size=n)
        queries, own = rng.integers(-4, 5, size=(9, 3)), rng.integers(0, n, size=9)
        for query, q, got in zip(queries, own, topk.Segments(x, ids).top(queries, own, 4)):
            most = {}
            for i, score in zip(ids.tolist(), (x @ query).tolist()):
                if i != q:
                    most[i] = max(most.get(i, score), score)
            assert list(zip(got[0].tolist(), got[1].tolist())) == sorted(most.items(), key=lambda e: (-e[1], e[0]))[:4]


def test_share_of_postings_read():
    rng = np.random.default_rng(5)
    n, dims = 4096, 64
    x = rng.standard_normal((n, dims))
    sparse = x * (rng.random((n, dims)) < 0.15) * 6
    for rows, most in ((x, 0.85), (sparse, 0.3)):
        rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
        index = topk.Segments(rows, np.arange(n))
        index.top(rows[:64], np.arange(64), 5)
        assert index.read <= most * index.asked
