import numpy as np
import pytest

from habitat.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block int"


def brute(rows, k=5, n=3, step=50):
    """The contract by plain loops over (vec_id, vector, label); None vectors and labels are left out."""
    taken = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        taken[i] = min(taken.get(i, (label, w)), (label, w))
    out = []
    for a, (label, w) in taken.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(w, u)), i, m) for i, (m, u) in taken.items() if i != a and len(u) == len(w))
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fits[:n])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, m, 0.5, 3) for i, v, m in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, "vec_id % 50 = 0", **more).collect())


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    x = middle[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), [float(c) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim", [1, 7, 16])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(hn, "CELL_ROWS", 8)
    monkeypatch.setattr(hn, "BAR_ROWS", 64)
    monkeypatch.setattr(hn, "ASKED", 5)
    rows = clustered(600, dim, dim)
    assert mined(spark, rows) == brute(rows)


def test_hard_negatives_hot_vector_ties_and_odd_rows(spark):
    rows = clustered(300, 8, 3) + [(1000 + i, [0.5] * 8, i % 3) for i in range(300)]
    rows += [(50, [0.1] * 8, 2), (50, [0.2] * 8, 0), (None, [1.0] * 8, 1), (2000, None, 1), (2001, [], 1), (2002, [1.0] * 8, None), (2050, [0.25] * 3, 1),
             (2051, [0.5] * 3, 1), (2052, [0.24] * 3, 2), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] + [0.0] * 7, 1), (2100, [0.0] * 8, 1), (2150, [1.0, None] * 4, 0)]
    assert mined(spark, rows) == brute(rows)


def test_hard_negatives_of_an_empty_table(spark):
    assert mined(spark, []) == []


def test_cells_come_by_falling_bound_and_none_is_missed():
    rng = np.random.default_rng(5)
    first, second = rng.normal(size=9), rng.normal(size=13)
    cells = list(hn.cells_by_bound(first, second))
    assert len({(i, j) for _, i, j in cells}) == 9 * 13
    assert [b for b, _, _ in cells] == sorted((b for b, _, _ in cells), reverse=True)
    x = rng.integers(-200, 200, size=(500, 10))
    index = hn.Index([hn._codes(h, 6) for h in (x[:, :5], x[:, 5:])])
    codes, left = index.file(x)
    for h in range(2):
        np.maximum.at(index.radii[h], codes[h], left[h])
    a = rng.integers(-200, 200, size=(1, 10))
    scores = hn.products(a, x)[0]
    bar = int(np.sort(scores)[-20])
    seen = set(hn.visited(*(b[0] for b in index.bounds(a)), bar))
    assert {(int(i), int(j)) for i, j, s in zip(*codes, scores) if s >= bar} <= seen


def test_clusters_leave_most_cells_unvisited():
    rows = clustered(4000, 16, 9)
    x = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    index = hn.Index([hn._codes(h, 12) for h in (x[:, :8], x[:, 8:])])
    codes, left = index.file(x)
    for h in range(2):
        np.maximum.at(index.radii[h], codes[h], left[h])
    np.add.at(index.rows, tuple(codes), 1)
    share = []
    for n in range(0, 4000, 200):
        scores = np.sort(hn.products(x[n : n + 1], x)[0])
        cells = hn.visited(*(b[0] for b in index.bounds(x[n : n + 1])), int(scores[-6]))
        share.append(sum(index.rows[c] for c in cells) / len(rows))
    assert np.mean(share) < 0.5


def test_products_are_exact_beyond_floats():
    a, b = np.array([[2**31, 1]]), np.array([[2**31, 1], [3, -(2**30)]])
    assert hn.products(a, b).tolist() == [[2**62 + 1, 3 * 2**31 - 2**30]]
