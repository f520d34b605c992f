"""Nearest neighbours against brute force: ties, copies, odd vectors, many cells, recall."""

import math
import random

import numpy as np
import pytest

from spanwright.llm import near_vectors as M


def brute(rows, every, k):
    """Of distinct usable (id, vector) rows."""
    kept = {(i, tuple(float(c) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = []
    for i, q in sorted(kept):
        if i % every:
            continue
        scores = sorted((-float((np.array(q) * np.array(x)).sum()), j) for j, x in kept if j != i and len(x) == len(q))
        out.append((i, [(j, -s) for s, j in scores[:k]]))
    return out


def same(got, want, k):
    """Rows of repeated query ids are compared as a whole."""
    left, right = {}, {}
    for r in got:
        left.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert 1 <= r.rank <= k
    for i, rows in want:
        if rows:
            right.setdefault(i, []).extend((j, round(s, 9)) for j, s in rows)
    assert {i: sorted(v) for i, v in left.items()} == {i: sorted(v) for i, v in right.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [1], "x") for i, v in rows], "vec_id long, embedding array<float>, cell int, ids array<int>, query string")


def test_exact_where_the_test_is_strict(spark):
    """Small integers have exact products and many ties; one vector is a third of all rows."""
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 3.0]) for i in range(200)]
    rows += [(2000 + i, [float(x) for x in np.round(100 * r.standard_normal(6))]) for i in range(60)]
    nan = float("nan")
    rows += [(5, None), (10, []), (15, [0.0] * 6), (20, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (25, [nan] * 6), (30, [float("inf")] * 6), (None, [1.0] * 6), (3000, [1.0, -0.0]), (3005, [2.0, 0.0]), (3001, [-1.0, 5.0])]
    rows += rows[:7] + rows[400:404]
    for cell_rows in (10**6, 40):
        got = M.nearest(frame(spark, rows), every=5, k=7, confidence=1 - 1e-12, cell_rows=cell_rows).collect()
        same(got, brute(rows, 5, 7), 7)
        by = {}
        for x in got:
            by.setdefault(x.query_id, []).append(x)
        for i, found in by.items():
            if sum(q == i for q, _ in rows) == 1:
                found.sort(key=lambda x: x.rank)
                assert [x.rank for x in found] == list(range(1, len(found) + 1))
                assert [(-x.score, x.vec_id) for x in found] == sorted((-x.score, x.vec_id) for x in found)


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (5, [1.0, 1.0, 1.0])]
    same(M.nearest(frame(spark, rows), every=5, k=20).collect(), [(0, [(1, 0.5)])], 20)
    for none in ([], [(0, None)], [(None, [1.0])], [(0, [1.0])]):
        assert M.nearest(frame(spark, none), every=5).collect() == []


@pytest.mark.parametrize("cell_rows", [10**6, 300])
def test_recall_of_random_and_clustered_vectors(spark, cell_rows):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((1200, 24)), 0.1 * r.standard_normal((800, 24)) + 3 * r.standard_normal((8, 24))[r.integers(0, 8, 800)]])
    rows = [(i, [float(c) for c in v.astype("f4")]) for i, v in enumerate(x)]
    got = M.nearest(frame(spark, rows), cell_rows=cell_rows).collect()
    found = {(g.query_id, g.vec_id) for g in got}
    want = {(i, j) for i, hits in brute(rows, 20, 20) for j, _ in hits}
    assert len(got) == len(want) and len(found & want) >= 0.95 * len(want)


def test_search_stops_early_on_clusters():
    """Far points are not verified: the search of a tight group leaves most leaves alone."""
    r = np.random.default_rng(5)
    x = r.standard_normal((4000, 16))
    x[:300] = x[0] + 0.01 * r.standard_normal((300, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    norm = 1 + 1e-12
    calls = []
    near = np.partition
    try:
        np.partition = lambda a, *rest, **more: calls.append(a.size) or near(a, *rest, **more)
        M.search_cell(x, x[:1], np.array([-np.inf]), norm, 20, 8, 0.975, 1)
    finally:
        np.partition = near
    assert len(calls) < 30  # of 63 leaves


def test_chi_square_quantile():
    r = np.random.default_rng(6)
    for dims in (2, 8, 12):
        draws = (r.standard_normal((200_000, dims)) ** 2).sum(axis=1)
        assert abs((draws <= M.chi_square_quantile(0.975, dims)).mean() - 0.975) < 0.003
    with pytest.raises(ValueError):
        M.chi_square_quantile(0.9, 3)


def test_leaves_and_cells_hold_every_row():
    r = random.Random(1)
    y = np.array([[r.choice((0.0, 1.0, r.random())) for _ in range(4)] for _ in range(1000)])
    assert sorted(np.concatenate(M._leaves(y)).tolist()) == list(range(1000))
    axis, value = M._splits(y[:200], 3)
    cell = M._descend(y, axis, value)
    assert cell.min() >= 0 and cell.max() < 8
