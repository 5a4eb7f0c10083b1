"""Vector search against all pairs, with the bounds of the tree and its odd cases."""

import math
import random

import numpy as np
import pytest

from heddle.llm import vector_search as V

KIND = "vec_id long, embedding array<float>, label int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k, asked):
    """(query_id, rank, vec_id, score) over distinct rows, by Python's integers."""
    whole = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and sound(v)}
    out = []
    for i, q in whole:
        if asked(i):
            scores = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in whole if j != i and len(c) == len(q)))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).repartition(4).selectExpr("*", "1 as score", "2 as cell", "3 as v", "'x' as kth")
    own = V.integers(df)
    return sorted(map(tuple, V.top_k(own, own.where("vec_id % 50 = 0"), k).collect()))


def vectors(n, d, seed, kinds=6):
    draw = np.random.default_rng(seed)
    heart = draw.normal(size=(kinds, d))
    return [(i, [float(x) for x in heart[i % kinds] * draw.choice((1, 3)) + 0.3 * draw.normal(size=d)]) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("CELL_ROWS", 60), ("SHARD_ROWS", 40), ("QUERY_ROWS", 3), ("LEAF", 5), ("TOGETHER", 2), ("SAMPLE_ROWS", 300)):
            monkeypatch.setattr(V, name, value)
    rows = vectors(900, 12, 3)
    assert found(spark, rows) == brute(rows, 5, lambda i: i % 50 == 0)


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    """Nulls, components that aren't finite, copies by hundreds, ties, repeated rows and ids, other lengths, huge components."""
    if small:
        for name, value in (("CELL_ROWS", 50), ("SHARD_ROWS", 30), ("QUERY_ROWS", 2), ("LEAF", 4), ("SAMPLE_ROWS", 100)):
            monkeypatch.setattr(V, name, value)
    draw = random.Random(1)
    rows = [(i, [1.0, -0.5, 0.25]) for i in range(200, 600)]  # one vector, most of all rows
    rows += [(i, [draw.uniform(-2, 2) for _ in range(3)]) for i in range(100)]
    rows += [(50, [0.5, 0.5, 0.5]), (7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (100, [0.1, 0.2, 0.3]), (100, [0.1, 0.2, 0.3])]
    rows += [(None, [9.0, 9.0, 9.0]), (650, None), (651, [9.0, None, 9.0]), (700, [float("nan"), 9.0, 9.0]), (652, [float("inf"), 9.0, 9.0]), (750, [])]
    rows += [(800, [1.0, 2.0]), (801, [0.5, -2.0]), (850, [1.0]), (900, []), (950, [-100_000.0, 0.0, 200_000.0]), (-50, [0.0, 0.0, 0.0])]
    rows += [(i, [float(draw.randrange(-250_000, 250_000)) + 1 / 256 for _ in range(8)]) for i in range(1000, 1060)]  # sums beyond 2**53
    # Two rows of id 50 both ask: each has its own list.
    assert found(spark, rows) == brute(rows, 5, lambda i: i % 50 == 0)


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(50, [1.0, 2.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_tree_prunes_and_keeps_ties():
    """In clusters far apart most rows are never scored; of equal scores the smaller ids are found."""
    rows = np.array([[math.floor(256 * x) for x in v] for _, v in vectors(4000, 16, 9, kinds=40)], dtype=float)
    tree = V.BallTree(np.arange(4000), rows)
    for node in range(len(tree.low)):
        own = tree.rows[tree.low[node] : tree.high[node]]
        some = rows[:20]
        top = tree.bounds(some, np.sqrt((some**2).sum(1)), np.full(20, node))
        assert ((some @ own.T).max(1) <= top).all()
    score, ids, scored = tree.search(np.full(40, -1), rows[:40], 5, np.full(40, -np.inf))
    every = rows[:40] @ rows.T
    for i in range(40):
        order = np.lexsort((np.arange(4000), -every[i]))[:5]
        assert (ids[i] == order).all() and (score[i] == every[i][order]).all()
    assert scored < 0.5 * 40 * 4000
    same = V.BallTree(np.arange(1000)[::-1].copy(), np.ones((1000, 3)))
    assert same.search(np.array([2]), np.ones((1, 3)), 5, np.array([-np.inf]))[1].tolist() == [[0, 1, 3, 4, 5]]


def test_query_equals_sql(spark, duck, same):
    same(V.op13_vector_search(spark, "/root/testdata/sf0.001"), duck.sql(V.OP13_SQL))
