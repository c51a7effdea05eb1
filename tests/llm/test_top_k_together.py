"""Exact top-k for many queries at once: plan, page visits, exact products, and results against a plain restatement."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinelake.llm import metric_tree
from kinelake.llm.metric_tree import Best, Space, Subtree, build_tree, collapsed, exact_top_k, nearest, quantised, space_of
from test_search_phrases import plain_top_k


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def top_k(frame, **more):
    return Counter(map(tuple, exact_top_k(frame, **more).collect()))


def test_copies_leave_before_they_meet(spark):
    """Each task leaves out repeated rows before one shuffle, and larger ids of a vector before the other."""
    rows = [(i, [0.5, 0.25]) for i in [*range(9, 40), 9, 9, 10]] + [(None, [0.5, 0.25])] * 3 + [(7, [1.0]), (7, [1.0]), (7, [2.0])]
    few = collapsed(quantised(frame_of(spark, rows)), 3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    window, by_row, by_vector = (plan.rindex(x) for x in ("Partial", "HashAggregate", "Exchange hashpartitioning(v"))
    assert plan.count("Exchange hashpartitioning") == 2 and by_vector < window < plan.rindex("Exchange") < by_row
    wanted = [(None, (128, 64)), *((i, (128, 64)) for i in range(9, 13)), (7, (256,)), (7, (512,))]
    assert Counter((r.id, tuple(r.v)) for r in few.collect()) == Counter(wanted)


def test_queries_visit_a_page_together(spark):
    """However many queries there are, a page is opened once; and pages that hold nothing for any of them, never."""
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(40, 1, 8)) * 20 + rng.normal(size=(40, 50, 8)) * 0.05).reshape(-1, 8)
    rows = quantised(frame_of(spark, [(i, x.tolist()) for i, x in enumerate(v)]))
    space = space_of(rows)
    tree = build_tree(rows, space, 5, n_roots=1, page=16, subtree=4000)
    sub = Subtree(tree.subtrees.collect()[0].asDict(), space)
    whole = np.floor(256 * v)
    long = np.argsort(-(whole * whole).sum(axis=1))[:300].tolist()
    queries, opened = whole[long].astype(space.dtype), []

    class Watched(Best):
        def add(self, ids, scores, rows=None):
            opened.append(tuple(ids))
            super().add(ids, scores, rows)

    best = Watched(np.array(long), (queries.astype(float) ** 2).sum(axis=1) + space.most, 5)
    sub.search(queries, best.distances(queries @ tree.roots[0, :-1].astype(space.dtype)), best)
    leaves = sum(sub.child[a] < 0 for a in sub.first[:-1])
    assert len(set(opened)) == len(opened) < leaves / 2
    got = Counter((i, r + 1, j, s) for i, ids, scores in zip(long, best.ids.tolist(), best.scores.tolist()) for r, (j, s) in enumerate(zip(ids, scores)))
    assert got == Counter({x: n for x, n in plain_top_k([(i, x.tolist()) for i, x in enumerate(v)], 5, 1).items() if x[0] in set(long)})


@pytest.mark.parametrize("most, dtype", [(2**24 - 1, np.float32), (2**24, np.float64), (2**53 - 1, np.float64), (2**53, np.int64)])
def test_products_are_exact(spark, most, dtype):
    """Up to the largest squared length that a type is used for; scores differ by one."""
    side = math.isqrt(most)
    rest = most - side * side
    v = [[side] + [1] * 3 + [0], [side, math.isqrt(rest), 0, 0, 0]] + [[side - i, 1, i % 2, 1, i % 3] for i in range(9)]
    v = [x for x in v if sum(c * c for c in x) <= most]
    corner = [side, *(int(c) for c in four_squares(rest))]
    rows = [(i, [c / 256 for c in x]) for i, x in enumerate([corner, *v])]
    frame = frame_of(spark, rows)
    space = space_of(quantised(frame))
    assert space.most == most and space.dtype is dtype
    assert top_k(frame, k=4, every=1) == plain_top_k(rows, 4, 1)


def four_squares(n):
    """Four integers whose squares add up to n."""
    for a in range(math.isqrt(n), -1, -1):
        for b in range(math.isqrt(n - a * a), -1, -1):
            for c in range(math.isqrt(n - a * a - b * b), -1, -1):
                d = n - a * a - b * b - c * c
                if math.isqrt(d) ** 2 == d:
                    return a, b, c, math.isqrt(d)


def test_more_queries_than_go_together(spark, monkeypatch):
    """Several groups of queries, and several blocks of groups, with ties and equal ids."""
    monkeypatch.setattr(metric_tree, "BLOCK_BYTES", 32_000)  # of the driver: two blocks
    rng = np.random.default_rng(9)
    v = rng.integers(-3, 4, size=(1300, 3)) / 256
    rows = [(int(i), x.tolist()) for i, x in zip(rng.integers(0, 1500, 1300), v)] + [(None, [0.0, 0.0, 0.0])]
    assert top_k(frame_of(spark, rows), k=6, every=1) == plain_top_k(rows, 6, 1)
    monkeypatch.setattr(metric_tree, "BLOCK_BYTES", 1 << 20)  # one block of two groups
    assert top_k(frame_of(spark, rows), k=2, every=1) == plain_top_k(rows, 2, 1)


def test_nothing_to_ask_or_to_find(spark):
    """No queries, ids that are all missing, vectors without components, and a query that all others copy."""
    for rows in (
        [(1, [1.0]), (2, [2.0])],
        [(None, [1.0]), (None, [2.0])],
        [(5, []), (6, []), (10, []), (None, [])],
        [(i, [0.5, -0.5]) for i in range(30)],
    ):
        assert top_k(frame_of(spark, rows), k=4, every=5) == plain_top_k(rows, 4, 5)


def test_tree_knows_its_neighbours(spark):
    rows = quantised(frame_of(spark, [(1, [1.0]), (2, [1.0])]))
    with pytest.raises(ValueError):
        nearest(build_tree(rows, space_of(rows), 1), rows, 2)


def test_matrix_of_lists():
    space = Space(3, 100, np.float32)
    lists = pa.array([[1, 2, 3], [], [4]], pa.list_(pa.int64()))
    assert space.matrix(lists).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]] and space.matrix(lists[1:]).tolist() == [[0, 0, 0], [4, 0, 0]]
