"""Top-k against brute force, with many ties, signs and odd rows."""

import math

import numpy as np
import pytest

import fieldtrust.llm.topk as topk
from fieldtrust.llm.topk import SortedLists, quantised, search, top_k

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, k=20, every=20):
    """Scores as Python integers."""
    clean = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for row, (i, q) in enumerate(clean):
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(clean) if other != row and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def corpus(n=400, width=8):
    rng = np.random.default_rng(1)
    vectors = np.float32(rng.normal(size=(n, width)))
    vectors[50:170] = vectors[50]  # a third are one vector
    return [(int(i), v.tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("block", [4096, 37])
def test_equals_brute_force(spark, block):
    rows = corpus()
    rows += [(1000, None), (1020, None), (1040, [None] * 8), (1060, [float("nan")] + [0.0] * 7), (1080, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    rows += [(1100, [0.0] * 8), (1120, [-0.001] * 8), (2000, [1.0, 2.0]), (2001, [3.0, 1.0]), (2020, [])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", score int, items string").repartition(4)
    got = top_k(quantised(frame), lambda i: i % 20 == 0, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_rounds_stop_early_and_stay_exact(monkeypatch):
    """Skewed components let the bounds settle before the lists end."""
    rng = np.random.default_rng(3)
    items = np.floor(rng.pareto(1.5, size=(3000, 3)) * 5)
    items, ids = items[np.argsort(-np.abs(items).min(1))], np.arange(3000)
    queries = items[:40]
    depths = []
    real = SortedLists.bounds
    monkeypatch.setattr(SortedLists, "bounds", lambda self, d: (depths.append(d), real(self, d))[1])
    monkeypatch.setattr(topk, "DEPTHS", (0.02, 0.1, 0.3, 0.6, 1.0))
    found = search(SortedLists(items), ids, queries, ids[:40], 20)
    assert max(depths) < 3000 * 0.6
    for q, (near, scores) in enumerate(found):
        every = items @ queries[q]
        want = [i for i in np.lexsort((ids, -every)) if i != q][:20]
        assert near.tolist() == want and (scores == every[want]).all()


def test_fewer_than_k_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-2.0])], VECTORS)
    assert sorted(map(tuple, top_k(quantised(few), lambda i: i % 20 == 0).collect())) == [(0, 1, 1, 8192), (0, 2, 2, -8192)]
    assert top_k(quantised(spark.createDataFrame([], VECTORS)), lambda i: i % 20 == 0).count() == 0
    assert top_k(quantised(spark.createDataFrame([(1, [2.0])], VECTORS)), lambda i: i % 20 == 0).count() == 0


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (5, [3.0]), (5, [3.0]), (7, [2.0])]
    got = top_k(quantised(spark.createDataFrame(rows, VECTORS)), lambda i: i % 20 == 0).collect()
    once = [(0, 1, 5, 12288), (0, 2, 5, 12288), (0, 3, 7, 8192), (0, 4, 0, 4096)]
    assert sorted(map(tuple, got)) == sorted(2 * once) == brute(rows)


def test_one_row_that_many_repeat(spark):
    rows = [(3, [1.0, 2.0])] * 200 + [(20, [1.0, 1.0]), (4, [9.0, 9.0])]
    got = top_k(quantised(spark.createDataFrame(rows, VECTORS).repartition(3)), lambda i: i % 20 == 0, block=16).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_too_large_components_are_refused(spark):
    huge = spark.createDataFrame([(0, [1e7, 1e7]), (1, [1e7, 1e7])], VECTORS)
    with pytest.raises(Exception, match="too large"):
        top_k(quantised(huge), lambda i: i % 20 == 0).collect()
