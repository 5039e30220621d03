"""Spanning-tree bounds against scores of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.llm.hard_negatives import AnchorTree, between, mine, nearest, quantised, walk


def brute(rows, every=10, positives=5, negatives=5):
    """rows: (vec_id, label, items)."""
    out = []
    for a, (anchor_id, label, items) in enumerate(rows):
        if anchor_id % every:
            continue
        scored = [(-int(np.dot(items, r[2])), r[0], r[1]) for i, r in enumerate(rows) if i != a and len(r[2]) == len(items)]
        for score, positive_id, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            within = sorted(s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score)
            out += [(anchor_id, positive_id, i + 1, s[1], -score, -s[0]) for i, s in enumerate(within[:negatives])]
    return sorted(out)


def vectors(n, seed, width=6, labels=4, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread, (labels, width))
    label = rng.integers(0, labels, n)
    items = centres[rng.integers(0, labels, n)] + rng.integers(-spread // 2, spread // 2 + 1, (n, width))
    return [(int(i), int(x), [int(v) for v in y]) for i, x, y in zip(rng.permutation(n), label, items)]


SCHEMA = "vec_id long, label long, items array<long>"


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_all_pairs(spark, seed):
    rows = vectors(400, seed)
    got = mine(spark.createDataFrame(rows, SCHEMA), lambda i: i % 10 == 0, block=97, group=13).collect()
    assert brute(rows) and sorted(map(tuple, got)) == brute(rows)


def test_ties_repeats_lengths_and_hot_label(spark):
    rows = vectors(120, 7, width=2, labels=2, spread=3)
    rows += [rows[0]] * 30 + [(0, 1, [2, 2])] * 3 + [(10, 0, [1]), (11, 1, [1]), (20, 0, []), (21, 1, []), (22, 0, [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "rank": F.lit(1), "_block": F.lit(None)})
    got = mine(df, lambda i: i % 10 == 0, block=20, group=4).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_nulls_and_no_rows(spark):
    rows = [(1, None, [1.0]), (None, 1, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan")]), (5, 1, [float("-inf")]), (6, 2, [-0.01, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in quantised(df).collect()] == [(6, 2, [-3, 128])]
    assert mine(quantised(df), lambda i: i % 2 == 0).count() == 0
    assert mine(spark.createDataFrame([], SCHEMA), lambda i: i % 2 == 0).count() == 0


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1 << 30]), (1, 1, [1 << 30])], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        mine(df, lambda i: i == 0).collect()


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(1)
    anchors = rng.integers(-200, 200, 8)[None, :] + rng.integers(-3, 4, (300, 8)).astype("f8")
    rows = rng.integers(-200, 200, (2000, 8)).astype("f8")
    exact = rows @ anchors.T
    scored = 0

    def wanted(anchor, lower, upper):
        assert (lower - 0.5 <= exact[:, anchor]).all() and (upper + 0.5 >= exact[:, anchor]).all()
        return upper > np.partition(lower, 1980)[1980]

    for anchor, at, scores in walk(anchors, rows, wanted):
        assert (scores == exact[at, anchor]).all()
        scored += len(at)
    assert scored < 0.3 * exact.size


def test_tree_spans_and_frees_parents():
    rng = np.random.default_rng(2)
    anchors = rng.integers(-9, 9, (100, 3)).astype("f8")
    steps = AnchorTree(anchors).steps
    assert sorted(s[0] for s in steps) == list(range(100))
    kept, most = {-1}, 0
    for anchor, parent, edge, last, inner in steps:
        assert parent in kept and abs(edge - np.linalg.norm(anchors[anchor] - (anchors[parent] if parent >= 0 else 0))) < 1e-9
        if last:
            kept.remove(parent)
        assert inner == any(s[1] == anchor for s in steps)
        if inner:
            kept.add(anchor)
        most = max(most, len(kept))
    assert most <= 9 and not kept


def test_helpers_on_few_rows():
    rows, ids = np.array([[1.0], [2.0], [2.0]]), np.array([5, 9, 7])
    found = list(nearest(np.array([[1.0]]), np.array([1]), rows, np.arange(3), ids, 5))
    assert [(a, at.tolist(), s.tolist()) for a, at, s in found] == [(0, [2, 0], [2.0, 1.0])]
    found = list(between(np.array([[1.0]]), np.array([0]), [np.array([2, -1, 0])], rows, np.array([1, 1, 0]), ids, 5, (80, 100)))
    assert [(a, n, at.tolist()) for a, n, at, _ in found] == [(0, 0, [1])]
