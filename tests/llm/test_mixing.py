"""Mixing against a plain loop: targets by repeated resharing, takings by one sorted pass."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from fieldtrust.llm.mixing import QUALITY, labelled_quality, mix, mixture, sized, targets

DOCS = "doc_id long, source string, text string"


def plain_targets(sizes, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def key(doc_id, weight):
    digits = hashlib.md5(str("" if doc_id is None else doc_id).encode()).hexdigest()[:13]
    return -math.log((int(digits, 16) + 0.5) / 2**52) / weight


def test_targets_stop_at_three_times_the_size(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, "d": 3, None: 7}, {"x": 5}, {"a": 0, "b": 9}, {"é": 100, "z": 2, "A": 30, "b": 4000}):
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r["source"] for r in rows} == set(want)
        for r in rows:
            assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)


def test_takings_equal_one_sorted_pass(spark):
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", "word " * (1 + i * 37 % 90)) for i in range(600)]
    docs += [(1000, None, None), (1001, None, ""), (1002, None, "a  b\tc d\n"), (None, "s1", "x y"), (5, "s9", "same"), (5, "s9", "same")]
    labels = [(i, i % 2, 0) for i in range(0, 400)] + [(3, 1, 0), (None, 1, 0)]
    rows = labelled_quality(sized(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = mix(rows).collect()
    quality = {}
    for i, q, _ in labels:
        quality[i] = max(q, quality.get(i, 0))
    counted = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in docs]
    sizes = {s: sum(z for _, o, z in counted if o == s) for _, s, _ in counted}
    target = plain_targets(sizes)
    want = []
    for s in sizes:
        own = sorted((key(d, QUALITY.get(quality.get(d) if d is not None else None, 1.0)), d is not None, d or 0, z) for d, o, z in counted if o == s)
        epochs = math.floor(target[s] / sizes[s]) if sizes[s] else 1
        rest, before = target[s] - epochs * sizes[s], 0
        for _, known, d, z in own:
            want.append((d if known else None, z, sizes[s], (epochs + (2 * before + z <= 2 * rest)) * z))
            before += z
    shape = lambda rows: sorted(rows, key=repr)
    assert shape((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == shape(want)
    for s in sizes:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - target[s]) <= max(z for _, o, z in counted if o == s)
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_mixture_repeats_rows_in_their_own_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a", "one two three four", 9, "t"), (2, "b", "x", 8, "u"), (3, "b", "y z", 7, "v")],
        DOCS + ", size int, target string",
    )
    out = mixture(docs)
    assert out.columns == docs.columns
    # 7 words by weights 5 and 2: a's target 5 and b's 2; a is one epoch of 4 and a rest of 1, b is less than one epoch.
    assert [tuple(r) for r in out.collect()].count((1, "a", "one two three four", 9, "t")) == 1
    assert {r["size"] for r in out.collect()} <= {9, 8, 7}


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mix(labelled_quality(sized(empty), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    assert mixture(empty).count() == 0


def test_the_pipeline_draws_by_quality(spark, tmp_path):
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", "word " * (1 + i * 37 % 90)) for i in range(300)]
    docs += [(None, "s1", "x y"), (1000, None, None), (5, "s9", "same"), (5, "s9", "same"), (5, "s9", "not the same")]
    frame = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = Counter()
    for r in mix(labelled_quality(sized(frame), labels)).collect():
        want[r["doc_id"], r["source"], r["text"]] += r["copies"]
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, frame, str(tmp_path)).collect())
    assert got == +want
