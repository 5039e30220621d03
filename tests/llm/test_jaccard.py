"""The join against all pairs by brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldtrust.llm.jaccard import Shingler, bands_and_rows, compare, components, join, one_of_each

DOCS = "doc_id long, text string"


def grams(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(docs, threshold=0.8):
    """(doc_id, class_id, copy_of, n_links, n_text_links) per row."""
    sets = [grams(t) for _, t in docs]
    n = len(docs)
    link = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) * 10 >= round(10 * threshold) * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            best = min([root[i], *(root[j] for j in range(n) if link[i][j])])
            changed |= best != root[i]
            root[i] = best
    out = []
    for i, (doc_id, _) in enumerate(docs):
        same = [j for j in range(n) if j == i or (sets[j] == sets[i] and sets[i])]
        others = {frozenset(sets[j]) for j in range(n) if link[i][j]} - {frozenset(sets[i])}
        out.append((doc_id, least([docs[j][0] for j in range(n) if root[j] == root[i]]), least([docs[j][0] for j in same]), sum(link[i]), len(others)))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    docs = []
    for _ in range(20):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 12])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(rng.choice([" ", "  ", "\n"]).join(copy))
    base = [word() for _ in range(120)]
    for i in range(60):  # near copies of one text, all of them different
        copy = list(base)
        copy[rng.randrange(120)] = word()
        docs.append(" ".join(copy))
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    return rows


def test_links_equal_brute_force(spark):
    docs = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (None, "one"), (905, "one two"), (905, "one two"), (None, None)]
    got = join(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS + ", class_id string, _key int").repartition(5), block=16)
    got = [tuple(r) for r in got.select("doc_id", "class_id", "copy_of", "n_links", "n_text_links").collect()]
    assert sorted(got, key=repr) == sorted(brute(docs), key=repr)


def test_blocks_do_not_change_results(spark):
    docs = spark.createDataFrame(corpus(8), DOCS)
    wide, narrow = ([tuple(r) for r in join(docs, block=b).orderBy("doc_id").collect()] for b in (1000, 7))
    assert wide == narrow


def test_one_of_each(spark):
    docs = corpus(2) + [(900, None), (901, ""), (905, "one two"), (905, "one two")]
    frame = spark.createDataFrame([(i, t, "keep") for i, t in docs], DOCS + ", _key string")
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    want = Counter(c for _, c, *_ in brute(docs))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(dict.fromkeys(want, 1))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    root = list(range(200))
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    assert got == {i: r for i, r in enumerate(root) if i != r}
    assert components(frame.where("a < 0")).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = bands_and_rows(threshold, 0.99)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99 and bands * rows <= 128


def test_compare_in_slabs(monkeypatch):
    import fieldtrust.llm.jaccard as jaccard

    shingler, rng = Shingler(), np.random.default_rng(1)
    sets = [shingler.grams(" ".join(map(str, rng.integers(0, 3, 40)))) for _ in range(12)]
    whole = compare(sets, np.arange(12), np.arange(12), 0.3)
    monkeypatch.setattr(jaccard, "SLAB", 5)
    assert (compare(sets, np.arange(12), np.arange(12), 0.3) == whole).all()
    assert whole[0, 1] == (len(set(sets[0]) & set(sets[1])) * 10 >= 3 * len(set(sets[0]) | set(sets[1])))


def test_empty_table(spark):
    assert join(spark.createDataFrame([], DOCS)).count() == 0
    assert one_of_each(spark.createDataFrame([], DOCS)).count() == 0
    assert join(spark.createDataFrame([(1, None)], DOCS)).select(F.col("class_id")).first()[0] == 1
