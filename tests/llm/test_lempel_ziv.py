"""Fingerprints against plain parsing of whole texts in one list."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from fieldtrust.llm.lempel_ziv import KEPT, as_text, fingerprint, likeness, parse, signature, whole_signature, with_following

DOCS = "doc_id long, text string"


def plain_phrases(text):
    seen, start, end = [], 0, 1
    while end <= len(text):
        if text[start:end] not in seen:
            seen.append(text[start:end])
            start = end
        end += 1
    return seen


def corpus(n=80):
    rng = random.Random(2)
    words = ["the", "thing", "and", "éa", "中文", "😀", "of", "tion"]
    return [(3 * i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400])))) for i in range(n)]


def test_phrases_and_hashes():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab 中😀") for _ in range(rng.randint(0, 80)))
        known = {}
        parse(text, known)
        assert list(known) == plain_phrases(text)
        # Equal phrases at other places have equal hashes, different ones differ.
        shifted = {}
        parse("xyz" + text, shifted)
        hashed = set(signature(text, known, 1000).tolist())
        assert len(hashed) == len(known)
        assert len(hashed & set(signature("xyz" + text, shifted, 1000).tolist())) == len(set(known) & set(shifted))


def test_likeness_estimates_the_sets_likeness():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    other = base[:14_000] + "".join(rng.choice("ijklmnop ") for _ in range(6_000))
    sets = [set(plain) for plain in map(lambda t: (lambda k: (parse(t, k), k)[1])({}), (base, other))]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(likeness(whole_signature(base), whole_signature(other)) - true) < 4 * np.sqrt(true * (1 - true) / KEPT)
    assert likeness(whole_signature("ab"), whole_signature("ab")) == 1.0
    assert likeness(whole_signature(""), whole_signature("")) == 1.0 and likeness(whole_signature(""), whole_signature("a")) == 0.0


def expected(docs):
    rows = sorted(docs)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, changed = whole_signature(text), whole_signature(edited)
        out.append((
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed),
            likeness(own, changed), likeness(own, whole_signature(following)),
        ))
    return out


def test_following_documents_across_ranges(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], DOCS + ", fingerprint string, near_next double").repartition(6)
    assert sorted(map(tuple, with_following(frame).collect())) == expected(docs)


def test_edges(spark):
    single = with_following(spark.createDataFrame([(7, "abcdabcd")], DOCS)).collect()
    assert [tuple(r) for r in single] == expected([(7, "abcdabcd")])
    odd = [(1, None), (1, None), (2, ""), (2, "b" * 30_000), (None, "no id"), (None, None), (5, "x"), (5, "x")]
    rows = with_following(spark.createDataFrame(odd, DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in rows) == sorted((i or -1, len(t or "")) for i, t in odd)
    assert with_following(spark.createDataFrame([], DOCS)).count() == 0
    assert with_following(spark.createDataFrame([(None, None)], DOCS)).first()["near_next"] == 1.0


def test_column_form(spark):
    got = spark.createDataFrame(corpus(10) + [(99, None)], DOCS).select("text", fingerprint(F.col("text")).alias("f")).collect()
    assert all(r["f"] == as_text(whole_signature(r["text"] or "")) for r in got)
