"""Lexicon matching against a plain scan, learning on planted words, and the edges."""

import random
import re
import zlib

from pyspark.sql import functions as F

from fieldtrust.llm.toxicity import FOLDING, Matcher, Model, _sample, accepted, fit, fold, held_out, score, units

DOCS, LABELS = "doc_id long, text string, score double", "doc_id long, quality int, toxic int"
WORDS = "lorem ipsum dolor sit amet elit sed tempor magna aliqua enim minim quis nisi aute irure velit esse nulla".split()


def corpus(n=600, seed=3):
    """Every fourth document holds one of two planted words, some disguised; the first is fair in one phrase."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2 + len(words) // 50):
                words.insert(rng.randrange(len(words)), rng.choice(["grubbel", "vile", "grubbel", "vile", "gгubbeł", "V1LE!"]))
        elif i % 40 == 1:
            words[3:3] = ["vile", "vortex"]
        docs.append((i, " ".join(words), 0.0))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_folding():
    assert fold("  V1LE!  Ǵrub-bеl\n​ÜBER  ＴＲＡＳＨ 𝐬𝐜𝐮𝐦 !diot c1own") == "viie! grub-bei uber trash scum idiot ciown"
    assert fold("") == "" and FOLDING[ord("а")] == "a"


def test_hits_equal_a_plain_scan():
    weights = {fold(w): float(len(w)) for w in ("vile", "trash", "grub", "é")} | {"grub*": 2.0, "tra*": 9.0}
    matcher = Matcher(Model(weights, (fold("vile vortex"), fold("trash can")), (0.0, 0.0, 0.0)))
    rng = random.Random(1)
    for _ in range(300):
        text = fold("".join(rng.choice(["vile", "trash", " ", " can", " vortex", "grub", "e", ".", "s", "-"]) for _ in range(30)))
        want = []
        for m in re.finditer(r"[^\W_]+", text):
            start, word = m.span()[0], m.group()
            best = max((weights[u] for u in weights if (u == word) or (u[-1] == "*" and word.startswith(u[:-1]))), default=None)
            covered = any(
                p.start() <= start < p.end() for e in matcher.model.exceptions for p in re.finditer(rf"(?<![^\W_]){re.escape(e)}(?![^\W_])", text)
            )
            if best is not None and not covered:
                want.append((start, best))
        assert sorted((s, w) for s, _, w in matcher.hits(text)) == want, text


def test_learns_planted_words_and_the_exception(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    model = fit(frame, spark.createDataFrame(labels, LABELS))
    assert {"grubbei", "viie"} <= set(model.weights)
    assert "viie vortex" in model.exceptions
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", score(model).alias("s")).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i, _, _ in docs) >= 0.98 * len(docs)
    kept = accepted(frame, model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert kept.count() == sum(s < 0.5 for s in got.values())


def test_copies_of_one_toxic_text_teach_nothing(spark):
    docs, labels = corpus()
    docs += [(10_000 + i, f"zebra quagga {' '.join(WORDS)} vile grubbel", 0.0) for i in range(150)]
    labels += [(10_000 + i, 1, 1) for i in range(150)]
    model = fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert not {"zebra", "quagga", "zebr*", "quag*"} & set(model.weights)


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", 1.0), (2, "", 1.0), (None, "vile", None), (4, "vile " * 50_000, 2.0)], DOCS)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0)], LABELS)
    untaught = fit(docs, labels)
    assert docs.select(score(untaught).alias("s")).where("s < 0.01").count() == 5
    model = Model({"viie": 5.0}, (), (-3.0, 0.1, 0.5))
    got = [tuple(r) for r in docs.select("doc_id", F.round(score(model), 3).alias("s")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0.047), (2, 0.047), (2, 0.047), (None, round(Matcher(model).score("vile"), 3)), (4, 1.0)], key=str)
    empty = spark.createDataFrame([], DOCS)
    assert accepted(empty, fit(empty, spark.createDataFrame([], LABELS))).count() == 0
    assert units("abcdefg") == ["abcdefg", "abcd*", "abcde*", "abcdef*"]


INSULTS = "grubbel vile scumbag nitwit dimwit".split()


def insulting(copies, n=400, seed=5):
    """Toxic rows with two of five insults each, and copies of one toxic text that holds all; each near copy has one word changed."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(40)]
        for word in rng.sample(INSULTS, 2) if i % 4 == 0 else ():
            words.insert(rng.randrange(len(words)), word)
        docs.append((i, " ".join(words), int(i % 4 == 0)))
    text = f"zebra {' of '.join(INSULTS)} quagga {' '.join(WORDS)}".split()
    for i in range(copies):
        at = rng.randrange(len(text))
        near = text if i % 2 else [*text[:at], f"w{rng.randrange(10**6)}", *text[at + 1:]]
        docs.append((10_000 + i, " ".join(near), 1))
    return docs


def test_copies_do_not_take_words_out(spark):
    for copies in (0, 20, 300):
        rows = insulting(copies)
        frame = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], DOCS)
        model = fit(frame, spark.createDataFrame([(i, 1, x) for i, _, x in rows], LABELS))
        assert {fold(w) for w in INSULTS} <= set(model.weights), copies
        assert not {"zebra", "quagga"} & set(model.weights), copies


def test_rare_words_of_a_large_sample_are_learned(spark):
    """Each of 100 slurs stands in 30 of 3 000 toxic texts, a little under 1% once some are held out, and in no clean one."""
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("bcdfgjkmnpqrstvwxz") for _ in range(6))
    slurs, rows = [name() for _ in range(100)], []
    for i in range(6200):
        words = [rng.choice(WORDS) + rng.choice("abcdefg") for _ in range(12)]
        if i < 3000:
            words[rng.randrange(len(words))] = slurs[i % 100]
        rows.append((i, " ".join(words), int(i < 3000 or i >= 6000)))
    frame = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], DOCS)
    model = fit(frame, spark.createDataFrame([(i, 1, x) for i, _, x in rows], LABELS))
    assert {fold(w) for w in slurs} <= set(model.weights)
    slurred = frame.where("doc_id < 3000")
    assert accepted(slurred, model).count() <= 0.01 * slurred.count()


def test_the_sample_is_bounded_in_rows(spark):
    """A third of all rows has one labelled id, half of these rows with one text."""
    docs = [(i, f"text {i}", 0.0) for i in range(400)] + [(1, "hot", 0.0)] * 100 + [(1, f"hot {i}", 0.0) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], LABELS)
    rows = _sample(spark.createDataFrame(docs, DOCS), labels, 1000).collect()
    assert len(rows) == len({(r["text"], r["toxic"]) for r in rows}) and ("hot", 1) in {tuple(r) for r in rows}
    few = _sample(spark.createDataFrame(docs, DOCS), labels, 20).groupBy("toxic").count().collect()
    assert len(few) == 2 and all(r["count"] <= 20 for r in few)
