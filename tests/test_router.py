from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import router as r
from fieldtrust.operators.ranking import stratified_folds
from fieldtrust.session import fresh_path


@pytest.fixture(scope="module")
def training(spark):
    a = "Invoice number {} bill to customer, amount due total"
    b = "Account statement {} opening balance, closing balance, transactions"
    rows = [(f"i{n}", a.format(n), "invoice") for n in range(20)] + [(f"s{n}", b.format(n), "bank_statement") for n in range(15)]
    return spark.createDataFrame(rows, "doc_name string, text string, label string")


@pytest.fixture(scope="module")
def model(training):
    return r.fit_router(training)


def test_fit_and_predict(training, model):
    scored = model.predict(training)
    assert scored.filter("predicted_type != label").count() == 0
    assert scored.filter("confidence <= 0.5 or confidence > 1").count() == 0
    assert model.meta["n_examples"] == 35 and model.meta["classes"] == ["bank_statement", "invoice"]
    report = {x["class"]: (x["precision"], x["recall"], x["f1"], x["support"]) for x in r.class_report(scored).collect()}
    assert report == {"invoice": (1.0, 1.0, 1.0, 20), "bank_statement": (1.0, 1.0, 1.0, 15)}


def test_save_and_load(spark, training, model):
    path = fresh_path(spark, "router")
    model.save(path)
    again = r.RouterModel.load(path).predict(training)
    assert again.filter("predicted_type != label").count() == 0


def test_cross_validation(training):
    folds = r.cross_validate(training)
    rows = folds.collect()
    assert sorted(x["fold"] for x in rows) == [0, 1, 2, 3, 4] and sum(x["n"] for x in rows) == 35
    assert tuple(r.cv_summary(folds).first()) == (1.0, 0.0)


def test_too_few(training):
    with pytest.raises(ValueError, match="too few"):
        r.fit_router(training.limit(5))


def test_two_tiers(training, model):
    docs = training.withColumn("title", F.col("text")).withColumn(
        "text", F.when(F.col("doc_name").endswith("1"), F.lit(" ")).otherwise(F.col("text")))
    routed = r.route(docs, model, fallback_text="title").withColumn("true_type", F.col("label"))
    assert routed.count() == 35
    overall = {x["true_type"]: x["accuracy"] for x in r.router_accuracy(r.router_results(routed)).collect()}
    assert overall == {"invoice": 1.0, "bank_statement": 1.0, None: 1.0}
    assert r.misclassified(r.router_results(routed)).count() == 0


def test_keywords_undecided(spark):
    df = spark.createDataFrame([("x", "nothing here"), ("y", None)], "doc_name string, text string")
    assert [(x["predicted_type"], x["confidence"]) for x in r.route(df).collect()] == [("invoice", 0.5)] * 2


def test_training_set(spark):
    labels = spark.createDataFrame([("bankstmt_1", None), ("a", None), ("b", "invoice"), ("c", None)], "doc_name string, doc_type string")
    texts = spark.createDataFrame([("bankstmt_1", "x"), ("a", "y" * 2000), ("b", " ")], "doc_name string, text string")
    got = {x["doc_name"]: (x["label"], len(x["text"])) for x in r.training_set(labels, texts).collect()}
    assert got == {"bankstmt_1": ("bank_statement", 1), "a": ("invoice", 2000)}
    assert {x["label"]: x["n"] for x in r.class_distribution(r.training_set(labels, texts)).collect()} == {"bank_statement": 1, "invoice": 1}


def test_skips(spark):
    df = spark.createDataFrame([("a.pdf: tokens per day (TPD)",), ("b.pdf: x",)], "error string")
    assert {x["error_class"]: x["n"] for x in r.skip_summary(df).collect()} == {"tpd": 1, "other": 1}
    assert {tuple(x) for x in r.skipped_documents(df).collect()} == {("tpd", "a.pdf"), ("other", "b.pdf")}


def test_features_and_optimum(spark):
    """TF-IDF weights and the fitted coefficients against the formulas, worked out in numpy."""
    texts = ["alpha beta alpha", "beta gamma", "alpha gamma delta", "beta beta delta", "delta delta alpha"] * 3
    labels = [("a", "b")[i % 2] for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, labels)), "text string, label string")
    model = r.fit_router(df)
    counts = model.pipeline.stages[4]
    vocabulary = counts.vocabulary
    rows = model.pipeline.transform(df).select("text", "label", "_features").collect()

    def terms(text):
        words = text.split()
        return words + [" ".join(p) for p in zip(words, words[1:])]

    n = len(texts)
    frequency = np.array([sum(t in terms(x) for x in texts) for t in vocabulary])
    idf = np.log((1 + n) / (1 + frequency)) + 1
    x = np.array([[terms(row["text"]).count(t) for t in vocabulary] for row in rows]) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(x, np.array([row["_features"].toArray() for row in rows]))
    lr = [s for s in model.pipeline.stages if hasattr(s, "interceptVector")][0]
    y = np.array([row["label"] == "b" for row in rows], float)
    w, b = lr.coefficients.toArray(), lr.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # Gradient of  sum(log loss) + |w|^2 / 2  vanishes at the optimum.
    assert np.abs(x.T @ (p - y) + w).max() < 0.02 and abs((p - y).sum()) < 0.02


def test_first_pages(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "doc_name string, page int")
    assert r.first_pages(df).count() == 2


def test_training_record(training, model):
    record = r.training_record(training, model, r.cross_validate(training, n_folds=3)).first()
    assert (record["n_examples"], record["train_accuracy"], record["cv_accuracy_mean"]) == (35, 1.0, 1.0)
    assert record["classes"] == ["bank_statement", "invoice"]


def test_cross_validation_equals_fitting_each_fold(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for n in range(80):
        label = "ab"[n % 2]
        lean = words[:34] if label == "a" else words[6:]
        rows.append((f"d{n}", " ".join(rng.choice(lean, 5)), label))
    df = spark.createDataFrame(rows, "doc_name string, text string, label string")
    got = {x["fold"]: x["accuracy"] for x in r.cross_validate(df, n_folds=3, max_features=30).collect()}
    folds = stratified_folds(df, "label", "doc_name", 3)
    for i, accuracy in got.items():
        model = r.fit_router(folds.filter(F.col("fold") != i), max_features=30)
        held = model.predict(folds.filter(F.col("fold") == i))
        want = held.select(F.avg((F.col("predicted_type") == F.col("label")).cast("int"))).first()[0]
        assert accuracy == pytest.approx(want)
    assert min(got.values()) < 1.0


def _all_terms(text):
    words = text.split()
    return words + [" ".join(p) for p in zip(words, words[1:])]


@pytest.mark.parametrize(("n_words", "lean", "size"), [(60, 1.2, 40), (60, 0.0, 20), (12, 1.0, 200), (400, 0.0, 15)])
def test_vocabulary_equals_counting_every_bigram(spark, n_words, lean, size):
    """Also with many equal counts at the last place, and with fewer terms than places."""
    rng = np.random.default_rng(n_words + size)
    weights = 1 / np.arange(1, n_words + 1) ** lean
    names = [f"w{i:03d}" for i in range(n_words)]
    texts = [" ".join(rng.choice(names, rng.integers(0, 12), p=weights / weights.sum())) for _ in range(120)]
    words = r._with_words(spark.createDataFrame([(t,) for t in texts], "text string"), "words")
    totals = Counter(t for text in texts for t in _all_terms(text))
    want = sorted(totals, key=lambda t: (-totals[t], t))[:size]
    assert r._vocabulary(words, size) == want


def test_only_bigrams_of_frequent_words_are_counted(spark):
    texts = ["alpha beta alpha beta rare%d alpha" % i for i in range(30)] + ["gamma", "gamma"]
    words = r._with_words(spark.createDataFrame([(t,) for t in texts], "text string"), "words")
    totals = r._word_totals(words)
    assert sorted(r._words_of_pairs(totals, 2)) == ["alpha", "beta"]
    # The fifth place is shared by all rare words.
    assert r._words_of_pairs(totals, 5) is None
    got = {x["term"]: x["n"] for x in r._pair_totals(words, ["alpha", "rare1"]).collect()}
    assert got == {"rare1 alpha": 1}


def test_pairs_by_fold_stay_inside_their_rows(spark):
    df = spark.createDataFrame([(0, ["aa", "bb"]), (0, ["bb", "aa"]), (1, ["aa", "bb", "aa"]), (1, None), (1, []), (1, ["cc"])], "fold int, _tokens array<string>")
    got = {(x["fold"], x["term"]): x["n"] for x in r._pair_totals(df.coalesce(1), None, "fold").collect()}
    assert got == {(0, "aa bb"): 1, (0, "bb aa"): 1, (1, "aa bb"): 1, (1, "bb aa"): 1}


def test_examples_are_scored_without_their_texts(training, model):
    assert "text" not in model.examples.columns
    want = {(x["doc_name"], x["predicted_type"], round(x["confidence"], 9)) for x in model.predict(training).collect()}
    assert {(x["doc_name"], x["predicted_type"], round(x["confidence"], 9)) for x in model.predict(model.examples).collect()} == want
