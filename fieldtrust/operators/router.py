"""Document-type classifier on Spark ML: training set, features, fit, cross-validation, scoring."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IDF,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.parsing import error_class, error_doc, training_doc_type, training_text
from fieldtrust.functions.staging import computed_once
from fieldtrust.operators.ranking import stratified_folds
from fieldtrust.session import materialised

# Fixed values of the training recipe.
MAX_FEATURES = 1000
REGULARISATION_C = 1.0
MAX_ITER = 500
N_FOLDS = 5
SEED = 42
MIN_EXAMPLES = 10


def training_set(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_name, text, label) from labels (doc_name, doc_type) and texts (doc_name, text).

    Documents without text are dropped. How the two are joined is left to Spark: where labels are
    few, no text is moved.
    """
    joined = labels.join(texts, "doc_name")
    return joined.select(
        "doc_name",
        training_text(F.col("text")).alias("text"),
        training_doc_type(F.col("doc_type"), F.col("doc_name")).alias("label"),
    ).filter(F.col("text").isNotNull())


def first_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    """Only the first page of a document is looked at to tell its type."""
    return pages.filter(F.col(page) == 0)


def class_distribution(training: DataFrame) -> DataFrame:
    return training.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _token_stages() -> list:
    return [
        RegexTokenizer(
            inputCol="text", outputCol="_all_tokens", pattern=r"(?U)\b\w\w+\b", gaps=False
        ),
        StopWordsRemover(inputCol="_all_tokens", outputCol="_tokens"),
        NGram(n=2, inputCol="_tokens", outputCol="_bigrams"),
        SQLTransformer(statement="SELECT *, concat(_tokens, _bigrams) AS _terms FROM __THIS__"),
    ]


@dataclass
class RouterModel:
    """Fitted router: a Spark ML pipeline and its training record."""

    pipeline: PipelineModel
    meta: dict = field(default_factory=dict)
    #: The rows it was fitted on, with their counts in place of their texts; a loaded model has none.
    examples: DataFrame | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted_type`` and ``confidence`` (the winning class's probability).

        Rows that carry their counts already (``examples``) are not cut into terms again.
        """
        if "_tf" in df.columns:
            return _scored(PipelineModel(self.pipeline.stages[len(_token_stages()) + 1 :]), df)
        return _scored(self.pipeline, df)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> RouterModel:
        return RouterModel(PipelineModel.load(path))


_WORK_COLUMNS = [
    "_all_tokens", "_tokens", "_bigrams", "_terms", "_tf", "_tfidf", "_features", "_raw",
    "_probability", "_prediction", "_label",
]


def _scored(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    return (
        pipeline.transform(df)
        .withColumn("confidence", F.array_max(vector_to_array("_probability")))
        .drop(*_WORK_COLUMNS)
    )


def _with_words(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``_tokens`` in place of ``text``, written: texts are cut into words once, whoever reads those."""
    cut = PipelineModel(_token_stages()[:2]).transform(df)
    return materialised(cut.drop("text", "_all_tokens"), name)


def _with_terms(words: DataFrame) -> DataFrame:
    return PipelineModel(_token_stages()[2:]).transform(words).drop("_tokens", "_bigrams")


def _word_totals(words: DataFrame, *keys: str) -> DataFrame:
    """How often each word occurs (added up before the shuffle)."""
    return words.select(*keys, F.explode("_tokens").alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("n")
    )


def _count_pairs(kept: list[str] | None, key: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of neighbouring words per batch, of ``kept`` words only unless that is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if kept is None else pa.array(kept, pa.string())
        for batch in batches:
            lists = batch.column("_tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype("i8")
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            entries, codes = coded.dictionary, coded.indices.to_numpy().astype("i8")
            row = np.repeat(np.arange(len(sizes)), sizes)
            both = row[1:] == row[:-1]
            if wanted is not None:
                known = pc.is_in(entries, value_set=wanted).to_numpy(zero_copy_only=False)[codes]
                both &= known[1:] & known[:-1]
            groups = np.zeros(len(sizes), "i8") if key is None else batch.column(key).to_numpy().astype("i8")
            for group in np.unique(groups):
                at = np.flatnonzero(both & (groups[row[1:]] == group))
                pairs, n = np.unique(codes[at] * len(entries) + codes[at + 1], return_counts=True)
                first, second = np.divmod(pairs, max(1, len(entries)))
                terms = pc.binary_join_element_wise(entries.take(pa.array(first)), entries.take(pa.array(second)), " ")
                columns = {"term": terms, "n": pa.array(n, pa.int64())}
                if key is not None:
                    columns[key] = pa.array(np.full(len(n), group), pa.int32())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _pair_totals(words: DataFrame, kept: list[str] | None, key: str | None = None) -> DataFrame:
    """How often each bigram of ``kept`` words occurs; of all words where that is None. ``key`` names an integer column."""
    keys = [] if key is None else [key]
    schema = "term string, n long" + "".join(f", {k} int" for k in keys)
    counted = words.select(*keys, "_tokens").mapInArrow(_count_pairs(kept, key), schema)
    return counted.groupBy(*keys, "term").agg(F.sum("n").alias("n")).select(*keys, "term", "n")


def _top_terms(totals: DataFrame, max_features: int) -> list[str]:
    """The most frequent terms, equal counts in alphabetical order."""
    top = totals.orderBy(F.desc("n"), "term").limit(max_features)
    return [row["term"] for row in top.collect()]


def _words_of_pairs(totals: DataFrame, max_features: int) -> list[str] | None:
    """The words of which a bigram among the ``max_features`` most frequent terms can consist, None for any.

    A bigram is no more frequent than either of its words, and the last place of the vocabulary goes to nothing rarer
    than the last of as many words. Where very many words share that last count all bigrams are counted.
    """
    top = totals.orderBy(F.desc("n"), "term").limit(2 * max_features).collect()
    least = top[max_features - 1]["n"] if len(top) >= max_features else 0
    if len(top) == 2 * max_features and top[-1]["n"] == least:
        return None
    return [row["term"] for row in top if row["n"] >= least]


def _vocabulary(words: DataFrame, max_features: int) -> list[str]:
    """The most frequent words and bigrams."""
    totals = materialised(_word_totals(words), "word-totals")
    pairs = _pair_totals(words, _words_of_pairs(totals, max_features))
    return _top_terms(totals.unionByName(pairs), max_features)


def _fit_on_counts(
    counted: DataFrame, c: float = REGULARISATION_C, max_iter: int = MAX_ITER
) -> tuple[list, list[str], int]:
    """(stages after the counts, classes, examples) fitted on (_tf, label)."""
    n = counted.count()
    if n < MIN_EXAMPLES:
        raise ValueError(f"only {n} examples, too few to train on")
    # idf = ln((1 + n) / (1 + df)) + 1; Spark leaves the + 1 out, so it is put into the weights.
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted)
    weights = ElementwiseProduct(
        scalingVec=Vectors.dense([w + 1.0 for w in idf.idf.toArray()]),
        inputCol="_tf", outputCol="_tfidf",
    )
    unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol="_features")
    index = StringIndexer(
        inputCol="label", outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(counted)
    features = index.transform(unit.transform(weights.transform(counted)))
    # The loss is a mean here and a sum in the recipe, hence the division by n.
    model = LogisticRegression(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction",
        probabilityCol="_probability", rawPredictionCol="_raw", maxIter=max_iter, tol=1e-4,
        regParam=1.0 / (c * n), standardization=False,
    ).fit(features.select("_features", "_label"))
    named = IndexToString(inputCol="_prediction", outputCol="predicted_type", labels=index.labels)
    return [weights, unit, model, named], list(index.labels), n


def fit_router(
    training: DataFrame, max_features: int = MAX_FEATURES, **solver: object
) -> RouterModel:
    """Fit TF-IDF over uni- and bigrams with logistic regression on (text, label).

    Texts are cut into words once. Words are counted first, then the bigrams of words frequent enough for a bigram to
    have a place in the vocabulary. The counts, at most ``max_features`` numbers per text, are written, and all later
    passes read those, scoring of the same rows (``examples``) among them.
    """
    started = time.monotonic()
    words = _with_words(training, "words")
    counts = CountVectorizerModel.from_vocabulary(_vocabulary(words, max_features), "_terms", "_tf")
    counted = materialised(counts.transform(_with_terms(words)).drop("_terms"), "term-counts")
    tail, classes, n = _fit_on_counts(counted.select("_tf", "label"), **solver)
    meta = {
        "n_examples": n,
        "classes": sorted(classes),
        "train_time_s": round(time.monotonic() - started, 4),
    }
    return RouterModel(PipelineModel([*_token_stages(), counts, *tail]), meta, counted)


def cross_validate(
    training: DataFrame, n_folds: int = N_FOLDS, seed: int = SEED, key: str = "doc_name",
    max_features: int = MAX_FEATURES, **solver: object,
) -> DataFrame:
    """Accuracy per held-out fold (fold, accuracy, n).

    Each fold has its own vocabulary, but texts are still cut into words only once: term totals are
    kept per fold, so that every training part's totals are sums of them, and counts are taken
    once over the union of the vocabularies. Bigrams are counted where any part can need them.
    """
    words = _with_words(stratified_folds(training, "label", key, n_folds, seed), "fold-words")

    def without(totals: DataFrame, i: int) -> DataFrame:
        return totals.filter(F.col("fold") != i).groupBy("term").agg(F.sum("n").alias("n"))

    singles = materialised(_word_totals(words, "fold"), "fold-word-totals")
    kept = [_words_of_pairs(without(singles, i), max_features) for i in range(n_folds)]
    either = None if None in kept else sorted(set().union(*kept))
    pairs = materialised(_pair_totals(words, either, "fold"), "fold-pair-totals")
    totals = singles.unionByName(pairs)
    vocabularies = [_top_terms(without(totals, i), max_features) for i in range(n_folds)]
    union = sorted(set().union(*vocabularies))
    place = {term: i for i, term in enumerate(union)}
    counter = CountVectorizerModel.from_vocabulary(union, "_terms", "_all_tf")
    counted = materialised(counter.transform(_with_terms(words)).select("label", "fold", "_all_tf"), "fold-counts")
    scores = None
    for i, vocabulary in enumerate(vocabularies):
        own = VectorSlicer(inputCol="_all_tf", outputCol="_tf", indices=[place[t] for t in vocabulary])
        rows = own.transform(counted)
        tail, _, _ = _fit_on_counts(rows.filter(F.col("fold") != i), **solver)
        held_out = _scored(PipelineModel(tail), rows.filter(F.col("fold") == i))
        one = held_out.agg(
            F.lit(i).alias("fold"),
            F.avg((F.col("predicted_type") == F.col("label")).cast("int")).alias("accuracy"),
            F.count(F.lit(1)).alias("n"),
        )
        scores = one if scores is None else scores.unionAll(one)
    return scores


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.avg("accuracy").alias("cv_accuracy_mean"), F.stddev_pop("accuracy").alias("cv_accuracy_std")
    )


def class_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted_type") -> DataFrame:
    """Per class precision, recall, F1 and support."""
    confusion = predictions.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col(label).alias("class"), F.col("n").alias("support"),
                         F.lit(0).cast("bigint").alias("chosen"),
                         F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("support"),
                         F.col("n").alias("chosen"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hit")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hit", "chosen"), zero)
    recall = F.coalesce(F.try_divide("hit", "support"), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("chosen") + F.col("support")), zero)
    return sums.select(
        "class", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"), "support",
    )


def training_record(
    training: DataFrame, model: RouterModel, folds: DataFrame | None = None
) -> DataFrame:
    """One row about a fit: examples, classes, accuracies, time."""
    scored = model.predict(training)
    record = scored.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.avg((F.col("predicted_type") == F.col("label")).cast("int")).alias("train_accuracy"),
    ).withColumn("classes", F.array(*[F.lit(c) for c in model.meta["classes"]])).withColumn(
        "train_time_s", F.lit(float(model.meta["train_time_s"]))
    )
    if folds is None:
        return record
    cv = cv_summary(folds)
    return record.withColumn("cv_accuracy_mean", cv.select("cv_accuracy_mean").scalar()).withColumn(
        "cv_accuracy_std", cv.select("cv_accuracy_std").scalar()
    )


# Words that speak for a type where no trained model can decide.
INVOICE_WORDS = r"(?i)\b(?:invoice|bill to|subtotal|amount due|gstin)\b"
STATEMENT_WORDS = r"(?i)\b(?:statement|opening balance|closing balance|ifsc|account holder)\b"


def keyword_classifier(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``predicted_type`` and ``confidence`` by counting telling words; undecided is an
    invoice at 0.5."""

    def hits(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(F.col(text), F.lit(pattern)), F.lit(0)).cast("double")

    counted = computed_once(
        docs, "_hits", F.struct(hits(INVOICE_WORDS).alias("a"), hits(STATEMENT_WORDS).alias("b"))
    )
    a, b = F.col("_hits.a"), F.col("_hits.b")
    return (
        counted.withColumn(
            "predicted_type", F.when(b > a, F.lit("bank_statement")).otherwise(F.lit("invoice"))
        )
        .withColumn("confidence", F.coalesce(F.try_divide(F.greatest(a, b), a + b), F.lit(0.5)))
        .drop("_hits")
    )


def route(
    docs: DataFrame, model: RouterModel | None = None, text: str = "text",
    fallback_text: str | None = None,
) -> DataFrame:
    """Documents with ``predicted_type`` and ``confidence``.

    The trained model decides where there is text; the fallback classifier takes the rest, and
    everything when there is no model.
    """
    if model is None:
        return keyword_classifier(docs, fallback_text or text)
    usable = F.coalesce(training_text(F.col(text)).isNotNull(), F.lit(False))
    first = model.predict(docs.filter(usable))
    return first.unionByName(keyword_classifier(docs.filter(~usable), fallback_text or text))


def router_results(predictions: DataFrame) -> DataFrame:
    """(doc_name, true_type, predicted_type, confidence, correct)."""
    return predictions.select(
        "doc_name", "true_type", "predicted_type", "confidence",
        (F.col("true_type") == F.col("predicted_type")).alias("correct"),
    )


def router_accuracy(results: DataFrame) -> DataFrame:
    """Accuracy per true type and, in the row ``true_type = NULL``, overall."""
    return results.rollup("true_type").agg(
        F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"),
        F.count_if(F.col("correct")).alias("n_correct"),
        F.count(F.lit(1)).alias("n"),
    )


def misclassified(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("correct"))


def skip_summary(errors: DataFrame, error: str = "error") -> DataFrame:
    """Skipped documents by quota class."""
    return errors.groupBy(error_class(F.col(error)).alias("error_class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def skipped_documents(errors: DataFrame, error: str = "error") -> DataFrame:
    """One row per skipped document with its class."""
    return errors.select(
        error_class(F.col(error)).alias("error_class"), error_doc(F.col(error)).alias("doc_name")
    )
