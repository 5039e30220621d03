import random

import pytest
from pyspark.sql import functions as F

from fieldtrust.functions import fields as fl
from fieldtrust.operators import gate, trust
from fieldtrust.plans.evaluation import report
from fieldtrust.schemas import INVOICE_FIELDS

DDL = (
    "doc_name string, field string, value string, value_num double, confidence double, "
    "source_location struct<page:int,bbox:array<double>>, status string, correct boolean"
)
BOX = (0, [0.1, 0.1, 0.5, 0.2])


def long(spark, rows):
    """rows of (doc, field, value, confidence, located, status, correct)"""
    return spark.createDataFrame(
        [(d, f, v, None, c, BOX if loc else None, s, ok) for d, f, v, c, loc, s, ok in rows], DDL
    )


def row(doc, field, conf, ok, value="x", located=True, status="extracted"):
    return (doc, field, value, conf, located, status, ok)


def test_pooled_accuracy(spark):
    df = long(spark, [
        row("1", "a", 0.9, True), row("1", "b", 0.9, True), row("2", "a", 0.9, False), row("2", "b", 0.9, True),
        row("1", "c", 0.9, None), row("2", "c", 0.9, None),
    ])
    got = {r["field"]: (r["accuracy"], r["n_scored"]) for r in trust.corpus_metrics(trust.cells(df)).collect()}
    assert got == {"a": (0.5, 2), "b": (1.0, 2), None: (0.75, 4)}
    assert tuple(trust.corpus_summary(trust.cells(df)).first()) == (0.75, 2, 4)


def test_pooled_is_not_mean_of_means(spark):
    df = long(spark, [row(str(i), "a", 0.9, True) for i in range(9)] + [row("1", "b", 0.9, False)])
    assert trust.corpus_summary(trust.cells(df)).first()["macro_accuracy"] == 0.9


def test_empty_corpus(spark):
    c = trust.cells(long(spark, []))
    assert tuple(trust.corpus_summary(c).first()) == (None, 0, 0)
    assert trust.hallucination_rate(c).first()[0] is None
    pairs = trust.calibrated(c)
    assert trust.expected_calibration_error(pairs).first()[0] is None
    assert trust.coverage_at_precision(pairs).first()[0] is None
    assert trust.reliability_table(pairs).collect() == []
    passed, message = trust.regression_gate(trust.corpus_summary(c)).first()
    assert not passed and "no documents" in message


def test_tax_total_counts_for_accuracy_only(spark):
    df = long(spark, [row("1", "tax.total_tax", 0.9, False), row("1", "currency", 0.9, True)])
    assert trust.corpus_summary(trust.cells(df)).first()["macro_accuracy"] == 0.5
    assert trust.coverage_at_precision(trust.calibrated(trust.cells(df))).first()[0] == 1.0


def test_ece(spark):
    df = long(spark, [row("1", "currency", 1.0, True), row("2", "currency", 0.95, False), row("3", "currency", 0.15, False)])
    pairs = trust.calibrated(trust.cells(df))
    bins = {r["bin_mid"]: (r["accuracy"], r["confidence"], r["n"]) for r in trust.reliability_table(pairs).collect()}
    assert bins == {0.95: (0.5, 0.975, 2), 0.15: (0.0, 0.15, 1)}
    assert trust.expected_calibration_error(pairs).first()[0] == pytest.approx(round((0.475 * 2 + 0.15) / 3, 4))


def test_hallucination_counts_abstained(spark):
    df = long(spark, [
        row("1", "a", 0.3, False, located=False, status="abstained"), row("1", "b", 0.9, True),
        row("1", "c", 0.5, None, value=None, located=False),
    ])
    c = trust.cells(df)
    assert trust.hallucination_rate(c).first()[0] == 0.5
    assert trust.hallucination_rate(c, accepted_only=True).first()[0] == 0.0
    nothing = trust.cells(long(spark, [row("1", "a", 0.5, None, value=None, located=False)]))
    assert trust.hallucination_rate(nothing).first()[0] == 0.0


def test_abstention_rate(spark):
    df = long(spark, [
        row("1", "a", 0.3, False, status="abstained"), row("1", "b", 0.3, None, status="abstained"), row("1", "c", 0.9, True),
    ])
    assert trust.abstention_rate(trust.cells(df)).first()[0] == 1.0
    none = long(spark, [row("1", "b", 0.3, None, status="abstained")])
    assert trust.abstention_rate(trust.cells(none)).first()[0] == 1.0


def brute_coverage(pairs, target):
    best = 0.0
    for t in {c for c, _ in pairs}:
        taken = [ok for c, ok in pairs if c >= t]
        if sum(taken) / len(taken) >= target:
            best = max(best, len(taken) / len(pairs))
    return round(best, 4) if best else None


@pytest.mark.parametrize("seed", range(3))
def test_coverage_equals_sweep(spark, seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(400):
        c = rng.choice([round(rng.random(), 2), 1 - rng.randint(0, 40) * 2**-53, rng.random()])
        pairs.append((c, rng.random() < 0.6 + 0.4 * c))
    df = long(spark, [row(str(i), "currency", c, ok) for i, (c, ok) in enumerate(pairs)])
    p = trust.calibrated(trust.cells(df))
    last = 2.0
    for target in (0.5, 0.9, 0.95, 0.99, 1.0):
        got = trust.coverage_at_precision(p, target).first()[0]
        assert got == brute_coverage(pairs, target)
        assert (got or 0.0) <= last
        last = got or 0.0


def test_coverage_recovers_after_a_dip(spark):
    pairs = [(0.9, True), (0.8, False), (0.7, True), (0.6, True), (0.5, True)]
    df = long(spark, [row(str(i), "currency", c, ok) for i, (c, ok) in enumerate(pairs)])
    assert trust.coverage_at_precision(trust.calibrated(trust.cells(df)), 0.8).first()[0] == 1.0


@pytest.mark.parametrize("acc,passed", [(0.98, True), (0.97, True), (1.0, True), (0.96, True), (0.94, False), (None, False)])
def test_regression_floor(spark, acc, passed):
    df = spark.createDataFrame([(acc,)], "macro_accuracy double")
    assert trust.regression_gate(df).first()["passed"] is passed


def documents(spark, docs):
    rows = [
        (name, [(f, v, None, c, BOX if v else None, "extracted") for f, (v, c) in fields.items()])
        for name, fields in docs.items()
    ]
    ddl = (
        "doc_name string, fields array<struct<field:string,value:string,value_num:double,confidence:double,"
        "source_location:struct<page:int,bbox:array<double>>,status:string>>"
    )
    return spark.createDataFrame(rows, ddl)


def test_score_documents(spark):
    truth = documents(spark, {
        "1": {"vendor_name": ("Acme", 1.0), "due_date": (None, 1.0), "tax": ("5", 1.0)},
        "2": {"vendor_name": ("Beta", 1.0)},
    })
    # Other field order on the predicted side, and a document that was never extracted.
    pred = documents(spark, {"1": {"tax": ("5.005", 0.9), "vendor_name": ("ACME", 0.5), "due_date": ("x", 0.9)}})
    got = {(r["doc_name"], r["field"]): r["correct"] for r in trust.score_documents(truth, pred).collect()}
    assert got == {
        ("1", "vendor_name"): True, ("1", "due_date"): None, ("1", "tax.total_tax"): True, ("2", "vendor_name"): False,
    }


def test_right_but_abstained_is_a_miss(spark):
    truth = documents(spark, {"1": {"vendor_name": ("Acme", 1.0)}})
    pred = truth.withColumn("fields", F.transform("fields", lambda f: fl.rebuilt(f, confidence=F.lit(0.5))))
    gated = pred.withColumn("fields", gate.apply_gate(F.col("fields")))
    assert trust.score_documents(truth, pred).first()["correct"] is True
    row = trust.score_documents(truth, gated).first()
    assert row["correct"] is False and row["value"] == "Acme" and row["confidence"] == 0.5


def test_report_matches_single_metrics(spark):
    rng = random.Random(5)
    rows = [
        row(str(d), f, round(rng.random(), 2), rng.choice([True, True, False, None]), located=rng.random() < 0.9)
        for d in range(40) for f in INVOICE_FIELDS
    ]
    df = long(spark, rows)
    got = {r["metric"]: r["value"] for r in report(df, 0.6)[0].collect()}
    c = trust.cells(df)
    assert got["ece"] == trust.expected_calibration_error(trust.calibrated(c)).first()[0]
    assert got["coverage"] == trust.coverage_at_precision(trust.calibrated(c), 0.6).first()[0]
    assert got["macro_accuracy"] == trust.corpus_summary(c).first()["macro_accuracy"]
    assert 0.0 <= got["ece"] <= 1.0 and got["n_docs"] == 40.0


def test_precision_recall(spark):
    df = long(spark, [
        row("1", "a", 0.9, True), row("2", "a", 0.9, False), row("3", "a", 0.9, False, value=None), row("4", "a", 0.9, None),
    ])
    got = {r["field"]: (r["precision"], r["recall"], r["f1"]) for r in trust.precision_recall(df).collect()}
    assert got["a"] == (0.3333, 0.3333, 0.3333)


def test_documents_with_different_fields_count_each(spark):
    from fieldtrust.functions.fields import field_struct

    rows = spark.createDataFrame([("a", "currency"), ("b", "vendor_name"), ("c", "unscored")], "doc_name string, name string")
    fields = rows.select("doc_name", F.array(F.transform(F.array(field_struct("currency", F.lit("INR"))), lambda f: f.withField("field", F.col("name")))[0]).alias("fields"))
    summary = trust.corpus_summary(trust.cells(trust.score_documents(fields, fields), merge=True)).first()
    assert (summary["n_docs"], summary["n_scored_pairs"], summary["macro_accuracy"]) == (2, 2, 1.0)


def shuffled_types(df):
    """Types of the columns that a plan's joins and exchanges move."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            found += [n.output().apply(i).dataType().catalogString() for n in below for i in range(n.output().size())]
        todo += below
    return found


def test_members_nobody_reads_are_not_shuffled(spark):
    docs = documents(spark, {"1": {"vendor_name": ("Acme", 1.0)}, "2": {"vendor_name": ("Beta", 1.0)}})
    progress = trust.doc_progress(trust.score_documents(docs, docs))
    types = shuffled_types(progress)
    # Neither places nor confidences, nor structs with both.
    assert types and not [t for t in types if "struct" in t]
    assert types.count("array<double>") == 2
    assert {tuple(r) for r in progress.collect()} == {("1", 1, 1, 0), ("2", 1, 1, 0)}


def test_unusual_names_and_states_are_kept(spark):
    ddl = "doc_name string, fields array<struct<field:string,value:string,value_num:double,confidence:double,source_location:struct<page:int,bbox:array<double>>,status:string>>"
    f = lambda name, value, status="extracted": (name, value, None, 0.5, BOX, status)
    truth = spark.createDataFrame([
        ("usual", [f(n, "x") for n in INVOICE_FIELDS]), ("few", [f("odd", "x"), f("currency", "x")]), ("none", None), ("empty", []),
        ("alone", [f("currency", "x")]), (None, [f("currency", "x")]),
    ], ddl)
    pred = spark.createDataFrame([
        ("usual", [f(n, "x", s) for n, s in zip(INVOICE_FIELDS, ["extracted", "abstained", "doubtful", None] * 3)]),
        ("few", [f("currency", "x", "abstained"), None, f(None, "x"), f("currency", "y")]), ("none", [f("currency", "x")]), ("alone", None),
        (None, [f("currency", "x")]),
    ], ddl)
    got = {(r["doc_name"], r["field"]): r for r in trust.score_documents(truth, pred).collect()}
    usual = [got["usual", trust.TAX_TOTAL if n == "tax" else n] for n in INVOICE_FIELDS]
    assert [r["status"] for r in usual] == ["extracted", "abstained", "doubtful", None] * 3
    assert all(r["value"] == "x" and r["source_location"]["bbox"] == BOX[1] and r["extracted_doc"] for r in usual)
    assert [r["first_of_doc"] for r in usual] == [True] + [False] * 11
    few = got["few", "currency"]
    assert (few["status"], few["value"], few["correct"], few["first_of_doc"]) == ("abstained", "x", False, True)
    assert len(got) == 15
    for doc, extracted in (("alone", True), (None, False)):
        r = got[doc, "currency"]
        assert (r["extracted_doc"], r["value"], r["status"], r["correct"]) == (extracted, None, None, False)


def test_plain_records_score_as_wrapped_ones(spark):
    ddl = """doc_name string, invoice_number string, invoice_date string, due_date string, vendor_name string, vendor_gstin string,
        vendor_address string, buyer_name string, buyer_gstin string, currency string, subtotal double, tax struct<cgst:double,total_tax:double>, total_amount double"""
    records = spark.createDataFrame([
        ("1", "7", "2024-01-05", None, "Acme", None, "1 Street, X", "Buyer", "29G", "INR", 10.0, (None, 1.0), 11.0),
        ("2", None, None, None, None, None, None, None, None, None, None, None, None),
        ("3", "8", "2024-01-06", None, "Beta", None, "2 Street, X", "Buyer", "29G", "INR", 20.0, (None, 2.0), 22.0),
    ], ddl)
    wrapped = records.select("doc_name", fl.wrap_fields(records).alias("fields"))
    pred = wrapped.filter("doc_name != '3'")
    rows = lambda truth: sorted(map(str, trust.score_documents(truth, pred).collect()))
    assert rows(records) == rows(wrapped) and len(rows(records)) == 36
    assert not [t for t in shuffled_types(trust.doc_progress(trust.score_documents(records, pred))) if "struct" in t]
