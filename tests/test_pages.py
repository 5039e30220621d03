"""Sections, items, bookings, tax parts and periods of plain texts, and balances over pages."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import extract as x
from fieldtrust.operators.ranking import spread_positions
from fieldtrust.operators.statements import bookings, broken_balances, running_balances
from fieldtrust.operators.trust import unbalanced_items

INVOICE = """Invoice No: 7
Description  HSN  Qty  Unit price  Amount
Blue widget  8471  2  1,250.00  2,500.00
handle with care
Red  widget  -  x  3.00  6.00
Steel bolt  7318  10  0.50  5.00
Subtotal: 2,505.00
A | 1
Item | Rate | Quantity | HSN/SAC | Line total
Café table | 99.90 | 1 | 9403 | 99.90

QTY  DESCRIPTION
3  Chair
Total: 1
"""


def read(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("r")).first()["r"]


def test_sections_of_any_layout(spark):
    items = read(spark, INVOICE, x.line_items)
    assert [tuple(i) for i in items] == [
        ("Blue widget", "8471", 2.0, 1250.0, 2500.0),
        ("Steel bolt", "7318", 10.0, 0.5, 5.0),
        ("Café table", "9403", 1.0, 99.9, 99.9),
        ("Chair", None, 3.0, None, None),
    ]


@pytest.mark.parametrize("text,n", [("", 0), ("no tables", 0), ("Description  Qty", 0), ("Description  Qty\r\na  1\r\nb  2", 2), ("x\nItem  Qty\na  1\nItem  Qty\nb  2", 2)])
def test_edges_of_sections(spark, text, n):
    assert len(read(spark, text, x.line_items)) == n


def test_null_text(spark):
    assert read(spark, None, x.line_items) is None and read(spark, None, x.statement_period) is None and read(spark, None, x.tax_breakdown) is None


def test_long_sections_do_not_overflow(spark):
    text = "Item  Qty\n" + "\n".join(f"part {i}  {i}" for i in range(20_000))
    items = read(spark, text, x.line_items)
    assert len(items) == 20_000 and items[-1]["quantity"] == 19_999.0


def test_transactions(spark):
    text = "Date  Narration  Ref no  Debit  Credit  Balance\n02/01/2024  Chq Paid  567302  23,702.04  -  41,516.31\nnot a date  x  -  1  -  1\n2024-01-03  IMPS Cr  -  -  5.00  41,521.31\nPage 1"
    assert [tuple(t) for t in read(spark, text, x.transactions)] == [
        ("2024-01-02", "Chq Paid", 23702.04, None, 41516.31, "567302"),
        ("2024-01-03", "IMPS Cr", None, 5.0, 41521.31, None),
    ]


@pytest.mark.parametrize("text,want", [
    ("CGST @ 9%: 1.10\nSGST: 2.20", (1.1, 2.2, None, 3.3)), ("IGST: 5\nTax: 6.00", (None, None, 5.0, 6.0)), ("VAT: 7", (None, None, None, 7.0)), ("Total: 3", None), ("CGST: none", None),
])
def test_tax_parts(spark, text, want):
    got = read(spark, text, x.tax_breakdown)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("text,want", [
    ("Statement period: 01/01/2024 to 2024-03-31", ("2024-01-01", "2024-03-31")), ("Period: January 5, 2024 until soon", ("2024-01-05", None)), ("Periodic: x", None),
])
def test_periods(spark, text, want):
    got = read(spark, text, x.statement_period)
    assert (got and tuple(got)) == want


def statement(spark, accounts, wrong=()):
    """Pages of seven bookings; ``wrong`` (account, number) are printed one too high."""
    rng, rows, opening = random.Random(2), [], []
    for account, n in accounts:
        balance = 1000.0
        opening.append((account, balance))
        for i in range(n):
            amount = rng.randint(1, 9999) / 100
            debit = rng.random() < 0.5
            balance = round(balance + (-amount if debit else amount), 2)
            rows.append((account, i // 7, i % 7, amount if debit else None, None if debit else amount, balance + ((account, i) in wrong)))
    rows = spark.createDataFrame(rows, "doc_name string, page int, row int, debit double, credit double, balance double").repartition(3)
    return rows, spark.createDataFrame(opening, "doc_name string, opening_balance double")


def test_balances_over_pages(spark):
    wrong = {("hot", 0), ("hot", 6), ("hot", 7), ("hot", 499), ("b", 3)}
    rows, opening = statement(spark, [("hot", 500), ("b", 9), ("c", 1)], wrong)
    found = broken_balances(rows, opening).collect()
    assert {(r["doc_name"], r["page"] * 7 + r["row"]) for r in found} == wrong
    assert all(round(r["balance"] - float(r["expected_balance"]), 2) == 1.0 for r in found)
    assert running_balances(rows, opening).count() == 510


def test_balances_without_opening_or_rows(spark):
    rows, opening = statement(spark, [("a", 3), ("b", 2)])
    checked = running_balances(rows, opening.filter("doc_name = 'a'")).filter("doc_name = 'b'").collect()
    assert len(checked) == 2 and all(r["expected_balance"] is None for r in checked)
    assert broken_balances(rows.filter("false"), opening).count() == 0
    unread = rows.withColumn("balance", F.when(F.col("row") != 1, F.col("balance")))
    assert {(r["doc_name"], r["row"]) for r in broken_balances(unread, opening).collect()} == {("a", 1), ("b", 1)}


def test_bookings_keep_pages(spark):
    text = "Date | Balance\n2024-01-01 | 5\n2024-01-02 | 6"
    pages = spark.createDataFrame([("a", 0, text), ("a", 1, text), ("b", 0, "")], "doc_name string, page int, text string")
    assert [(r["doc_name"], r["page"], r["row"], r["balance"]) for r in bookings(pages).orderBy("page", "row").collect()] == [
        ("a", 0, 0, 5.0), ("a", 0, 1, 6.0), ("a", 1, 0, 5.0), ("a", 1, 1, 6.0)
    ]


def test_unbalanced_items(spark):
    ddl = "doc_name string, line_items array<struct<line_total:double>>, subtotal double"
    pages = spark.createDataFrame([
        ("ok", [(1.1,), (2.2,)], 4.3), ("ok", [(1.0,), (None,)], None), ("off", [(5.0,)], 6.0), ("none", [], None), ("empty", [], 1.0),
    ], ddl)
    assert sorted(tuple(r) for r in unbalanced_items(pages).collect()) == [("empty", 0, 0.0, 1.0), ("off", 1, 5.0, 6.0)]


def test_positions_have_no_gaps(spark):
    rows = [("hot", i % 50) for i in range(3000)] + [("b", 1)] * 5 + [(None, 1), (None, 2)]
    got = spread_positions(spark.createDataFrame(rows, "g string, v int"), ["g"]).collect()
    for group, n in (("hot", 3000), ("b", 5), (None, 2)):
        assert sorted(r["position"] for r in got if r["g"] == group) == list(range(n))


def test_positions_are_the_same_however_large_a_group_may_be(spark):
    rows = [(g, i % 40) for g, n in (("a", 90), ("b", 7), (None, 50), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v int")
    found = [sorted(((x["g"] or "", x["v"], x["position"]) for x in spread_positions(df, ["g"], group_rows=n).collect())) for n in (1000, 20, 0)]
    assert found[0] == found[1] == found[2]
    assert [p for g, p in sorted((g, p) for g, _, p in found[0]) if g == "a"] == list(range(90))


def test_one_window_numbers_groups_of_usual_size(spark):
    """No row is joined with counts of cells, of which a small group has as many as rows."""
    df = spark.createDataFrame([(1, 2)], "g int, v int")
    plan = spread_positions(df, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == plan.count("Window [row_number()")
