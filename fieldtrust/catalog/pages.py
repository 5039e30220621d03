"""Texts of many pages: items, tax parts, bookings, periods and whether they add up."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrust import carriers
from fieldtrust.operators import extract as x
from fieldtrust.operators import statements
from fieldtrust.operators.trust import unbalanced_items


def extract_line_items(spark, sf):
    """Every item of every page, whatever the section's layout."""
    found = carriers.invoice_pages(spark, sf).select("doc_name", F.explode(x.line_items(F.col("text"))).alias("item"))
    return found.select("doc_name", "item.*")


def split_taxes(spark, sf):
    """Parts of the tax and their total, written or summed up; alike on all pages of an invoice."""
    tax = x.tax_breakdown(F.col("text")).alias("tax")
    return carriers.invoice_pages(spark, sf).select("doc_name", tax).groupBy("doc_name", "tax").agg(F.count(F.lit(1)).alias("n_pages")).select("doc_name", "tax.*", "n_pages")


def unbalanced_invoices(spark, sf):
    """Invoices whose items do not add up to the printed subtotal."""
    pages = carriers.invoice_pages(spark, sf)
    subtotal = x.normalize_number(x.rule_value(F.col("text"), x.INVOICE_RULES["subtotal"]))
    return unbalanced_items(pages.select("doc_name", x.line_items(F.col("text")).alias("line_items"), subtotal.alias("subtotal")))


def extract_transactions(spark, sf):
    return statements.bookings(carriers.statement_pages(spark, sf)).drop("page", "row")


def statement_periods(spark, sf):
    period = x.statement_period(F.col("text"))
    return carriers.statement_pages(spark, sf).select("doc_name", period.alias("period")).groupBy("doc_name", "period").agg(F.count(F.lit(1)).alias("n_pages")).select(
        "doc_name", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "n_pages")


def broken_balances(spark, sf):
    """Printed balances that are not the opening balance and everything booked since."""
    pages = carriers.statement_pages(spark, sf)
    opening = x.rule_record(pages.filter(F.col("page") == 0), {"opening_balance": x.STATEMENT_RULES["opening_balance"]}, ["opening_balance"], keep=["doc_name"])
    found = statements.broken_balances(statements.bookings(pages), opening)
    return found.select("doc_name", "narration", "balance", F.col("expected_balance").cast("double").alias("expected_balance"))


QUERIES = {
    f.__name__: f
    for f in (extract_line_items, split_taxes, unbalanced_invoices, extract_transactions, statement_periods, broken_balances)
}

_LINES = """lines AS (SELECT l_orderkey AS k, 'invoice_' || l_orderkey || '.pdf' AS doc_name, l_extendedprice AS unit_price, l_quantity::DOUBLE AS quantity,
    'Part ' || l_partkey || ' (' || l_returnflag || l_linestatus || ')' AS description,
    CASE WHEN l_returnflag <> 'R' AND l_linenumber % 5 <> 0 THEN lpad(l_suppkey::VARCHAR, 6, '0') END AS hsn_sac,
    (l_extendedprice::DECIMAL(12,2) * l_quantity::INT * 100)::BIGINT AS cents FROM lineitem),
    invoices AS (SELECT k, doc_name, sum(cents)::BIGINT AS net, count(*) AS n_items, ceil(count(*) / 8.0)::BIGINT AS n_pages FROM lines GROUP BY k, doc_name)"""
_BOOKINGS = """booked AS (SELECT o_custkey AS k, 'bankstmt_' || o_custkey || '.pdf' AS doc_name, o_orderkey AS booking, o_orderdate AS day,
    (o_totalprice::DECIMAL(14,2) * 100)::BIGINT AS cents FROM orders),
    running AS (SELECT *, o_open + sum(CASE WHEN booking % 3 = 0 THEN cents ELSE -cents END) OVER (PARTITION BY k ORDER BY booking) AS upto,
    CASE WHEN booking % 97 = 5 THEN 100 ELSE 0 END AS off FROM (SELECT *, k * 100 + 1000000 AS o_open FROM booked))"""

ORACLES = {
    "extract_line_items": f"WITH {_LINES} SELECT doc_name, description, hsn_sac, quantity, unit_price, cents / 100.0::DOUBLE AS line_total FROM lines",
    "split_taxes": f"""WITH {_LINES}, t AS (SELECT *, net // 10 AS tax FROM invoices) SELECT doc_name, CASE WHEN k % 2 = 0 THEN (tax - tax // 2) / 100.0::DOUBLE END AS cgst,
        CASE WHEN k % 2 = 0 THEN (tax // 2) / 100.0::DOUBLE END AS sgst, CASE WHEN k % 2 <> 0 THEN tax / 100.0::DOUBLE END AS igst, tax / 100.0::DOUBLE AS total_tax, n_pages FROM t""",
    "unbalanced_invoices": f"""WITH {_LINES} SELECT doc_name, n_items, net / 100.0::DOUBLE AS items_total, (net + 100) / 100.0::DOUBLE AS subtotal FROM invoices WHERE k % 41 = 7""",
    "extract_transactions": f"""WITH {_BOOKINGS} SELECT doc_name, strftime(day, '%Y-%m-%d') AS date, 'ORDER ' || booking AS narration, CASE WHEN booking % 3 <> 0 THEN cents / 100.0::DOUBLE END AS debit,
        CASE WHEN booking % 3 = 0 THEN cents / 100.0::DOUBLE END AS credit, (upto + off) / 100.0::DOUBLE AS balance, CASE WHEN k % 2 = 0 AND booking % 4 = 0 THEN 'REF' || booking END AS ref_no FROM running""",
    "statement_periods": f"""WITH {_BOOKINGS} SELECT doc_name, strftime(min(day), '%Y-%m-%d') AS period_start, strftime(max(day), '%Y-%m-%d') AS period_end,
        ceil(count(*) / 10.0)::BIGINT AS n_pages FROM booked GROUP BY doc_name""",
    "broken_balances": f"""WITH {_BOOKINGS} SELECT doc_name, 'ORDER ' || booking AS narration, (upto + off) / 100.0::DOUBLE AS balance, upto / 100.0::DOUBLE AS expected_balance FROM running WHERE off > 0""",
}
