"""Bookings of account statements over their pages: rows, and whether the printed balances add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.operators.extract import transactions
from fieldtrust.operators.ranking import running_sums

MONEY = "decimal(18,2)"


def bookings(pages: DataFrame, account: str = "doc_name", page: str = "page", text: str = "text") -> DataFrame:
    """One row per booking of ``pages`` (account, page, text): account, page, row and the booking's members. Row-local."""
    found = pages.select(account, page, F.posexplode(transactions(F.col(text))).alias("row", "_booking"))
    return found.select(account, page, "row", "_booking.*")


def net_amount(debit: Column, credit: Column) -> Column:
    zero = F.lit(0).cast(MONEY)
    return (F.coalesce(credit.cast(MONEY), zero) - F.coalesce(debit.cast(MONEY), zero)).cast(MONEY)


def running_balances(rows: DataFrame, opening: DataFrame, account: str = "doc_name", page: str = "page", row: str = "row") -> DataFrame:
    """``rows`` with ``expected_balance``: the account's opening balance and all that is booked up to the row.

    Bookings are summed up per page first. Running sums over the pages' totals say what stands before a page, a window
    inside the page the rest: no window sees more than a page, or a cell of page numbers, however many pages an
    account has. ``opening`` (account, opening_balance) has one row per account; accounts without one have no
    expected balance. Pages are numbered in the order of the statement, rows in that of their page.
    """
    net = rows.withColumn("_net", net_amount(F.col("debit"), F.col("credit")))
    pages = net.groupBy(account, page).agg(F.sum("_net").alias("_page_net"))
    before = running_sums(pages, page, {"_page_net": "_upto"}, [account]).select(
        F.col(account).alias("_account"), F.col(page).alias("_page"), (F.col("_upto") - F.col("_page_net")).alias("_before")
    )
    inside = Window.partitionBy(account, page).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = net.withColumn("_inside", F.sum("_net").over(inside)).join(
        before, F.col(account).eqNullSafe(F.col("_account")) & F.col(page).eqNullSafe(F.col("_page"))
    )
    start = opening.select(F.col(account).alias("_opened"), F.col("opening_balance").cast(MONEY).alias("_opening"))
    joined = placed.join(start, F.col(account) == F.col("_opened"), "left")
    expected = (F.col("_opening") + F.col("_before") + F.col("_inside")).cast(MONEY)
    return joined.select(*rows.columns, expected.alias("expected_balance"))


def broken_balances(rows: DataFrame, opening: DataFrame, account: str = "doc_name", page: str = "page", row: str = "row") -> DataFrame:
    """Rows whose printed balance is not the expected one, or cannot be read. A wrong balance marks its own row only."""
    checked = running_balances(rows, opening, account, page, row)
    right = F.col("balance").cast(MONEY) == F.col("expected_balance")
    return checked.filter(F.col("expected_balance").isNotNull() & ~F.coalesce(right, F.lit(False)))
