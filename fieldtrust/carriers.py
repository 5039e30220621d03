"""The given tables in the shapes the operators work on.

Orders with their lines stand in for invoices, events for the job log and for scored fields,
documents and pages for texts. Rendering (date forms, amount texts, misses) follows the keys by
modulus, so that plain SQL can say the same. Whole tables go in; per-document arrays have a fixed
number of entries, so no order, customer or user however large is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions.fields import field_struct, location, no_location, wrap_fields
from fieldtrust.operators.ranking import running_sums, spread_positions
from fieldtrust.schemas import INVOICE_FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: net sum, tax sum (exact decimals) and the first supplier."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    net = price * (F.lit(1.0) - F.col("l_discount")).cast("decimal(3,2)")
    tax = net * F.col("l_tax").cast("decimal(3,2)")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.sum(net).alias("net"), F.sum(tax).alias("tax"), F.min("l_suppkey").alias("suppkey"))
        .select("k", "suppkey", F.round("net", 2).alias("net"), F.round("tax", 2).alias("tax"))
    )


def invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: one invoice per order that has lines, as plain columns."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", "o_orderdate"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    null = F.lit(None)
    joined = (
        orders.join(order_totals(spark, sf_dir), "k")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        "k",
        F.concat(F.lit("invoice_"), F.col("k"), F.lit(".pdf")).alias("doc_name"),
        F.concat(F.lit("INV-"), F.col("k")).alias("invoice_number"),
        iso(F.col("o_orderdate")).alias("invoice_date"),
        F.when(F.col("k") % 3 != 0, iso(F.date_add("o_orderdate", 30))).alias("due_date"),
        F.col("s_name").alias("vendor_name"),
        F.concat(F.lit("27GST"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("vendor_gstin"),
        F.concat(F.col("s_suppkey").cast("string"), F.lit(" Trade Street, "), F.col("n_name")).alias("vendor_address"),
        F.col("c_name").alias("buyer_name"),
        F.when(
            F.col("c_mktsegment") != "BUILDING",
            F.concat(F.lit("29GST"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")),
        ).alias("buyer_gstin"),
        F.lit("INR").alias("currency"),
        F.col("net").cast("double").alias("subtotal"),
        F.struct(
            null.cast("double").alias("cgst"), null.cast("double").alias("sgst"),
            null.cast("double").alias("igst"), F.col("tax").cast("double").alias("total_tax"),
        ).alias("tax"),
        (F.col("net") + F.col("tax")).cast("double").alias("total_amount"),
    )


def invoice_truth(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """(k, doc_name, fields) of the ground truth, of ``records`` where those are there already."""
    records = invoice_records(spark, sf_dir) if records is None else records
    return records.select("k", "doc_name", wrap_fields(records).alias("fields"))


def rendered_date(k: Column, day: Column) -> Column:
    """Seven written forms of a date, chosen by key; the fourth is month before day."""
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "MMMM dd, yyyy", "dd MMMM yyyy"]
    pick = F.pmod(k, F.lit(len(forms)))
    out = F.date_format(day, forms[0])
    for i, form in enumerate(forms[1:], start=1):
        out = F.when(pick == i, F.date_format(day, form)).otherwise(out)
    return out


def confidence_of(k: Column, i: int) -> Column:
    return F.lit(0.5) + ((k * 31 + i * 17) % 51).cast("double") / F.lit(100.0)


def location_of(k: Column, i: int) -> Column:
    box = location(F.lit(0), F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.2))
    return F.when((k + i) % 23 != 0, box).otherwise(no_location())


def predicted_fields(records: DataFrame) -> Column:
    """Predictions with misses, other spellings, confidences and locations, all by key."""
    k = F.col("k")
    day = F.to_date("invoice_date")
    cents = F.when(k % 13 == 0, 0.01).when(k % 17 == 0, 1.0).otherwise(0.0)
    values: dict[str, tuple[Column, Column | None]] = {
        "invoice_number": (
            F.when(k % 97 == 5, None)
            .when(k % 10 == 3, F.concat(F.lit("  "), F.lower("invoice_number"), F.lit(" ")))
            .otherwise(F.col("invoice_number")),
            None,
        ),
        "invoice_date": (rendered_date(k, day), None),
        "due_date": (F.date_format(F.to_date("due_date"), "dd/MM/yyyy"), None),
        "vendor_name": (F.concat(F.upper("vendor_name"), F.lit("  ")), None),
        "vendor_gstin": (F.when(k % 29 != 0, F.col("vendor_gstin")), None),
        "vendor_address": (F.regexp_replace("vendor_address", ", ", "\n"), None),
        "buyer_name": (F.when(k % 11 == 0, F.lit("Unknown Buyer")).otherwise(F.col("buyer_name")), None),
        "buyer_gstin": (F.col("buyer_gstin"), None),
        "currency": (F.lit("inr"), None),
        "subtotal": (F.concat(F.lit("INR "), F.format_number(F.col("subtotal") + cents, 2)), None),
        "total_amount": (F.format_number("total_amount", 2), F.col("total_amount")),
        "tax": (
            F.when(k % 19 != 0, F.format_number("tax.total_tax", 2)),
            F.when(k % 19 != 0, F.col("tax.total_tax")),
        ),
    }
    return F.array(
        *[
            field_struct(name, values[name][0], values[name][1], confidence_of(k, i), location_of(k, i))
            for i, name in enumerate(INVOICE_FIELDS)
        ]
    )


def invoice_predictions(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """(k, doc_name, fields) of the predictions, before the gate; ``records`` as for the truth."""
    records = invoice_records(spark, sf_dir) if records is None else records
    return records.select("k", "doc_name", predicted_fields(records).alias("fields"))


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_name, text): invoices as plain text, some lines missing or written otherwise."""
    r = invoice_records(spark, sf_dir)
    k = F.col("k")

    def line(label: str, value: Column, present: Column | None = None) -> Column:
        text = F.concat(F.lit(label + ": "), value)
        return F.coalesce(text if present is None else F.when(present, text), F.lit(""))

    lines = [
        line("Invoice No", F.col("invoice_number")),
        line("Date", rendered_date(k, F.to_date("invoice_date"))),
        line("Due", F.col("due_date")),
        line("Seller", F.col("vendor_name")),
        line("GSTIN", F.col("vendor_gstin"), k % 29 != 0),
        line("Address", F.col("vendor_address")),
        line("Client", F.col("buyer_name")),
        line("Currency", F.col("currency")),
        line("Subtotal", F.concat(F.lit("INR "), F.format_number("subtotal", 2))),
        line("VAT", F.format_number("tax.total_tax", 2), k % 19 != 0),
        line("Total", F.format_number("total_amount", 2)),
    ]
    return r.select("k", "doc_name", F.concat_ws("\n", *lines).alias("text"))


def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_name, text): one account statement per customer."""
    c = table(spark, sf_dir, "customer")
    account = account_number(F.col("c_custkey"))
    text = F.concat_ws(
        "\n",
        F.lit("Account statement"),
        F.concat(F.lit("Account holder: "), F.col("c_name")),
        F.concat(F.lit("Account number: "), account),
        F.concat(F.lit("Bank: Bank of "), F.col("c_mktsegment")),
        F.lit("Currency: INR"),
        F.concat(F.lit("Closing balance: "), F.format_number("c_acctbal", 2)),
    )
    name = F.concat(F.lit("bankstmt_"), F.col("c_custkey"), F.lit(".pdf"))
    return c.select(F.col("c_custkey").alias("k"), name.alias("doc_name"), text.alias("text"))


# Lines on a page of an invoice, bookings on a page of a statement.
LINES_PER_PAGE, BOOKINGS_PER_PAGE = 8, 10


def amount(cents: Column) -> Column:
    return F.format_number(cents / F.lit(100.0), 2)


def invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_name, page, text): every line of every order, eight to a page, in sections of two layouts.

    Returned goods stand in a section of their own, without codes; every fourth order is printed with other column
    titles in another order, every sixth has a remark among its lines.
    """
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    quantity = F.col("l_quantity").cast("int")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        (F.col("l_returnflag") == "R").alias("returned"),
        F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" ("), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(")")).alias("description"),
        F.when(F.col("l_linenumber") % 5 == 0, "-").otherwise(F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("code"),
        quantity.alias("quantity"), F.col("l_extendedprice").alias("price"),
        (price * quantity * 100).cast("bigint").alias("cents"),
    )
    totals = lines.groupBy("k").agg(F.sum("cents").alias("net"))
    k = F.col("k")
    other = k % 4 == 0
    item = [F.col("description"), F.col("code"), F.col("quantity").cast("string"), F.format_number("price", 2), amount(F.col("cents"))]
    plain, shuffled = F.concat_ws("  ", *item), F.concat_ws(" | ", item[0], item[3], item[2], item[1], item[4])
    short = F.concat_ws("  ", item[0], item[2], item[3], item[4])
    line = F.when(F.col("returned"), short).when(other, shuffled).otherwise(plain)
    pages = (
        spread_positions(lines, ["k"]).withColumn("page", F.floor(F.col("position") / LINES_PER_PAGE).cast("int"))
        .groupBy("k", "page").agg(
            # Eight lines at most.
            F.collect_list(F.when(~F.col("returned"), line)).alias("goods"), F.collect_list(F.when(F.col("returned"), line)).alias("returns"),
        )
        .join(totals, "k")
    )
    tax = F.expr("net div 10")
    heading = F.when(other, "Item | Rate | Quantity | HSN/SAC | Line total").otherwise("Description  HSN  Qty  Unit price  Amount")
    remark = F.when(k % 6 == 0, F.array(F.lit("Goods dispatched as agreed"))).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Invoice No: INV-"), k), F.concat(F.lit("Page: "), F.col("page") + 1), F.lit(""),
        F.when(F.size("goods") > 0, F.concat_ws("\n", heading, F.concat(F.slice("goods", 1, 1), remark, F.slice("goods", 2, LINES_PER_PAGE)), F.lit(""))),
        F.when(F.size("returns") > 0, F.concat_ws("\n", F.lit("Particulars  Qty  Rate  Amount"), F.col("returns"), F.lit(""))),
        F.concat(F.lit("Subtotal: INR "), amount(F.col("net") + F.when(k % 41 == 7, 100).otherwise(0))),
        F.when(k % 2 == 0, F.concat(F.lit("CGST @ 5%: "), amount(tax - F.expr("net div 10 div 2")))),
        F.when(k % 2 == 0, F.concat(F.lit("SGST @ 5%: "), amount(F.expr("net div 10 div 2")))),
        F.when(k % 2 != 0, F.concat(F.lit("IGST @ 10%: "), amount(tax))),
        F.when(k % 3 == 0, F.concat(F.lit("VAT: "), amount(tax))),
        F.concat(F.lit("Total: "), amount(F.col("net") + tax)),
    )
    return pages.select("k", F.concat(F.lit("invoice_"), k, F.lit(".pdf")).alias("doc_name"), "page", text.alias("text"))


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_name, page, text): every order as a booking of its customer's account, ten to a page, with running balances.

    One balance in 97 is printed one unit too high. Odd accounts have other column titles and no references.
    """
    key, account = F.col("o_orderkey"), F.col("o_custkey")
    cents = (F.col("o_totalprice").cast("decimal(14,2)") * 100).cast("bigint")
    booked = table(spark, sf_dir, "orders").select(
        account.alias("k"), key.alias("booking"), F.col("o_orderdate").alias("day"), F.when(key % 3 == 0, cents).alias("credit"),
        F.when(key % 3 != 0, cents).alias("debit"), F.when(key % 3 == 0, cents).otherwise(-cents).alias("delta"), F.lit(1).alias("one"),
    )
    placed = running_sums(booked, "booking", {"delta": "upto", "one": "position"}, ["k"])
    k = F.col("k")
    opening = k * 100 + 1_000_000
    printed = opening + F.col("upto") + F.when(F.col("booking") % 97 == 5, 100).otherwise(0)
    written = [
        F.when(k % 2 == 0, F.date_format("day", "dd/MM/yyyy")).otherwise(iso(F.col("day"))),
        F.concat(F.lit("ORDER "), F.col("booking")), F.when(F.col("booking") % 4 == 0, F.concat(F.lit("REF"), F.col("booking"))).otherwise("-"),
        F.coalesce(amount(F.col("debit")), F.lit("-")), F.coalesce(amount(F.col("credit")), F.lit("-")), amount(printed),
    ]
    line = F.when(k % 2 == 0, F.concat_ws("  ", *written)).otherwise(F.concat_ws(" | ", written[0], written[1], *written[3:]))
    pages = (
        placed.withColumn("page", F.floor((F.col("position") - 1) / BOOKINGS_PER_PAGE).cast("int"))
        # Ten lines at most.
        .groupBy("k", "page").agg(F.sort_array(F.collect_list(F.struct("booking", line.alias("line")))).alias("lines"))
    )
    spans = booked.groupBy(k.alias("_k")).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    heading = F.when(k % 2 == 0, "Date  Narration  Ref no  Debit  Credit  Balance").otherwise("Value date | Particulars | Withdrawals | Deposits | Balance")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Account number: "), account_number(k)),
        F.concat(F.lit("Statement period: "), F.date_format("first", "dd/MM/yyyy"), F.lit(" to "), F.date_format("last", "dd/MM/yyyy")),
        F.concat(F.lit("Opening balance: "), amount(opening)), F.lit(""),
        heading, F.transform("lines", lambda x: x["line"]), F.concat(F.lit("Page "), F.col("page") + 1),
    )
    name = F.concat(F.lit("bankstmt_"), k, F.lit(".pdf"))
    return pages.join(spans, k == F.col("_k")).select("k", name.alias("doc_name"), "page", text.alias("text"))


def account_number(key: Column) -> Column:
    """Twelve digits, dashed for every other key."""
    digits = F.lpad(key.cast("string"), 12, "0")
    dashed = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4), F.substring(digits, 9, 4))
    return F.when(key % 2 == 0, dashed).otherwise(digits)


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored fields: the type is the field, the user the document, ``k`` the confidence."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    conf = k.cast("double") / F.lit(100.0)
    value = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    loc = F.when(F.col("event_id") % 7 != 0, location_of(F.lit(1), 0)).otherwise(no_location())
    # Right more often at high confidence; every 15th pair has no ground truth.
    correct = F.when(F.col("event_id") % 15 != 0, F.col("value") * k < F.lit(4000.0) + k * k)
    return e.select(
        F.col("user_id").alias("doc_name"),
        F.col("event_id"),
        F.col("event_type").alias("field"),
        value.cast("string").alias("value"),
        value.alias("value_num"),
        conf.alias("confidence"),
        loc.alias("source_location"),
        F.lit("extracted").alias("status"),
        correct.alias("correct"),
    )


# Event types as audit events.
AUDIT_OF_EVENT = {
    "signup": "doc_received",
    "view": "extraction_started",
    "click": "extraction_done",
    "error": "extraction_failed",
    "purchase": "field_resolved",
}
EVENTS_PER_JOB = 8


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the audit log of jobs, eight per job; columns of ``EVENT_DDL`` and ``queue``."""
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for event, audit in AUDIT_OF_EVENT.items():
        kind = F.when(F.col("event_type") == event, F.lit(audit)).otherwise(kind)
    staged = e.withColumn("audit", kind).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    done = F.col("audit") == "extraction_done"
    ended = F.col("audit").isin("extraction_done", "extraction_failed")
    item_fields = ["invoice_number", "invoice_date", "due_date"]
    items = F.array(
        *[
            F.struct(
                F.lit(None).cast("string").alias("doc_name"), F.lit(name).alias("field_name"),
                F.col("user_id").cast("string").alias("extracted_value"),
                (F.col("k").cast("double") / 100.0).alias("confidence"),
                no_location().alias("source_location"),
                F.when(F.col("k") < 50, F.lit("abstained")).otherwise(F.lit("no_source_location")).alias("reason"),
                ((F.col("k") + i) % 5 == 0).alias("resolved"),
                F.lit(None).cast("string").alias("corrected_value"),
                F.lit(None).cast("string").alias("resolved_by"),
            )
            for i, name in enumerate(item_fields)
        ]
    )
    return staged.select(
        F.floor(F.col("event_id") / EVENTS_PER_JOB).cast("string").alias("job_id"),
        F.col("audit").alias("event_type"),
        F.col("event_id").alias("ord"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("doc_"), F.col("user_id")).alias("doc_name"),
        F.when(done, F.when(F.col("user_id") % 3 == 0, F.lit("bank_statement"))
               .when(F.col("user_id") % 3 == 1, F.lit("invoice")).otherwise("")).alias("doc_type"),
        F.when(done, F.slice(items, 1, F.col("k") % 4)).alias("queue"),
        F.when(F.col("audit") == "extraction_failed", F.concat(F.lit("error "), F.col("k"))).alias("error_message"),
        F.when(ended, F.col("value")).alias("processing_time_s"),
    )
