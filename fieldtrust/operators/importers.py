"""Raw batch records -> ground-truth labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.parsing import (
    normalize_ref_no,
    parse_amount,
    parse_currency,
    parse_slash_date,
    parse_statement_date,
    slash_date_bad,
    unread,
)
from fieldtrust.functions.staging import computed_once
from fieldtrust.schemas import LINE_ITEM_DDL, META_DDL, TAX_DDL, TRANSACTION_DDL


# Who a label says it was made by.
_BY_CSV, _BY_STATEMENT_BATCH = "csv_ground_truth", "huggingface_ground_truth"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _meta(doc_file: Column, doc_type: str | None, by: str, at: str | None, note: str | None) -> Column:
    return F.struct(
        doc_file.alias("doc_file"), F.lit(doc_type).alias("doc_type"), F.lit(by).alias("labeled_by"),
        F.lit(at).alias("labeled_at"), F.lit(note).alias("note"),
    ).cast(META_DDL)


def _first_error(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


def invoice_labels(
    df: DataFrame, labeled_at: str | None = None, note: str | None = None
) -> DataFrame:
    """(filename, raw) -> label columns and ``row_error``.

    ``raw`` is the parsed JSON struct, NULL when the JSON was bad. A row with an error keeps only
    its file name and the error text; the job goes on.
    """
    raw, total = F.col("raw"), F.col("raw.summary")
    no_items = F.array().cast(
        "array<struct<description:string,quantity:string,net_price:string,net_worth:string>>"
    )
    items = F.coalesce(F.col("raw.items"), no_items)
    # Every amount is parsed once; the checks below only look at what came out.
    staged = computed_once(
        df,
        "_parsed",
        F.struct(
            F.transform(
                items,
                lambda i: F.struct(
                    i["description"].alias("description"), _null("string").alias("hsn_sac"),
                    parse_amount(i["quantity"]).alias("quantity"),
                    parse_amount(i["net_price"]).alias("unit_price"),
                    parse_amount(i["net_worth"]).alias("line_total"),
                ),
            ).alias("line_items"),
            parse_amount(total["net_worth"]).alias("subtotal"),
            parse_amount(total["vat_amount"]).alias("total_tax"),
            parse_amount(total["gross_worth"]).alias("total_amount"),
        ),
    )
    parsed = F.col("_parsed")
    bad_items = F.exists(
        F.zip_with(
            items, parsed["line_items"],
            lambda i, p: unread(i["quantity"], p["quantity"]) | unread(i["net_price"], p["unit_price"])
            | unread(i["net_worth"], p["line_total"]),
        ),
        lambda bad: bad,
    )
    error = _first_error(
        (raw.isNull(), "invalid JSON"),
        (slash_date_bad(raw["date_of_issue"]), "bad date_of_issue"),
        (bad_items, "bad item amount"),
        (
            unread(total["net_worth"], parsed["subtotal"]) | unread(total["vat_amount"], parsed["total_tax"])
            | unread(total["gross_worth"], parsed["total_amount"]),
            "bad summary amount",
        ),
    )
    return computed_once(staged, "row_error", error).select(
        "filename",
        "row_error",
        _meta(F.col("filename"), None, _BY_CSV, labeled_at, note).alias("_meta"),
        raw["invoice_no"].alias("invoice_number"),
        parse_slash_date(raw["date_of_issue"]).alias("invoice_date"),
        _null("string").alias("due_date"),
        raw["seller"]["name"].alias("vendor_name"),
        raw["seller"]["gstin"].alias("vendor_gstin"),
        raw["seller"]["address"].alias("vendor_address"),
        raw["client"]["name"].alias("buyer_name"),
        _null("string").alias("buyer_gstin"),
        parse_currency(total["total_gross_worth"]).alias("currency"),
        parsed["subtotal"].alias("subtotal"),
        F.struct(
            _null("double").alias("cgst"), _null("double").alias("sgst"),
            _null("double").alias("igst"), parsed["total_tax"].alias("total_tax"),
        ).cast(TAX_DDL).alias("tax"),
        parsed["total_amount"].alias("total_amount"),
        parsed["line_items"].cast(f"array<{LINE_ITEM_DDL}>").alias("line_items"),
    )


def _either(value: Column, fallback: Column) -> Column:
    """First text that is neither missing nor empty, as Python's ``or``."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


_AMOUNTS = ("transaction_amount", "available_balance", "debit", "credit", "balance")


def _amount_text(t: Column, key: str) -> Column:
    return F.nullif(F.trim(F.try_element_at(t, F.lit(key))), F.lit(""))


def _amount(t: Column, key: str) -> Column:
    """A transaction's number, also one written as text with separators."""
    text = _amount_text(t, key)
    return F.coalesce(text.try_cast("double"), parse_amount(text))


def transaction(t: Column) -> Column:
    """One raw transaction (string map) in either shape -> the common shape.

    The presence of the key ``cr_dr`` marks the shape with one signed amount.
    """

    def at(key: str) -> Column:
        return F.try_element_at(t, F.lit(key))

    signed = F.map_contains_key(t, "cr_dr")
    amount = _amount(t, "transaction_amount")
    return F.struct(
        parse_statement_date(_transaction_date(t)).alias("date"),
        at("description").alias("narration"),
        F.when(signed, F.when(at("cr_dr") == "DR", amount))
        .otherwise(_amount(t, "debit")).alias("debit"),
        F.when(signed, F.when(at("cr_dr") == "CR", amount))
        .otherwise(_amount(t, "credit")).alias("credit"),
        F.when(signed, _amount(t, "available_balance"))
        .otherwise(_amount(t, "balance")).alias("balance"),
        normalize_ref_no(at("cheque_no")).alias("ref_no"),
    )


def _transaction_date(t: Column) -> Column:
    return _either(F.try_element_at(t, F.lit("value_date")), F.try_element_at(t, F.lit("date")))


def statement_labels(
    df: DataFrame, labeled_at: str | None = None, note: str | None = None
) -> DataFrame:
    """(doc_file, raw) -> statement label columns and ``row_error``."""
    raw = F.col("raw")
    txs = F.coalesce(raw["transactions"], F.array().cast("array<map<string,string>>"))
    staged = computed_once(
        df, "_transactions", F.transform(txs, transaction).cast(f"array<{TRANSACTION_DDL}>")
    )
    bad_date = F.exists(
        F.zip_with(txs, F.col("_transactions"), lambda t, p: unread(_transaction_date(t), p["date"])),
        lambda bad: bad,
    )
    bad_amount = F.exists(
        txs, lambda t: F.exists(F.array(*[unread(_amount_text(t, k), _amount(t, k)) for k in _AMOUNTS]), lambda bad: bad)
    )
    error = _first_error(
        (raw.isNull(), "invalid JSON"), (bad_date, "bad transaction date"), (bad_amount, "bad transaction amount")
    )
    return computed_once(staged, "row_error", error).select(
        "doc_file",
        "row_error",
        _meta(F.col("doc_file"), "bank_statement", _BY_STATEMENT_BATCH, labeled_at, note).alias("_meta"),
        raw["account_holder"].alias("account_holder_name"),
        raw["account_number"].alias("account_number"),
        raw["bank_name"].alias("bank_name"),
        raw["ifsc_code"].alias("ifsc"),
        F.struct(raw["start_date"].alias("start"), raw["end_date"].alias("end")).alias("statement_period"),
        raw["opening_balance"].alias("opening_balance"),
        raw["closing_balance"].alias("closing_balance"),
        raw["currency"].alias("currency"),
        F.col("_transactions").alias("transactions"),
    )


def good_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("row_error").isNull())


def failed_rows(labels: DataFrame, name: str = "filename") -> DataFrame:
    """Failed list: name and reason, one row each."""
    return labels.filter(F.col("row_error").isNotNull()).select(name, "row_error")


def import_tally(labels: DataFrame, listing: DataFrame | None = None, name: str = "filename") -> DataFrame:
    """Counts by outcome: written, failed, and the written ones whose document is at hand."""
    outcome = F.when(F.col("row_error").isNull(), F.lit("written")).otherwise(F.lit("failed"))
    if listing is None:
        tagged = labels.select(outcome.alias("outcome"))
    else:
        docs = listing.select(F.col("doc_name").alias("_doc")).distinct()
        joined = labels.join(docs, labels[name] == docs["_doc"], "left")
        copied = F.col("row_error").isNull() & F.col("_doc").isNotNull()
        tagged = joined.select(
            F.explode(
                F.filter(
                    F.array(outcome, F.when(copied, F.lit("copied"))), lambda x: x.isNotNull()
                )
            ).alias("outcome")
        )
    return tagged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def draft_labels(records: DataFrame, doc: str = "doc_name") -> DataFrame:
    """Predicted plain records -> draft labels to be corrected by hand."""
    names = [c for c in records.columns if c != doc]
    return records.select(_meta(F.col(doc), None, "draft_from_extraction", None, None).alias("_meta"), *names)
