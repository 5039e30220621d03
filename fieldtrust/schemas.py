"""Declared record shapes. Every scalar is nullable; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields of an invoice that carry a trust signal, in report order.
INVOICE_FIELDS = [
    "invoice_number",
    "invoice_date",
    "due_date",
    "vendor_name",
    "vendor_gstin",
    "vendor_address",
    "buyer_name",
    "buyer_gstin",
    "currency",
    "subtotal",
    "total_amount",
    "tax",
]

# Accuracy is scored on the nested total under its dotted name ...
TAX_TOTAL = "tax.total_tax"
SCORED_FIELDS = INVOICE_FIELDS[:-1] + [TAX_TOTAL]
# ... while calibration and coverage look fields up by their model name, where that one is `tax`.
CALIBRATED_FIELDS = INVOICE_FIELDS[:-1]

# How a field is normalised before comparison.
DATE_FIELDS = ["invoice_date", "due_date"]
NUMBER_FIELDS = ["subtotal", "total_amount", TAX_TOTAL, "tax"]
ADDRESS_FIELDS = ["vendor_address", "buyer_address"]

# Job states by audit event.
STATUS_OF_EVENT = {
    "doc_received": "pending",
    "extraction_started": "running",
    "extraction_done": "done",
    "extraction_failed": "failed",
}

DEFAULT_THRESHOLD = 0.80

LOCATION = T.StructType(
    [T.StructField("page", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))]
)
LOCATION_DDL = "struct<page:int,bbox:array<double>>"

# One extracted field with its trust signal. `value_num` holds values that were numbers already.
FIELD_DDL = (
    "struct<field:string,value:string,value_num:double,confidence:double,"
    f"source_location:{LOCATION_DDL},status:string>"
)
QUEUE_ITEM_DDL = (
    "struct<doc_name:string,field_name:string,extracted_value:string,confidence:double,"
    f"source_location:{LOCATION_DDL},reason:string,resolved:boolean,corrected_value:string,"
    "resolved_by:string>"
)

LINE_ITEM_DDL = (
    "struct<description:string,hsn_sac:string,quantity:double,unit_price:double,line_total:double>"
)
TAX_DDL = "struct<cgst:double,sgst:double,igst:double,total_tax:double>"
META_DDL = (
    "struct<doc_file:string,doc_type:string,labeled_by:string,labeled_at:string,note:string>"
)
TRANSACTION_DDL = (
    "struct<date:string,narration:string,debit:double,credit:double,balance:double,ref_no:string>"
)

INVOICE_LABEL_DDL = (
    f"_meta {META_DDL}, invoice_number string, invoice_date string, due_date string, "
    "vendor_name string, vendor_gstin string, vendor_address string, buyer_name string, "
    f"buyer_gstin string, currency string, subtotal double, tax {TAX_DDL}, total_amount double, "
    f"line_items array<{LINE_ITEM_DDL}>"
)
STATEMENT_LABEL_DDL = (
    f"_meta {META_DDL}, account_holder_name string, account_number string, bank_name string, "
    "ifsc string, statement_period struct<start:string,end:string>, opening_balance double, "
    f"closing_balance double, currency string, transactions array<{TRANSACTION_DDL}>"
)

# Raw import shapes. Amounts of the invoice batch arrive as text.
RAW_INVOICE_DDL = (
    "invoice_no string, date_of_issue string, "
    "seller struct<name:string,gstin:string,address:string>, client struct<name:string>, "
    "items array<struct<description:string,quantity:string,net_price:string,net_worth:string>>, "
    "summary struct<net_worth:string,vat_amount:string,gross_worth:string,"
    "total_gross_worth:string>"
)
# A transaction is kept as a string map first: whether the key `cr_dr` EXISTS decides its shape.
RAW_STATEMENT_DDL = (
    "bank_name string, account_holder string, account_number string, ifsc_code string, "
    "currency string, opening_balance double, closing_balance double, start_date string, "
    "end_date string, transactions array<map<string,string>>"
)

EVENT_DDL = (
    "job_id string, event_type string, ord bigint, status string, doc_name string, "
    "doc_type string, queue_items int, error_message string, processing_time_s double, "
    "created_at timestamp"
)
