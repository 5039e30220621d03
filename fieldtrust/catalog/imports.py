"""Importers, label files and sinks. Files are written from the tables first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrust.carriers import account_number, table
from fieldtrust.operators import importers as imp
from fieldtrust.operators import router as r
from fieldtrust.schemas import INVOICE_LABEL_DDL, STATEMENT_LABEL_DDL
from fieldtrust.session import fresh_path
from fieldtrust.sources import readers, writers

#: Rows of a batch file, some 600 bytes each.
BATCH_ROWS = 200_000
#: Rows up to which a whole batch stays plain, to be opened by hand; larger ones are packed.
PLAIN_ROWS = 200_000


def _raw_invoices(spark, sf):
    """One raw invoice per order line, two items each; some rows broken by key."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    price = F.format_number("l_extendedprice", 2)
    item = lambda name, worth: F.struct(
        F.lit(name).alias("description"),
        F.when(k % 23 == 0, F.lit("many")).otherwise(F.format_number("l_quantity", 1)).alias("quantity"),
        worth.alias("net_price"), worth.alias("net_worth"),
    )
    body = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("invoice_no"),
        F.when(k % 19 == 0, F.lit("03/2021")).when(k % 29 == 0, F.lit("")).otherwise(
            F.date_format("l_shipdate", "d/M/yyyy")).alias("date_of_issue"),
        F.struct(F.concat(F.lit("Supplier "), F.col("l_suppkey")).alias("name"), F.lit("Line 1\nLine 2").alias("address")).alias("seller"),
        F.struct(F.concat(F.lit("Client \""), F.col("l_partkey"), F.lit("\"")).alias("name")).alias("client"),
        F.array(item("goods", price), item("freight", F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("12.50")))).alias("items"),
        F.struct(
            price.alias("net_worth"), F.lit("1,000.25").alias("vat_amount"), price.alias("gross_worth"),
            F.when(k % 2 == 0, F.concat(F.lit("EUR "), price)).otherwise(price).alias("total_gross_worth"),
        ).alias("summary"),
    )
    json = F.when(k % 17 == 0, F.lit("{broken")).otherwise(F.to_json(body))
    return li.select(
        F.concat(F.lit("inv_"), F.concat_ws("_", "l_orderkey", "l_linenumber"), F.lit(".pdf")).alias("filename"),
        json.alias("json_data"), F.lit("INVOICE\n\"copy\", page 1").alias("ocred_text"),
    )


def _invoice_labels(spark, sf):
    return imp.invoice_labels(readers.with_raw_invoice(_raw_invoices(spark, sf)))


def _label_view(df):
    return df.select(
        "filename", "invoice_number", "invoice_date", "vendor_name", "vendor_gstin", "vendor_address", "buyer_name",
        "currency", "subtotal", F.col("tax.total_tax").alias("total_tax"), "total_amount",
        F.size("line_items").cast("bigint").alias("n_items"),
        F.get("line_items", F.lit(0))["quantity"].alias("quantity"),
        F.get("line_items", F.lit(1))["line_total"].alias("freight"),
    )


def import_invoices(spark, sf):
    return _label_view(imp.good_rows(_invoice_labels(spark, sf)))


def import_invoice_failures(spark, sf):
    return imp.failed_rows(_invoice_labels(spark, sf))


def import_invoice_tally(spark, sf):
    """Labels written, failed and copied; the listing has one document per order, which not every line is."""
    listing = table(spark, sf, "orders").select(
        F.concat(F.lit("inv_"), F.concat_ws("_", "o_orderkey", F.col("o_custkey") % 7 + 1), F.lit(".pdf")).alias("doc_name")
    )
    return imp.import_tally(_invoice_labels(spark, sf), listing)


def invoice_batch_csv(spark, sf):
    """The same rows through a CSV with quoted JSON and multi-line text."""
    path = fresh_path(spark, "batch")
    raw = _raw_invoices(spark, sf)
    # A file with values of several lines is read by one task, so files have a bound of their own, and packing them splits
    # them no less. The count is read off the table's footers.
    codec = "gzip" if raw.count() > PLAIN_ROWS else "none"
    raw.write.option("maxRecordsPerFile", BATCH_ROWS).option("compression", codec).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return _label_view(imp.good_rows(imp.invoice_labels(readers.read_invoice_batch(spark, path))))


def _raw_statements(spark, sf):
    """One raw statement per order: odd keys in shape one, even keys with signed amounts."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    slashed = F.when(k % 46 == 0, F.lit("x/y/2020")).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    total = F.col("o_totalprice")
    head = [
        F.lit("Bank").alias("bank_name"), F.concat(F.lit("Holder "), F.col("o_custkey")).alias("account_holder"),
        account_number(F.col("o_custkey")).alias("account_number"), F.lit("IFSC0001").alias("ifsc_code"), F.lit("INR").alias("currency"),
        F.lit(0.0).alias("opening_balance"), total.alias("closing_balance"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end_date"),
    ]
    one = F.array(
        F.struct(day.alias("date"), F.lit("").alias("value_date"), F.lit("Order").alias("description"), F.lit("567302").alias("cheque_no"),
                 total.alias("debit"), F.lit(None).cast("double").alias("credit"), F.lit(1.5).alias("balance")),
        F.struct(day.alias("date"), F.lit("2024-01-31").alias("value_date"), F.lit("Payment").alias("description"), F.lit("-").alias("cheque_no"),
                 F.lit(None).cast("double").alias("debit"), total.alias("credit"), F.lit(2.5).alias("balance")),
    )
    signed = lambda kind, balance: F.struct(
        slashed.alias("date"), slashed.alias("value_date"), F.lit("IMPS").alias("description"), F.lit("-").alias("cheque_no"),
        F.lit(kind).alias("cr_dr"), total.alias("transaction_amount"), F.lit(balance).alias("available_balance"),
    )
    two = F.array(signed("DR", 3.5), signed("CR", 4.5))
    json = F.when(k % 51 == 0, F.lit("[")).when(k % 2 == 1, F.to_json(F.struct(*head, one.alias("transactions")))).otherwise(
        F.to_json(F.struct(*head, two.alias("transactions"))))
    subtype = F.when(k % 2 == 1, F.lit("Digital_Type1")).otherwise(F.lit("Digital_Type2"))
    doc = F.concat(F.lit("bankstmt_"), F.lower(subtype), F.lit("_"), k, F.lit(".pdf"))
    return o.select(doc.alias("doc_file"), subtype.alias("subtype"), json.alias("json_data"))


def statement_bad_amounts(spark, sf):
    """Amounts written as text: with separators they are read, others are an error of the statement."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    debit = F.when(k % 31 == 0, F.lit("n/a")).when(k % 5 == 0, F.format_number(total, 2)).otherwise(total.cast("string"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lines = F.array(F.struct(day.alias("date"), F.lit("Order").alias("description"), debit.alias("debit")))
    raw = table(spark, sf, "orders").select(
        F.concat(F.lit("s_"), k).alias("doc_file"), F.lit("Digital_Type1").alias("subtype"),
        F.to_json(F.struct(F.lit("Bank").alias("bank_name"), lines.alias("transactions"))).alias("json_data"))
    labels = imp.statement_labels(readers.with_raw_statement(raw))
    return labels.select("doc_file", "row_error", F.when(F.col("row_error").isNull(), F.get("transactions", F.lit(0))["debit"]).alias("debit"))


def _statement_labels(spark, sf):
    return imp.statement_labels(readers.with_raw_statement(_raw_statements(spark, sf)))


def import_statements(spark, sf):
    good = imp.good_rows(_statement_labels(spark, sf))
    return good.select(
        "doc_file", "account_holder_name", "account_number", "ifsc", F.col("statement_period.start").alias("start"),
        "closing_balance", F.inline("transactions"),
    ).drop("_meta")


def import_statement_failures(spark, sf):
    return imp.failed_rows(_statement_labels(spark, sf), "doc_file")


def import_statements_masked(spark, sf):
    path = fresh_path(spark, "statements")
    writers.write_statements(imp.good_rows(_statement_labels(spark, sf)), path)
    return spark.read.parquet(path).select("doc_file", "account_number", F.size("transactions").cast("bigint").alias("n_transactions"))


def statement_batch_files(spark, sf):
    """Statements as JSON files below one folder per subtype."""
    path = fresh_path(spark, "subtypes")
    raw = _raw_statements(spark, sf)
    # Several statements per file, one per line; the batch format proper has one per file.
    raw.select("subtype", F.col("json_data").alias("value")).write.partitionBy("subtype").option("compression", "none").text(path)
    files = spark.read.text(path).withColumnRenamed("value", "json_data")
    parsed = imp.statement_labels(
        readers.with_raw_statement(files).withColumn("doc_file", F.concat(F.lit("bankstmt_"), F.lower("subtype")))
    )
    return imp.good_rows(parsed).groupBy("doc_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("transactions")).alias("n_transactions"),
        F.round(F.max("closing_balance"), 2).alias("max_balance"),
    )


def label_files(spark, sf):
    """Labels written as JSON lines with some broken lines, scanned back, joined to a listing."""
    good = imp.good_rows(_invoice_labels(spark, sf)).drop("filename", "row_error")
    path = fresh_path(spark, "labels")
    line = F.when(F.col("invoice_number").endswith("-3"), F.lit("{\"_meta\": ")).otherwise(
        F.to_json(F.struct("*")))
    # Packed files are not split, so they have a bound.
    good.select(line.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", writers.PACKED_ROWS).text(path)
    labels, skipped = readers.scan_labels(spark, path, multi_line=False, glob="*.txt.gz")
    n_good = labels.groupBy(F.lit("label").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("subtotal").cast("decimal(12,2)")), 0).cast("double").alias("subtotal"))
    n_bad = skipped.groupBy(F.lit("skipped").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("subtotal"))
    return n_good.unionAll(n_bad)


def labels_without_document(spark, sf):
    """Labels for which there is no page: a warning row each."""
    labels = table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".pdf")).alias("doc_name"))
    listing = table(spark, sf, "pages").select(F.concat(F.lit("doc_"), F.col("page_id"), F.lit(".pdf")).alias("doc_name"))
    return readers.with_documents(labels, listing)[1]


def labels_with_document(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".pdf")).alias("doc_name"), "quality")
    listing = table(spark, sf, "pages").select(F.concat(F.lit("doc_"), F.col("page_id"), F.lit(".pdf")).alias("doc_name"))
    return readers.with_documents(labels, listing)[0]


def label_sink(spark, sf):
    """Both label kinds through the partitioned JSON sink."""
    path = fresh_path(spark, "label-sink")
    writers.write_labels(imp.good_rows(_invoice_labels(spark, sf)).drop("row_error", "filename"), path, compression="gzip")
    writers.write_labels(imp.good_rows(_statement_labels(spark, sf)).drop("row_error", "doc_file"), path, "append", "gzip")
    invoices = spark.read.schema(INVOICE_LABEL_DDL).json(f"{path}/doc_type=invoice")
    statements = spark.read.schema(STATEMENT_LABEL_DDL).json(f"{path}/doc_type=bank_statement")
    a = invoices.agg(F.lit("invoice").alias("doc_type"), F.count(F.lit(1)).alias("n"),
                     F.sum(F.size("line_items")).alias("n_parts"))
    b = statements.agg(F.lit("bank_statement").alias("doc_type"), F.count(F.lit(1)).alias("n"),
                       F.sum(F.size("transactions")).alias("n_parts"))
    return a.unionAll(b)


def document_intake(spark, sf):
    """Page addresses as a listing: allowed suffix, size, error text."""
    pages = table(spark, sf, "pages")
    suffix = F.get(F.array(*[F.lit(s) for s in (".pdf", ".PNG", ".jpeg", ".exe", "")]), (F.col("page_id") % 5).cast("int"))
    listing = pages.select(
        F.concat(F.lit("s3/docs/page_"), F.col("page_id"), suffix).alias("path"),
        F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html")).alias("length"),
    )
    return readers.intake(listing).select("doc_name", "suffix", "ok", "error")


def upload_intake(spark, sf):
    """Intake with the narrower list of formats the upload takes."""
    pages = table(spark, sf, "pages")
    suffix = F.when(F.col("page_id") % 2 == 0, F.lit(".tiff")).otherwise(F.lit(".pdf"))
    listing = pages.select(F.concat(F.lit("page_"), F.col("page_id"), suffix).alias("path"), F.length("html").alias("length"))
    return readers.intake(listing, readers.UPLOAD_SUFFIXES).groupBy("ok", "suffix").agg(F.count(F.lit(1)).alias("n"))


def training_csv(spark, sf):
    """Training set through its CSV file and back."""
    path = fresh_path(spark, "training")
    docs = table(spark, sf, "documents")
    training = r.training_set(
        docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_name"), F.col("lang").alias("doc_type")),
        docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_name"), "text"),
    )
    writers.write_training_csv(training, path)
    back = writers.read_training_csv(spark, path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n_chars"))


def metrics_sink(spark, sf):
    """Report sections written twice; the second run replaces its own section only."""
    path = fresh_path(spark, "report")
    e = table(spark, sf, "events")
    run = lambda v: e.groupBy(F.col("event_type").alias("section")).agg(
        F.lit("mean").alias("metric"), F.round(F.avg(F.col("value") * v), 4).alias("value"))
    writers.write_report(run(1.0), path)
    writers.write_report(run(2.0).filter(F.col("section") == "view"), path)
    return spark.read.parquet(path)


def call_trace_sink(spark, sf):
    """Model-call rows appended in two runs."""
    path = fresh_path(spark, "trace")
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.concat(F.lit("doc_"), F.col("user_id")).alias("doc_name"),
        F.lit("invoice").alias("doc_type"), F.lit("rules").alias("model"),
        (F.col("value") / F.lit(7.0)).alias("latency_s"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
    )
    writers.append_trace(e.filter("success"), path)
    writers.append_trace(e.filter("not success"), path)
    return spark.read.parquet(path).groupBy("name", "success").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_s"), 2).alias("latency_s"))


def exemplar_sink(spark, sf):
    """Vectors appended per document type and read back."""
    path = fresh_path(spark, "exemplars")
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc_type"), "embedding")
    writers.append_exemplars(e, path)
    return spark.read.parquet(path).select(
        "id", F.col("doc_type").cast("string").alias("doc_type"), F.size("embedding").cast("bigint").alias("width"))


def _upload_contents(spark, sf):
    """Documents as files of several kinds, some of them broken, by key."""
    d, key = table(spark, sf, "documents"), F.col("doc_id")
    pages = F.repeat(F.lit("<< /Type /Page /Parent 1 0 R >>\n"), (key % 3 + 1).cast("int"))
    body = F.concat(F.lit("%PDF-1.4\n<< /Type /Pages /Kids [] >>\n"), pages, F.coalesce("text", F.lit("")))
    end = F.lit("\n%%EOF\n")
    kind = key % 9
    text = (
        F.when(kind == 0, F.concat(body, end)).when(kind == 1, body).when(kind == 4, F.concat(F.lit("%PDF-1.4\n"), end)).when(kind == 5, F.concat(F.lit("text"), end))
        .when(kind == 6, F.concat(F.lit("notes"), end)).when(kind == 7, F.lit("")).when(kind == 8, F.concat(F.lit("%PDF-1.7\n<< /Type /Pages /Count 12 >>"), end))
    )
    content = F.when(kind.isin(2, 3), F.unhex(F.when(kind == 2, "89504E470D0A1A0A0000000D49484452").otherwise("FFD8FFE000104A464946"))).otherwise(F.encode(text, "UTF-8"))
    suffix = F.when(kind.isin(2, 3), ".png").when(kind == 5, ".txt").otherwise(".PDF")
    return d.select(key.alias("doc_id"), F.concat(F.lit("/in/d"), key, suffix).alias("path"), content.alias("content"))


def corrupt_documents(spark, sf):
    """What uploaded files are, how many pages they have and why some are not taken."""
    return readers.inspected(_upload_contents(spark, sf)).select("doc_id", "doc_name", "kind", F.col("n_pages").cast("bigint").alias("n_pages"), "ok", "error")


def ordered_report(spark, sf):
    """Events by falling confidence, written in order and read back with their positions."""
    path = fresh_path(spark, "report")
    events = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "user_id")
    writers.write_ordered(events, path, [F.col("k").desc(), F.col("event_id").asc()])
    return readers.read_ordered(spark, path)


QUERIES = {
    f.__name__: f
    for f in (
        import_invoices, import_invoice_failures, import_invoice_tally, invoice_batch_csv,
        import_statements, import_statement_failures, import_statements_masked, statement_batch_files, statement_bad_amounts,
        label_files, labels_without_document, labels_with_document, label_sink, document_intake,
        upload_intake, training_csv, metrics_sink, call_trace_sink, exemplar_sink, corrupt_documents, ordered_report,
    )
}

_NAME = "'inv_' || l_orderkey || '_' || l_linenumber || '.pdf'"
_ERROR = """CASE WHEN l_orderkey % 17 = 0 THEN 'invalid JSON' WHEN l_orderkey % 23 = 0 THEN 'bad item amount' END"""
_INVOICES = f"""SELECT {_NAME} AS filename, l_orderkey || '-' || l_linenumber AS invoice_number,
  CASE WHEN l_orderkey % 19 = 0 OR l_orderkey % 29 = 0 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS invoice_date,
  'Supplier ' || l_suppkey AS vendor_name, NULL::VARCHAR AS vendor_gstin, 'Line 1' || chr(10) || 'Line 2' AS vendor_address,
  'Client "' || l_partkey || '"' AS buyer_name, CASE WHEN l_orderkey % 2 = 0 THEN 'EUR' ELSE 'INR' END AS currency,
  l_extendedprice AS subtotal, 1000.25::DOUBLE AS total_tax, l_extendedprice AS total_amount, 2::BIGINT AS n_items, l_quantity AS quantity,
  CASE WHEN l_orderkey % 2 <> 0 THEN 12.5::DOUBLE END AS freight FROM lineitem WHERE {_ERROR} IS NULL"""
_STMT = """s AS (SELECT *, CASE WHEN o_orderkey % 51 = 0 THEN 'invalid JSON' WHEN o_orderkey % 46 = 0 THEN 'bad transaction date' END AS row_error,
  'bankstmt_digital_type' || CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 2 END || '_' || o_orderkey || '.pdf' AS doc_file, lpad(o_custkey::VARCHAR, 12, '0') AS d,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
st AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN substr(d, 1, 4) || '-' || substr(d, 5, 4) || '-' || substr(d, 9, 4) ELSE d END AS account_number FROM s)"""

ORACLES = {
    "corrupt_documents": """WITH d AS (SELECT doc_id, doc_id % 9 AS m, doc_id % 3 + 1 AS n FROM documents)
        SELECT doc_id, 'd' || doc_id || CASE WHEN m IN (2, 3) THEN '.png' WHEN m = 5 THEN '.txt' ELSE '.PDF' END AS doc_name,
        CASE WHEN m IN (0, 1, 4, 8) THEN 'pdf' WHEN m = 2 THEN 'png' WHEN m = 3 THEN 'jpeg' END AS kind,
        CASE WHEN m IN (0, 1) THEN n WHEN m IN (2, 3) THEN 1 WHEN m = 8 THEN 12 ELSE 0 END::BIGINT AS n_pages, m IN (0, 2, 8) AS ok,
        CASE m WHEN 1 THEN 'document breaks off' WHEN 3 THEN 'content is not what ''.png'' says' WHEN 4 THEN 'document has no pages'
        WHEN 5 THEN 'cannot read files of type ''.txt''' WHEN 6 THEN 'content is not what ''.pdf'' says' WHEN 7 THEN 'document has no pages' END AS error FROM d""",
    "ordered_report": """SELECT event_id, (props->>'$.k')::BIGINT AS k, user_id,
        row_number() OVER (ORDER BY (props->>'$.k')::BIGINT DESC, event_id) - 1 AS position FROM events""",
    "import_invoices": _INVOICES,
    "invoice_batch_csv": _INVOICES,
    "import_invoice_failures": f"SELECT {_NAME} AS filename, {_ERROR} AS row_error FROM lineitem WHERE {_ERROR} IS NOT NULL",
    "import_invoice_tally": f"""SELECT CASE WHEN {_ERROR} IS NULL THEN 'written' ELSE 'failed' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1
        UNION ALL SELECT 'copied', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1 WHERE {_ERROR} IS NULL""",
    "import_statements": f"""WITH {_STMT} SELECT doc_file, 'Holder ' || o_custkey AS account_holder_name, account_number, 'IFSC0001' AS ifsc, day AS start,
        o_totalprice AS closing_balance, CASE WHEN o_orderkey % 2 = 1 AND i = 2 THEN '2024-01-31' ELSE day END AS date,
        CASE WHEN o_orderkey % 2 = 0 THEN 'IMPS' WHEN i = 1 THEN 'Order' ELSE 'Payment' END AS narration,
        CASE WHEN i = 1 THEN o_totalprice END AS debit, CASE WHEN i = 2 THEN o_totalprice END AS credit,
        CASE WHEN o_orderkey % 2 = 1 THEN 0.5::DOUBLE + i ELSE 2.5::DOUBLE + i END AS balance,
        CASE WHEN o_orderkey % 2 = 1 AND i = 1 THEN '567302' END AS ref_no FROM st, (SELECT unnest([1, 2]) AS i) WHERE row_error IS NULL""",
    "import_statement_failures": f"WITH {_STMT} SELECT doc_file, row_error FROM st WHERE row_error IS NOT NULL",
    "import_statements_masked": f"""WITH {_STMT} SELECT doc_file, regexp_replace(left(account_number, length(account_number) - 4), '[0-9]', 'X', 'g')
        || right(account_number, 4) AS account_number, 2::BIGINT AS n_transactions FROM st WHERE row_error IS NULL""",
    "statement_batch_files": f"""WITH {_STMT} SELECT 'bankstmt_digital_type' || CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 2 END AS doc_file, count(*) AS n,
        2 * count(*) AS n_transactions, round(max(o_totalprice), 2) AS max_balance FROM st WHERE row_error IS NULL GROUP BY 1""",
    "statement_bad_amounts": """SELECT 's_' || o_orderkey AS doc_file, CASE WHEN o_orderkey % 31 = 0 THEN 'bad transaction amount' END AS row_error,
        CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END AS debit FROM orders""",
    "label_files": f"""SELECT 'label' AS kind, count(*) AS n, round(sum(l_extendedprice::DECIMAL(12,2)), 0)::DOUBLE AS subtotal FROM lineitem WHERE {_ERROR} IS NULL AND l_linenumber <> 3
        UNION ALL SELECT 'skipped', count(*), NULL FROM lineitem WHERE {_ERROR} IS NULL AND l_linenumber = 3""",
    "labels_without_document": "SELECT 'doc_' || doc_id || '.pdf' AS doc_name, 'document not found' AS reason FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)",
    "labels_with_document": "SELECT 'doc_' || doc_id || '.pdf' AS doc_name, quality FROM labels WHERE doc_id IN (SELECT page_id FROM pages)",
    "label_sink": f"""WITH {_STMT} SELECT 'invoice' AS doc_type, count(*) AS n, 2 * count(*) AS n_parts FROM lineitem WHERE {_ERROR} IS NULL
        UNION ALL SELECT 'bank_statement', count(*), 2 * count(*) FROM st WHERE row_error IS NULL""",
    "document_intake": """WITH l AS (SELECT page_id, ['.pdf', '.PNG', '.jpeg', '.exe', ''][(page_id % 5 + 1)::INTEGER] AS sx FROM pages),
        e AS (SELECT *, CASE WHEN sx IN ('.exe', '') THEN 'cannot read files of type ''' || sx || '''' WHEN page_id % 7 = 0 THEN 'document has no pages' END AS error FROM l)
        SELECT 'page_' || page_id || sx AS doc_name, lower(sx) AS suffix, error IS NULL AS ok, error FROM e""",
    "upload_intake": "SELECT page_id % 2 = 1 AND coalesce(length(html), 0) > 0 AS ok, CASE WHEN page_id % 2 = 0 THEN '.tiff' ELSE '.pdf' END AS suffix, count(*) AS n FROM pages GROUP BY ALL",
    "training_csv": r"SELECT lang AS label, count(*) AS n, sum(length(regexp_replace(text, '\s', '', 'g')))::BIGINT AS n_chars FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]') GROUP BY lang",
    "metrics_sink": "SELECT event_type AS section, 'mean' AS metric, round(avg(value * CASE WHEN event_type = 'view' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END), 4) AS value FROM events GROUP BY 1",
    "call_trace_sink": "SELECT event_type AS name, event_type <> 'error' AS success, count(*) AS n, round(sum(round(value / 7.0::DOUBLE, 3)), 2) AS latency_s FROM events GROUP BY ALL",
    "exemplar_sink": "SELECT vec_id AS id, label::VARCHAR AS doc_type, len(embedding) AS width FROM embeddings",
}
