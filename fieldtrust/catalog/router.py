"""Document-type classifier over documents, with the language as the type to be told."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrust import carriers
from fieldtrust.carriers import table
from fieldtrust.catalog.scalars import error_log
from fieldtrust.catalog.sql import RECORDS, rendered_date
from fieldtrust.operators import ranking
from fieldtrust.operators import router as r
from fieldtrust.session import fresh_path, materialised


def _name():
    return F.concat(F.lit("d"), F.col("doc_id"))


def _training(spark, sf):
    docs = table(spark, sf, "documents")
    return r.training_set(
        docs.select(_name().alias("doc_name"), F.col("lang").alias("doc_type")),
        docs.select(_name().alias("doc_name"), "text"),
    )


def training_set(spark, sf):
    return _training(spark, sf).select("doc_name", F.md5("text").alias("digest"), "label")


def class_distribution(spark, sf):
    return r.class_distribution(_training(spark, sf))


def stratified_folds(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return ranking.stratified_folds(docs, "lang", "doc_id").select("doc_id", "lang", F.col("fold").cast("bigint").alias("fold"))


def _results(spark, sf):
    model = r.fit_router(_training(spark, sf))
    scored = model.predict(model.examples).withColumn("true_type", F.col("label"))
    return r.router_results(scored)


def router_predictions(spark, sf):
    return _results(spark, sf)


def router_accuracy(spark, sf):
    return r.router_accuracy(_results(spark, sf))


def router_cross_validation(spark, sf):
    return r.cv_summary(r.cross_validate(materialised(_training(spark, sf), "training")))


def router_saved(spark, sf):
    """Fit on invoices and statements, save, load, score."""
    training = materialised(_mixed(spark, sf).withColumnRenamed("true_type", "label"), "training")
    model = r.fit_router(training)
    path = fresh_path(spark, "model")
    model.save(path)
    scored = r.RouterModel.load(path).predict(training)
    return r.class_report(scored)


def router_record(spark, sf):
    model = r.fit_router(_training(spark, sf))
    return r.training_record(model.examples, model)


def _mixed(spark, sf):
    """Invoice and statement texts together, with their true types."""
    a = carriers.invoice_texts(spark, sf).select("doc_name", "text", F.lit("invoice").alias("true_type"))
    b = carriers.statement_texts(spark, sf).select("doc_name", "text", F.lit("bank_statement").alias("true_type"))
    return a.unionByName(b)


def keyword_routing(spark, sf):
    """Fallback classifier alone."""
    routed = r.route(_mixed(spark, sf))
    return r.router_results(routed).select(
        "doc_name", "true_type", "predicted_type", F.round("confidence", 6).alias("confidence"), "correct"
    )


def first_page_routing(spark, sf):
    """Conversations as documents of many pages, told by their first page."""
    pages = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("doc_name"), F.col("turn").alias("page"),
        F.concat(F.col("text"), F.when(F.col("conv_id") % 3 == 0, F.lit(" Account holder")).otherwise(F.lit(" invoice"))).alias("text"),
    )
    return r.route(r.first_pages(pages)).select("doc_name", "predicted_type", "confidence")


def keyword_routing_accuracy(spark, sf):
    return r.router_accuracy(r.router_results(r.route(_mixed(spark, sf))))


def two_tier_routing(spark, sf):
    """Trained model for documents with text, keywords on the page title for those without."""
    docs = _mixed(spark, sf)
    training = materialised(docs.withColumnRenamed("true_type", "label"), "training")
    model = r.fit_router(training)
    blanked = docs.withColumn("title", F.substring_index("text", "\n", 1)).withColumn(
        "text", F.when(F.crc32("doc_name") % 10 != 0, F.col("text")).otherwise(" ")
    )
    return r.router_accuracy(r.router_results(r.route(blanked, model, fallback_text="title")))


def class_report(spark, sf):
    """Report of the keyword classifier over all invoices and statements."""
    routed = r.route(_mixed(spark, sf))
    return r.class_report(routed, "true_type")


def misclassified_documents(spark, sf):
    """Keyword routing of the language documents, where every statement guess is wrong."""
    docs = table(spark, sf, "documents").select(
        _name().alias("doc_name"), F.concat(F.col("text"), F.when(F.col("doc_id") % 4 == 0, F.lit(" account holder")).otherwise("")).alias("text"),
        F.lit("invoice").alias("true_type"))
    return r.misclassified(r.router_results(r.route(docs))).select("doc_name", "predicted_type")


def skip_summary(spark, sf):
    return r.skip_summary(error_log(spark, sf))


def skipped_documents(spark, sf):
    return r.skipped_documents(error_log(spark, sf)).groupBy("error_class", "doc_name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        training_set, class_distribution, stratified_folds, router_predictions, router_accuracy,
        router_cross_validation, router_saved, router_record, keyword_routing, first_page_routing,
        keyword_routing_accuracy,
        two_tier_routing, class_report, misclassified_documents, skip_summary, skipped_documents,
    )
}

_BLANK = r"regexp_matches(text, '[^\s\p{Z}]')"
INVOICE_TEXT = f"""texts AS (SELECT k, doc_name, 'Invoice No: ' || invoice_number || chr(10) || 'Date: ' || {rendered_date('k', 'invoice_date::DATE')}
  || chr(10) || coalesce('Due: ' || due_date, '') || chr(10) || 'Seller: ' || vendor_name || chr(10) || CASE WHEN k % 29 <> 0 THEN 'GSTIN: ' || vendor_gstin ELSE '' END
  || chr(10) || 'Address: ' || vendor_address || chr(10) || 'Client: ' || buyer_name || chr(10) || 'Currency: ' || currency || chr(10)
  || 'Subtotal: INR ' || format('{{:,.2f}}', subtotal) || chr(10) || CASE WHEN k % 19 <> 0 THEN 'VAT: ' || format('{{:,.2f}}', tax) ELSE '' END
  || chr(10) || 'Total: ' || format('{{:,.2f}}', total_amount) AS text FROM records)"""
STATEMENT_TEXT = """accounts AS (SELECT *, lpad(c_custkey::VARCHAR, 12, '0') AS d FROM customer),
stmts AS (SELECT c_custkey AS k, 'bankstmt_' || c_custkey || '.pdf' AS doc_name, c_name, c_mktsegment, c_acctbal,
  CASE WHEN c_custkey % 2 = 0 THEN substr(d, 1, 4) || '-' || substr(d, 5, 4) || '-' || substr(d, 9, 4) ELSE d END AS account FROM accounts),
stmt_texts AS (SELECT k, doc_name, 'Account statement' || chr(10) || 'Account holder: ' || c_name || chr(10) || 'Account number: ' || account || chr(10)
  || 'Bank: Bank of ' || c_mktsegment || chr(10) || 'Currency: INR' || chr(10) || 'Closing balance: ' || format('{:,.2f}', c_acctbal) AS text FROM stmts)"""
_A = r"len(regexp_extract_all(text, '(?i)\b(?:invoice|bill to|subtotal|amount due|gstin)\b'))::DOUBLE"
_B = r"len(regexp_extract_all(text, '(?i)\b(?:statement|opening balance|closing balance|ifsc|account holder)\b'))::DOUBLE"
_ROUTED = f"""WITH {RECORDS}, {INVOICE_TEXT}, {STATEMENT_TEXT}, mixed AS (SELECT doc_name, text, 'invoice' AS true_type FROM texts
  UNION ALL SELECT doc_name, text, 'bank_statement' FROM stmt_texts),
counted AS (SELECT *, {_A} AS a, {_B} AS b FROM mixed),
routed AS (SELECT doc_name, true_type, CASE WHEN b > a THEN 'bank_statement' ELSE 'invoice' END AS predicted_type,
  coalesce(greatest(a, b) / nullif(a + b, 0), 0.5) AS confidence FROM counted)"""
_ERR = "CASE event_id % 6 WHEN 0 THEN 'tpm' WHEN 1 THEN 'tpd' ELSE 'other' END"

ORACLES = {
    "training_set": f"SELECT 'd' || doc_id AS doc_name, md5(text) AS digest, lang AS label FROM documents WHERE {_BLANK}",
    "class_distribution": f"SELECT lang AS label, count(*) AS n FROM documents WHERE {_BLANK} GROUP BY lang",
    "stratified_folds": """SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM documents""",
    "keyword_routing": f"{_ROUTED} SELECT doc_name, true_type, predicted_type, round(confidence, 6) AS confidence, true_type = predicted_type AS correct FROM routed",
    "first_page_routing": f"""WITH x AS (SELECT conv_id, text || CASE WHEN conv_id % 3 = 0 THEN ' Account holder' ELSE ' invoice' END AS text FROM conversations WHERE turn = 0),
        c AS (SELECT conv_id, {_A} AS a, {_B} AS b FROM x) SELECT 'c' || conv_id AS doc_name, CASE WHEN b > a THEN 'bank_statement' ELSE 'invoice' END AS predicted_type,
        coalesce(greatest(a, b) / nullif(a + b, 0), 0.5) AS confidence FROM c""",
    "keyword_routing_accuracy": f"""{_ROUTED} SELECT true_type, round(avg((true_type = predicted_type)::INT), 4) AS accuracy,
        count(*) FILTER (WHERE true_type = predicted_type) AS n_correct, count(*) AS n FROM routed GROUP BY GROUPING SETS ((true_type), ())""",
    # Invoices and statements share no vocabulary, so a fitted model makes no mistake on them.
    "router_saved": f"""{_ROUTED} SELECT true_type AS class, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, count(*) AS support FROM routed GROUP BY 1""",
    "two_tier_routing": f"""{_ROUTED} SELECT true_type, 1.0::DOUBLE AS accuracy, count(*) AS n_correct, count(*) AS n FROM routed GROUP BY GROUPING SETS ((true_type), ())""",
    "class_report": f"""{_ROUTED}, c AS (SELECT unnest(['invoice', 'bank_statement']) AS class), s AS (SELECT class, count(*) FILTER (WHERE true_type = class) AS support,
        count(*) FILTER (WHERE predicted_type = class) AS chosen, count(*) FILTER (WHERE predicted_type = class AND true_type = class) AS hit FROM routed, c GROUP BY class)
        SELECT class, round(coalesce(hit::DOUBLE / nullif(chosen, 0), 0), 4) AS precision, round(coalesce(hit::DOUBLE / nullif(support, 0), 0), 4) AS recall,
        round(2.0::DOUBLE * hit / (chosen + support), 4) AS f1, support FROM s""",
    "misclassified_documents": f"""WITH x AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' account holder' ELSE '' END AS text FROM documents),
        c AS (SELECT doc_id, {_A} AS a, {_B} AS b FROM x) SELECT 'd' || doc_id AS doc_name, 'bank_statement' AS predicted_type FROM c WHERE b > a""",
    "skip_summary": f"SELECT {_ERR} AS error_class, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "skipped_documents": f"SELECT {_ERR} AS error_class, 'doc_' || user_id || '.pdf' AS doc_name, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2",
}
