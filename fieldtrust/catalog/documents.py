"""Texts to records: extraction, verification, second pass, unified results, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrust import carriers
from fieldtrust.carriers import table
from fieldtrust.catalog.router import INVOICE_TEXT, STATEMENT_TEXT
from fieldtrust.catalog.sql import FIELDS, PRED_LONG, RECORDS, SCORED, n1, n2, n3
from fieldtrust.functions import fields as fl
from fieldtrust.functions.parsing import fingerprint
from fieldtrust.operators import extract as x
from fieldtrust.operators import incremental as inc
from fieldtrust.operators import retrieval, trust
from fieldtrust.operators.exemplars import ExemplarIndex
from fieldtrust.operators.gate import apply_gate
from fieldtrust.operators.importers import draft_labels
from fieldtrust.operators.ranking import value_at_fraction
from fieldtrust.plans import documents as plan
from fieldtrust.plans.evaluation import cache_rows, evaluate

from fieldtrust.session import fresh_path, materialised
from fieldtrust.sources.readers import read_or_empty, scan_labels
from fieldtrust.sources.writers import append_cache

PAGE_RULES = {
    "title": r"(?is)<title>(.*?)</title>",
    "heading": r"(?is)<h1[^>]*>(.*?)</h1>",
    "lang": r'(?i)<html[^>]*\blang="([a-z]+)"',
}


def _texts(spark, sf):
    return carriers.invoice_texts(spark, sf)


def _verified(spark, sf):
    return x.text_verifier(x.rule_extractor()(_texts(spark, sf)))


def extract_fields(spark, sf):
    long = fl.fields_long(x.rule_extractor()(_texts(spark, sf)), "doc_name")
    return long.select("doc_name", "field", "value", "value_num")


def extract_pages(spark, sf):
    """Title, heading and language of raw pages by rule."""
    pages = table(spark, sf, "pages").withColumnRenamed("html", "text")
    return x.rule_record(pages, PAGE_RULES, [], keep=["page_id"])


def page_field_accuracy(spark, sf):
    """Extracted page fields against what page and address say elsewhere."""
    pages = table(spark, sf, "pages").withColumnRenamed("html", "text")
    found = x.rule_record(pages, PAGE_RULES, [], keep=["page_id", "url"])
    in_url = F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1), F.lit(""))
    noisy = F.when(F.col("page_id") % 9 == 0, F.concat(F.col("heading"), F.lit(" x"))).otherwise(
        F.concat(F.lit(" "), F.regexp_replace("heading", " ", " \n")))
    truth = F.array(fl.field_struct("title", F.col("title")), fl.field_struct("lang", in_url))
    pred = F.array(fl.field_struct("title", noisy), fl.field_struct("lang", F.col("lang")))
    scored = trust.score_documents(
        found.select("page_id", truth.alias("fields")), found.select("page_id", pred.alias("fields")),
        "page_id", ["title", "lang"],
    )
    return trust.corpus_metrics(trust.cells(scored))


def verify_fields(spark, sf):
    long = fl.fields_long(_verified(spark, sf), "doc_name")
    return long.select("doc_name", "field", "confidence", F.col("source_location").isNotNull().alias("located"))


def verify_locations(spark, sf):
    """Offsets of exact hits."""
    long = fl.fields_long(_verified(spark, sf), "doc_name").filter(F.col("confidence") == x.EXACT)
    return long.select("doc_name", "field", F.round(F.get("source_location.bbox", F.lit(0)), 6).alias("x0"))


def _decoys(spark, sf):
    """Orders' numbers and totals beside longer ones that hold them; only every third text has them on their own."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    total = F.format_number("o_totalprice", 2)
    own = k % 3 == 0
    text = F.concat(
        F.lit("Order no: INV-"), k, F.lit("5\nSee also XINV-"), k, F.lit(", 9"), F.when(F.length(total) > 6, F.lit("")).otherwise("9,"), F.replace(total, F.lit(","), F.lit("")),
        F.when(own, F.concat(F.lit("\n\fThis one: INV-"), k, F.lit(", of "), total)).otherwise(""),
    )
    fields = F.array(fl.field_struct("invoice_number", F.concat(F.lit("INV-"), k)), fl.field_struct("total_amount", total, F.col("o_totalprice")))
    return o.select(k.alias("k"), text.alias("text"), fields.alias("fields"))


def verify_decoys(spark, sf):
    """Values that stand in a text inside longer words and numbers only are not found as they are."""
    long = fl.fields_long(x.text_verifier(_decoys(spark, sf)), "k")
    return long.select("k", "field", "confidence", F.col("source_location.page").cast("bigint").alias("page"))


def model_extraction(spark, sf):
    """A plugged-in model: replies, retries after bad replies, and failures as rows."""
    def call(text, hint):
        number = text.split("\n")[0].removeprefix("Invoice No: ")
        if number.endswith("7"):
            raise RuntimeError("no reply")
        if number.endswith("3") and "could not be used" not in (hint or ""):
            return {"invoice_number": 5}
        return {"invoice_number": number, "subtotal": 1.5}

    out = x.model_extractor(call)(_texts(spark, sf).select("doc_name", "text"))
    long = fl.fields_long(out, "doc_name", "extract_error").filter(F.col("field").isin("invoice_number", "subtotal"))
    return long.select("doc_name", "field", "value", "value_num", "extract_error")


def model_verification(spark, sf):
    """A plugged-in verifier: answers, retries after bad replies, and failures that leave everything uncertain."""
    def call(text, asked, hint):
        number = text.split("\n")[0].removeprefix("Invoice No: ")
        if number.endswith("7"):
            raise RuntimeError("no reply")
        sure = "high" if number.endswith("3") and not hint else 0.9
        place = {"page": 0, "bbox": [0.0, 0.0, 1.0, 1.0]}
        return {name: None if name == "currency" else {"confidence": sure, "source_location": place} for name in asked}

    out = x.model_verifier(call)(x.rule_extractor()(_texts(spark, sf)))
    long = fl.fields_long(out, "doc_name", "verify_error")
    return long.select("doc_name", "field", "confidence", F.col("source_location").isNotNull().alias("located"), "verify_error")


def invoice_pipeline(spark, sf):
    """Extract, verify, gate."""
    out = plan.extract_invoices(_texts(spark, sf))
    return fl.fields_long(out, "doc_name").select("doc_name", "field", "value", "confidence", "status")


def _missed_texts(spark, sf):
    """Texts whose total is written in a way only the second look understands."""
    t = _texts(spark, sf)
    odd = F.col("k") % 50 == 1
    return t.withColumn(
        "text", F.when(odd, F.regexp_replace("text", r"Seller: ", "Seller: ACME ")).otherwise(F.col("text"))
    )


def _shaky_verifier(df):
    """Marks one field of a doubtful text down, as a model might."""
    out = x.text_verifier(df)
    doubt = F.col("text").contains("Seller: ACME") & (
        ~F.col("text").contains("\nhint") if "instruction" not in df.columns else F.lit(False)
    )
    return out.withColumn(
        "fields",
        F.transform(
            "fields",
            lambda f: fl.rebuilt(
                f, confidence=F.when(doubt & (f["field"] == "vendor_name"), F.lit(0.6)).otherwise(f["confidence"])
            ),
        ),
    )


def _past(spark, sf):
    return carriers.invoice_records(spark, sf).select(
        F.concat(F.lit("past_"), F.col("doc_name")).alias("id"), F.lit("invoice").alias("doc_type"),
        F.concat_ws("\n", "vendor_name", "vendor_address").alias("layout_text"),
        F.map_from_arrays(F.array(F.lit("vendor_name")), F.array("vendor_name")).alias("extracted_fields"),
    )


def two_pass_pipeline(spark, sf):
    """Documents that abstain are done again with similar past documents as instruction."""
    out = plan.extract_invoices(
        _missed_texts(spark, sf), verify=_shaky_verifier, exemplars=_past(spark, sf), embed=retrieval.letter_profile
    )
    return fl.fields_long(out, "doc_name").groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


def second_pass_off(spark, sf):
    """The same without retrieval: the doubtful field stays abstained."""
    out = plan.extract_invoices(_missed_texts(spark, sf), verify=_shaky_verifier)
    return fl.fields_long(out, "doc_name").groupBy("field", "status").agg(F.count(F.lit(1)).alias("n"))


def pipeline_exemplars(spark, sf):
    """Clean documents become exemplars of later runs, however often a run is repeated."""
    texts = _missed_texts(spark, sf)
    index = ExemplarIndex(spark, fresh_path(spark, "exemplars"), retrieval.letter_profile, cell_rows=256)
    half = F.col("k") % 2 == 0
    for run, part in (("r1", half), ("r2", ~half), ("r2", ~half)):
        plan.extract_invoices(texts.filter(part), verify=_shaky_verifier, embed=None, index=index, run_id=run)
    return index.rows().select("id", "doc_type", "layout_text", F.size("extracted_fields").cast("bigint").alias("n_fields"), F.col("cell").isNotNull().alias("in_cell"))


def draft_round_trip(spark, sf):
    """Drafts written as label files are read back as labels."""
    path = fresh_path(spark, "drafts")
    plan.invoice_drafts(_texts(spark, sf)).write.json(path)
    labels, skipped = scan_labels(spark, path, multi_line=False)
    return labels.select("doc_name", "invoice_number", "vendor_name", "subtotal", F.col("tax.total_tax").alias("total_tax"), "total_amount").unionByName(
        skipped.select(F.col("reason").alias("doc_name")), allowMissingColumns=True)


def statement_pipeline(spark, sf):
    return plan.extract_statements(carriers.statement_texts(spark, sf)).select(
        "doc_name", "account_holder_name", "account_number", "bank_name", "currency", "closing_balance"
    )


def _mixed(spark, sf):
    return carriers.invoice_texts(spark, sf).unionByName(carriers.statement_texts(spark, sf))


def unified_results(spark, sf):
    out = plan.run_documents(_mixed(spark, sf))
    return out.select(
        "doc_name", "doc_type", F.round("router_confidence", 6).alias("router_confidence"), "valid",
        fl.raw_value(F.col("invoice"), "invoice_number").alias("invoice_number"),
        F.col("statement.account_number").alias("account_number"),
    )


def job_outcomes(spark, sf):
    """Results and failures as job outcomes with their queues."""
    out = plan.run_documents(_mixed(spark, sf))
    errors = table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.concat(F.lit("event_"), F.col("event_id")).alias("doc_name"), F.repeat(F.lit("e"), 600).alias("error"))
    jobs = plan.job_results(out, errors=errors)
    return jobs.groupBy("status", "doc_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("queue")).alias("queue_items"),
        F.max(F.length("error_message")).cast("bigint").alias("error_length"),
    )


def outcome_events(spark, sf):
    out = plan.run_documents(_mixed(spark, sf))
    errors = table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.concat(F.lit("event_"), F.col("event_id")).alias("doc_name"), F.repeat(F.lit("e"), 600).alias("error"))
    events = plan.outcome_events(plan.job_results(out, errors=errors))
    return events.groupBy("event_type", "payload").agg(F.count(F.lit(1)).alias("n"))


def _quota_extractor():
    """A model whose calls fail for good on every seventh invoice number."""
    def call(text, hint):
        number = text.split("\n")[0].removeprefix("Invoice No: ")
        if int(number.removeprefix("INV-")) % 7 == 3:
            raise RuntimeError("429 RESOURCE_EXHAUSTED PerDay")
        return {"invoice_number": number}

    return x.model_extractor(call)


def failed_jobs(spark, sf):
    """Failed model calls are failed jobs with their error, no result and no queue."""
    jobs = plan.job_results(plan.run_documents(_mixed(spark, sf), extract=_quota_extractor()))
    return jobs.select(
        "doc_name", "status", "error_message", F.col("result").isNotNull().alias("has_result"), F.col("queue").isNotNull().alias("has_queue"))


def uncached_failures(spark, sf):
    """A run fills the cache, without the failures, which the next run has to do again."""
    path = fresh_path(spark, "cache")
    texts, extract = _texts(spark, sf).select("k", "doc_name", "text"), _quota_extractor()
    fields = extract(texts).schema["fields"].dataType.simpleString()
    ddl = f"doc_name string, fields {fields}, fingerprint string"
    results, scored = evaluate(carriers.invoice_truth(spark, sf), texts, read_or_empty(spark, path, ddl), CURRENT, extract)
    append_cache(cache_rows(results, CURRENT), path)
    tally = inc.cache_tally(texts, read_or_empty(spark, path, ddl), CURRENT)
    return tally.crossJoin(scored.agg(F.countDistinct("doc_name").alias("n_scored_docs")))


def second_pass_failure(spark, sf):
    """A second call that fails leaves the first values and marks the document."""
    def call(text, hint):
        raise RuntimeError("503 UNAVAILABLE")

    out = plan.extract_invoices(
        _missed_texts(spark, sf), verify=_shaky_verifier, exemplars=_past(spark, sf), embed=retrieval.letter_profile,
        second_extract=x.model_extractor(call, max_retries=2),
    )
    return out.select("doc_name", "extract_error", fl.raw_value(F.col("fields"), "invoice_number").alias("invoice_number"))


def cache_duplicates(spark, sf):
    """Rows that a retried write repeated: the latest counts, once."""
    rows = _cache(spark, sf).withColumn("written_at", F.lit(1))
    later = rows.withColumns({"written_at": F.lit(2), "fields": F.slice("fields", 1, 5)})
    cache = rows.unionByName(rows).unionByName(later)
    found = inc.cached_results(_work(spark, sf), cache, CURRENT)
    return found.select("doc_name", F.size("fields").cast("bigint").alias("n_fields")).crossJoin(
        inc.cache_tally(_work(spark, sf), cache, CURRENT))


def absent_values(spark, sf):
    """Accepted values that do not occur in the document's own text."""
    texts = _texts(spark, sf)
    predicted = carriers.invoice_predictions(spark, sf).withColumn("fields", apply_gate(F.col("fields"), 0.6))
    found = trust.ungrounded_in_text(texts.join(predicted.select("doc_name", "fields"), "doc_name"))
    return found.select("doc_name", F.array_join("absent_fields", ",").alias("absent"))


def _trace(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_name"), F.round(F.col("value") / 10, 3).alias("latency_s"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )


def document_costs(spark, sf):
    return trust.call_costs(_trace(spark, sf), 0.001).select(
        "doc_name", F.round("latency_s", 3).alias("latency_s"), F.round("cost", 4).alias("cost"), "n_calls")


def document_latency_p95(spark, sf):
    costs = trust.call_costs(_trace(spark, sf), 0.001).withColumn("latency_s", F.round("latency_s", 3))
    return value_at_fraction(costs, "latency_s", 0.95)


CURRENT = fingerprint("rules", "v0")


def _records(spark, sf):
    """The invoices as plain columns, written: truth, work list, cache and extraction are all made from them."""
    return materialised(carriers.invoice_records(spark, sf), "invoice-records", lean=True)


def _cache(spark, sf, records=None):
    """Half the invoices cached, some of those under an older version."""
    p = carriers.invoice_predictions(spark, sf, records).filter(F.col("k") % 2 == 0)
    version = F.when(F.col("k") % 10 == 0, F.lit(fingerprint("rules", "old"))).otherwise(F.lit(CURRENT))
    return p.select("doc_name", version.alias("fingerprint"), "fields")


def _work(spark, sf, records=None):
    return carriers.invoice_predictions(spark, sf, records).select("k", "doc_name")


def work_list(spark, sf):
    return inc.work_list(_work(spark, sf), _cache(spark, sf), CURRENT).select("doc_name")


def cached_results(spark, sf):
    return inc.cached_results(_work(spark, sf), _cache(spark, sf), CURRENT).select("doc_name", F.size("fields").cast("bigint").alias("n_fields"))


def cache_tally(spark, sf):
    return inc.cache_tally(_work(spark, sf), _cache(spark, sf), CURRENT)


def pairing_gaps(spark, sf):
    return inc.pairing_gaps(_work(spark, sf), _cache(spark, sf).filter(F.col("fingerprint") == CURRENT))


def _fresh(spark, sf, records):
    """Extraction of the work list: fails on some documents, which then are not scored."""
    def extract(todo):
        # Plain columns are shuffled, not fields.
        wanted = records.join(todo.select("doc_name"), "doc_name", "left_semi")
        return carriers.invoice_predictions(spark, sf, wanted.filter(F.col("k") % 33 != 1))

    return extract


def incremental_evaluation(spark, sf):
    records = _records(spark, sf)
    results, scored = evaluate(
        records, _work(spark, sf, records), _cache(spark, sf, records), CURRENT, _fresh(spark, sf, records),
    )
    return trust.corpus_summary(trust.cells(scored))


def incremental_progress(spark, sf):
    records = _records(spark, sf)
    results, scored = evaluate(
        records, _work(spark, sf, records), _cache(spark, sf, records), CURRENT, _fresh(spark, sf, records),
    )
    progress = trust.doc_progress(scored)
    return progress.join(results.select("doc_name", "cached"), "doc_name")


def cache_round_trip(spark, sf):
    """Empty cache, first run fills it, second run finds everything but the failures."""
    path = fresh_path(spark, "cache")
    records = _records(spark, sf)
    ddl = "doc_name string, fields " + carriers.invoice_predictions(spark, sf, records).schema["fields"].dataType.simpleString() + ", fingerprint string"
    work = _work(spark, sf, records)
    results, _ = evaluate(records, work, read_or_empty(spark, path, ddl), CURRENT, _fresh(spark, sf, records))
    append_cache(cache_rows(results, CURRENT), path)
    return inc.cache_tally(work, read_or_empty(spark, path, ddl), CURRENT)


def draft_label_records(spark, sf):
    out = plan.extract_invoices(_texts(spark, sf)).select("doc_name", fl.value_record(F.col("fields")).alias("r"))
    drafts = draft_labels(out.select("doc_name", "r.*"))
    return drafts.select(F.col("_meta.doc_file").alias("doc_file"), F.col("_meta.labeled_by").alias("labeled_by"),
                         "invoice_number", "vendor_name", "subtotal")


QUERIES = {
    f.__name__: f
    for f in (
        extract_fields, extract_pages, page_field_accuracy, verify_fields, verify_locations, verify_decoys, model_extraction, model_verification,
        invoice_pipeline, two_pass_pipeline, second_pass_off, pipeline_exemplars, draft_round_trip, statement_pipeline, unified_results, job_outcomes,
        outcome_events, failed_jobs, uncached_failures, second_pass_failure, cache_duplicates, absent_values, document_costs, document_latency_p95, work_list, cached_results,
        cache_tally, pairing_gaps, incremental_evaluation, incremental_progress, cache_round_trip,
        draft_label_records,
    )
}

_RULE_SQL = {
    "invoice_number": r"(?im)^\s*invoice (?:no|number)\s*[:.]\s*(\S[^\r\n]*)$",
    "invoice_date": r"(?im)^\s*(?:invoice )?date(?: of issue)?\s*:\s*(\S[^\r\n]*)$",
    "due_date": r"(?im)^\s*due(?: date)?\s*:\s*(\S[^\r\n]*)$",
    "vendor_name": r"(?im)^\s*(?:seller|vendor)\s*:\s*(\S[^\r\n]*)$",
    "vendor_gstin": r"(?im)^\s*(?:seller |vendor )?gstin\s*:\s*(\S[^\r\n]*)$",
    "vendor_address": r"(?im)^\s*address\s*:\s*(\S[^\r\n]*)$",
    "buyer_name": r"(?im)^\s*(?:client|buyer|bill to)\s*:\s*(\S[^\r\n]*)$",
    "buyer_gstin": r"(?im)^\s*(?:client|buyer) gstin\s*:\s*(\S[^\r\n]*)$",
    "currency": r"(?im)^\s*currency\s*:\s*(\S[^\r\n]*)$",
    "subtotal": r"(?im)^\s*(?:subtotal|net worth)\s*:\s*(\S[^\r\n]*)$",
    "total_amount": r"(?im)^\s*(?:total|gross worth)\s*:\s*(\S[^\r\n]*)$",
    "tax": r"(?im)^\s*(?:tax|vat)\s*:\s*(\S[^\r\n]*)$",
}
_EXTRACTED_ROWS = ", ".join(
    f"{{'i': {i}, 'field': '{f}', 'value': nullif(trim(regexp_extract(text, '{_RULE_SQL[f]}', 1)), '')}}"
    for i, f in enumerate(FIELDS)
)


def at_edges(text: str, value: str) -> str:
    """Whether the value stands in the text as words and numbers of its own."""
    left = rf"""CASE WHEN regexp_matches({value}, '^[0-9]') THEN '(^|^[.,]|[^\p{{L}}\p{{M}}\p{{N}}_.,]|[^0-9][.,])'
        WHEN regexp_matches({value}, '^[\p{{L}}\p{{M}}\p{{N}}_]') THEN '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' ELSE '' END"""
    right = rf"""CASE WHEN regexp_matches({value}, '[0-9]$') THEN '($|[.,]$|[^\p{{L}}\p{{M}}\p{{N}}_.,]|[.,][^0-9])'
        WHEN regexp_matches({value}, '[\p{{L}}\p{{M}}\p{{N}}_]$') THEN '($|[^\p{{L}}\p{{M}}\p{{N}}_])' ELSE '' END"""
    return f"regexp_matches({text}, ({left}) || regexp_escape({value}) || ({right}))"


def _verified_sql(texts: str) -> str:
    return f"""extracted AS (SELECT doc_name, text, k, unnest([{_EXTRACTED_ROWS}], recursive := true) FROM {texts}),
    words AS (SELECT *, ' ' || {n2('text')} || ' ' AS words, ' ' || {n2('value')} || ' ' AS bare FROM extracted),
    verified AS (SELECT *, CASE WHEN value IS NULL THEN 0.2::DOUBLE WHEN instr(text, value) > 0 THEN 0.95::DOUBLE
      WHEN trim(bare) <> '' AND instr(words, bare) > 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM words)"""


_EXTRACT = f"WITH {RECORDS}, {INVOICE_TEXT}, {_verified_sql('texts')}"
_NUMS = "field IN ('subtotal', 'total_amount', 'tax')"
_PAGE = r"""pg AS (SELECT page_id, url, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title,
    nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '') AS heading, nullif(trim(regexp_extract(html, '(?i)<html[^>]*\blang="([a-z]+)"', 1)), '') AS lang FROM pages)"""
_A = r"len(regexp_extract_all(text, '(?i)\b(?:invoice|bill to|subtotal|amount due|gstin)\b'))::DOUBLE"
_B = r"len(regexp_extract_all(text, '(?i)\b(?:statement|opening balance|closing balance|ifsc|account holder)\b'))::DOUBLE"
_MASKED = "regexp_replace(left(account, length(account) - 4), '[0-9]', 'X', 'g') || right(account, 4)"
_SECOND = f"""WITH {RECORDS}, {INVOICE_TEXT}, odd AS (SELECT k, doc_name, CASE WHEN k % 50 = 1 THEN replace(text, 'Seller: ', 'Seller: ACME ') ELSE text END AS text FROM texts),
    {_verified_sql('odd')}"""
_CACHED = "k % 2 = 0 AND k % 10 <> 0"
_DONE = f"({_CACHED} OR k % 33 <> 1)"
_QUEUE_SUM = "CASE WHEN value IS NULL OR confidence < 0.8::DOUBLE THEN 1 ELSE 0 END"

ORACLES = {
    "extract_fields": f"{_EXTRACT} SELECT doc_name, field, value, CASE WHEN {_NUMS} THEN {n3('value')} END AS value_num FROM extracted",
    "extract_pages": f"WITH {_PAGE} SELECT page_id, title, heading, lang FROM pg",
    "page_field_accuracy": f"""WITH {_PAGE}, s AS (SELECT 'title' AS field, CASE WHEN title IS NOT NULL THEN coalesce({n1('title')} =
        {n1("CASE WHEN page_id % 9 = 0 THEN heading || ' x' ELSE ' ' || replace(heading, ' ', ' ' || chr(10)) END")}, false) END AS correct FROM pg
        UNION ALL SELECT 'lang', CASE WHEN regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) <> '' THEN coalesce(regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) = lang, false) END FROM pg)
        SELECT field, round(avg(correct::INT), 4) AS accuracy, count(correct) AS n_scored FROM s GROUP BY GROUPING SETS ((field), ())""",
    "verify_fields": f"{_EXTRACT} SELECT doc_name, field, confidence, confidence >= 0.8::DOUBLE AS located FROM verified",
    "verify_locations": f"{_EXTRACT} SELECT doc_name, field, round((instr(text, value) - 1)::DOUBLE / length(text), 6) AS x0 FROM verified WHERE value IS NOT NULL",
    # A part of the number, the letters, is in every text; of the total nothing is.
    "verify_decoys": """SELECT o_orderkey AS k, field, CASE WHEN o_orderkey % 3 = 0 THEN 0.95::DOUBLE WHEN field = 'invoice_number' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS confidence,
        CASE WHEN o_orderkey % 3 = 0 THEN 1::BIGINT END AS page FROM orders, (SELECT unnest(['invoice_number', 'total_amount']) AS field)""",
    "model_extraction": f"""WITH {RECORDS}, f AS (SELECT unnest(['invoice_number', 'subtotal']) AS field)
        SELECT doc_name, field, CASE WHEN k % 10 = 7 THEN NULL WHEN field = 'subtotal' THEN '1.5' ELSE invoice_number END AS value,
        CASE WHEN k % 10 <> 7 AND field = 'subtotal' THEN 1.5::DOUBLE END AS value_num, CASE WHEN k % 10 = 7 THEN 'no reply' END AS extract_error FROM records, f""",
    "model_verification": f"""{_EXTRACT} SELECT doc_name, field, CASE WHEN k % 10 <> 7 AND value IS NOT NULL AND field <> 'currency' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
        k % 10 <> 7 AND value IS NOT NULL AND field <> 'currency' AS located, CASE WHEN k % 10 = 7 THEN 'no reply' END AS verify_error FROM extracted""",
    "invoice_pipeline": f"""{_EXTRACT} SELECT doc_name, field, value, confidence,
        CASE WHEN value IS NOT NULL AND confidence < 0.8::DOUBLE THEN 'abstained' ELSE 'extracted' END AS status FROM verified""",
    "two_pass_pipeline": f"{_SECOND} SELECT field, 'extracted' AS status, count(*) AS n FROM verified GROUP BY field",
    "second_pass_off": f"""{_SECOND} SELECT field, CASE WHEN field = 'vendor_name' AND k % 50 = 1 THEN 'abstained' ELSE 'extracted' END AS status,
        count(*) AS n FROM verified GROUP BY ALL""",
    "pipeline_exemplars": f"""WITH {RECORDS}, {INVOICE_TEXT} SELECT doc_name AS id, 'invoice' AS doc_type, vendor_name || chr(10) || vendor_address AS layout_text,
        (10 - (due_date IS NULL)::INT - (k % 29 = 0)::INT - (k % 19 = 0)::INT + 1)::BIGINT AS n_fields, true AS in_cell FROM records WHERE k % 50 <> 1""",
    "draft_round_trip": f"""{_EXTRACT} SELECT doc_name, max(value) FILTER (WHERE field = 'invoice_number') AS invoice_number, max(value) FILTER (WHERE field = 'vendor_name') AS vendor_name,
        max({n3('value')}) FILTER (WHERE field = 'subtotal') AS subtotal, max({n3('value')}) FILTER (WHERE field = 'tax') AS total_tax,
        max({n3('value')}) FILTER (WHERE field = 'total_amount') AS total_amount FROM verified GROUP BY doc_name""",
    "statement_pipeline": f"""WITH {STATEMENT_TEXT} SELECT doc_name, c_name AS account_holder_name, {_MASKED} AS account_number,
        'Bank of ' || c_mktsegment AS bank_name, 'INR' AS currency, round(c_acctbal, 2) AS closing_balance FROM stmts""",
    "unified_results": f"""WITH {RECORDS}, {INVOICE_TEXT}, {STATEMENT_TEXT} SELECT doc_name, 'invoice' AS doc_type, round({_A} / ({_A} + {_B}), 6) AS router_confidence, true AS valid,
        'INV-' || k AS invoice_number, NULL::VARCHAR AS account_number FROM texts
        UNION ALL SELECT doc_name, 'bank_statement', round({_B} / ({_A} + {_B}), 6), true, NULL, {_MASKED} FROM stmt_texts JOIN stmts USING (k, doc_name)""",
    "job_outcomes": f"""{_EXTRACT}, {STATEMENT_TEXT} SELECT 'done' AS status, 'invoice' AS doc_type, count(DISTINCT doc_name) AS n, sum({_QUEUE_SUM})::BIGINT AS queue_items, NULL::BIGINT AS error_length FROM verified
        UNION ALL SELECT 'done', 'bank_statement', count(*), 0, NULL FROM stmts UNION ALL SELECT 'failed', NULL, count(*), NULL, 600 FROM events WHERE event_type = 'error'""",
    "outcome_events": f"""{_EXTRACT}, {STATEMENT_TEXT}, q AS (SELECT doc_name, sum({_QUEUE_SUM})::BIGINT AS n FROM verified GROUP BY doc_name)
        SELECT 'extraction_done' AS event_type, '{{"doc_type":"invoice","queue_items":' || n || '}}' AS payload, count(*) AS n FROM q GROUP BY q.n
        UNION ALL SELECT 'extraction_done', '{{"doc_type":"bank_statement","queue_items":0}}', count(*) FROM stmts
        UNION ALL SELECT 'extraction_failed', '{{"error":"' || repeat('e', 600) || '"}}', count(*) FROM events WHERE event_type = 'error'""",
    "failed_jobs": f"""WITH {RECORDS}, {INVOICE_TEXT}, {STATEMENT_TEXT}, jobs AS (SELECT doc_name, k % 7 = 3 AS bad FROM texts UNION ALL SELECT doc_name, false FROM stmts)
        SELECT doc_name, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN bad THEN '429 RESOURCE_EXHAUSTED PerDay' END AS error_message,
        NOT bad AS has_result, NOT bad AS has_queue FROM jobs""",
    "uncached_failures": f"""WITH {RECORDS}, {INVOICE_TEXT} SELECT count(*) FILTER (WHERE k % 7 <> 3) AS n_cache_hits, count(*) FILTER (WHERE k % 7 = 3) AS n_fresh_calls,
        count(*) FILTER (WHERE k % 7 <> 3) AS n_scored_docs FROM texts""",
    "second_pass_failure": f"""WITH {RECORDS}, {INVOICE_TEXT} SELECT doc_name, CASE WHEN k % 50 = 1 THEN '503 UNAVAILABLE' END AS extract_error,
        'INV-' || k AS invoice_number FROM texts""",
    "cache_duplicates": f"""WITH {RECORDS} SELECT doc_name, 5::BIGINT AS n_fields, (SELECT count(*) FROM records WHERE {_CACHED}) AS n_cache_hits,
        (SELECT count(*) FROM records WHERE NOT ({_CACHED})) AS n_fresh_calls FROM records WHERE {_CACHED}""",
    "absent_values": f"""WITH {RECORDS}, {INVOICE_TEXT}, {PRED_LONG} SELECT pred.doc_name, coalesce(string_agg(field, ',' ORDER BY i) FILTER (WHERE value IS NOT NULL AND confidence >= 0.6::DOUBLE
        AND NOT {at_edges(n1('text'), n1('value'))}), '') AS absent FROM pred JOIN texts ON pred.doc_name = texts.doc_name GROUP BY pred.doc_name""",
    "document_costs": "SELECT user_id AS doc_name, round(sum(round(value / 10, 3)), 3) AS latency_s, round(sum((props->>'$.k')::BIGINT) * 0.001::DOUBLE, 4) AS cost, count(*) AS n_calls FROM events GROUP BY user_id",
    "document_latency_p95": """WITH c AS (SELECT user_id, round(sum(round(value / 10, 3)), 3) AS l FROM events GROUP BY user_id)
        SELECT l AS p95 FROM (SELECT l, row_number() OVER (ORDER BY l) AS rn, count(*) OVER () AS n FROM c) WHERE rn = floor(n * 0.95::DOUBLE)::BIGINT + 1""",
    "work_list": f"WITH {RECORDS} SELECT doc_name FROM records WHERE NOT ({_CACHED})",
    "cached_results": f"WITH {RECORDS} SELECT doc_name, 12::BIGINT AS n_fields FROM records WHERE {_CACHED}",
    "cache_tally": f"WITH {RECORDS} SELECT count(*) FILTER (WHERE {_CACHED}) AS n_cache_hits, count(*) FILTER (WHERE NOT ({_CACHED})) AS n_fresh_calls FROM records",
    "pairing_gaps": f"WITH {RECORDS} SELECT doc_name, true AS in_left, false AS in_right FROM records WHERE NOT ({_CACHED})",
    "incremental_evaluation": SCORED.replace("g.status <> 'abstained'", "true") + f""" SELECT round(avg(correct::INT), 4) AS macro_accuracy, count(DISTINCT doc_name) AS n_docs,
        count(correct) AS n_scored_pairs FROM scored WHERE {_DONE}""",
    "incremental_progress": SCORED.replace("g.status <> 'abstained'", "true") + f""" SELECT doc_name, count(*) FILTER (WHERE correct) AS n_matched, count(correct) AS n_scored,
        0::BIGINT AS n_abstained, bool_and({_CACHED}) AS cached FROM scored WHERE {_DONE} GROUP BY doc_name""",
    "cache_round_trip": f"WITH {RECORDS} SELECT count(*) FILTER (WHERE k % 33 <> 1) AS n_cache_hits, count(*) FILTER (WHERE k % 33 = 1) AS n_fresh_calls FROM records",
    "draft_label_records": f"""{_EXTRACT} SELECT doc_name AS doc_file, 'draft_from_extraction' AS labeled_by, max(value) FILTER (WHERE field = 'invoice_number') AS invoice_number,
        max(value) FILTER (WHERE field = 'vendor_name') AS vendor_name, max(value) FILTER (WHERE field = 'subtotal') AS subtotal FROM verified GROUP BY doc_name""",
}
