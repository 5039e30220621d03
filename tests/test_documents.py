import pandas as pd
from pyspark.sql import functions as F

from fieldtrust.functions import fields as fl
from fieldtrust.functions.parsing import fingerprint
from fieldtrust.operators import extract as x
from fieldtrust.operators import incremental as inc
from fieldtrust.operators.retrieval import letter_profile
from fieldtrust.plans import documents as plan
from fieldtrust.plans.evaluation import cache_rows, evaluate
from tests.test_trust import documents

TEXT = """Invoice No: 123
Date: 15/03/2024
Seller: Acme Corp
Address: 1 Main St, Mumbai
Subtotal: INR 1,000.50
Total: 1,180.59"""

STATEMENT = "Account statement\nAccount holder: Ann\nAccount number: 1234-5678-9012\nBank: B\nClosing balance: 2,000.00"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_name string, text string")


def fields_of(df):
    return {r["field"]: r for r in fl.fields_long(df).collect()}


def test_rules_and_verifier(spark):
    out = x.text_verifier(x.rule_extractor()(docs(spark, [("a", TEXT)])))
    got = fields_of(out)
    assert (got["invoice_number"]["value"], got["invoice_date"]["value"], got["subtotal"]["value_num"]) == ("123", "15/03/2024", 1000.5)
    assert got["vendor_name"]["confidence"] == x.EXACT and got["vendor_name"]["source_location"]["page"] == 0
    box = got["vendor_name"]["source_location"]["bbox"]
    assert box[0] == TEXT.index("Acme Corp") / len(TEXT) and 0 <= box[0] < box[2] <= 1
    # Nothing to confirm: low, and nowhere.
    assert got["due_date"]["confidence"] == x.ABSENT and got["due_date"]["source_location"] is None


def test_verifier_bands(spark):
    df = documents(spark, {"a": {
        "vendor_name": ("ACME  corp", 1.0), "vendor_address": ("1 Main Street, Mumbai", 1.0), "buyer_name": ("Zeta", 1.0), "invoice_number": ("--", 1.0),
    }}).withColumn("text", F.lit(TEXT))
    got = {k: (r["confidence"], r["source_location"] is not None) for k, r in fields_of(x.text_verifier(df)).items()}
    assert got == {
        "vendor_name": (x.REFORMATTED, True), "vendor_address": (x.PARTIAL, False), "buyer_name": (x.ABSENT, False), "invoice_number": (x.ABSENT, False),
    }


def test_verifier_knows_other_spellings(spark):
    df = documents(spark, {"a": {
        "invoice_date": ("2024-03-15", 1.0), "due_date": ("March 16, 2024", 1.0), "subtotal": ("1000.5", 1.0), "total_amount": ("1180.58", 1.0),
        "tax": ("n/a", 1.0),
    }}).withColumn("text", F.lit(TEXT))
    got = {k: r["confidence"] for k, r in fields_of(x.text_verifier(df)).items()}
    assert got == {
        "invoice_date": x.REFORMATTED, "due_date": x.ABSENT, "subtotal": x.REFORMATTED, "total_amount": x.ABSENT, "tax": x.ABSENT,
    }


def test_model_retries_then_error_row(spark):
    def call(text, hint):
        if text == "never":
            raise RuntimeError("quota")
        if text == "second" and "could not be used" not in (hint or ""):
            return {"subtotal": "abc"}
        return {"subtotal": 2, "invoice_number": text}

    out = x.model_extractor(call)(docs(spark, [("a", "first"), ("b", "second"), ("c", "never")]))
    rows = {r["doc_name"]: r for r in out.select("doc_name", "extract_error", fl.value_record(F.col("fields")).alias("r")).collect()}
    assert (rows["a"]["r"]["subtotal"], rows["b"]["r"]["invoice_number"]) == ("2", "second")
    assert rows["a"]["extract_error"] is None and rows["c"]["extract_error"] == "quota" and rows["c"]["r"]["subtotal"] is None


def test_second_pass_replaces_whole_documents(spark):
    def first(df):
        return df.withColumn("fields", F.array(
            fl.field_struct("vendor_name", F.lit("Acme")), fl.field_struct("currency", F.when(F.col("doc_name") == "sure", "INR").otherwise("???"))))

    def verify(df):
        return df.withColumn("fields", F.transform("fields", lambda f: fl.rebuilt(
            f, confidence=F.when(f["value"] == "???", 0.1).otherwise(0.9))))

    def second(df):
        return df.withColumn("fields", F.array(
            fl.field_struct("vendor_name", F.regexp_extract("instruction", r"Example 1 \((\w+)\)", 1)), fl.field_struct("currency", F.lit("EUR"))))

    past = spark.createDataFrame(
        [("p1", "invoice", "Acme", {"vendor_name": "Past"})], "id string, doc_type string, layout_text string, extracted_fields map<string,string>")
    run = lambda exemplars: {
        r["doc_name"]: (tuple(r["r"]), r["a"]) for r in plan.extract_invoices(
            docs(spark, [("sure", "x"), ("unsure", "y")]), first, verify, exemplars=exemplars, embed=letter_profile, second_extract=second,
        ).select("doc_name", fl.value_record(F.col("fields"), ["vendor_name", "currency"]).alias("r"), fl.abstained_fields(F.col("fields")).alias("a")).collect()}
    assert run(past) == {"sure": (("Acme", "INR"), []), "unsure": (("Past", "EUR"), [])}
    # No exemplars found, or none asked for: the first pass stands.
    kept = {"sure": (("Acme", "INR"), []), "unsure": (("Acme", None), ["currency"])}
    assert run(past.limit(0)) == kept and run(None) == kept


def test_unified_results_and_jobs(spark):
    out = plan.run_documents(docs(spark, [("a", TEXT), ("b", STATEMENT)]))
    rows = {r["doc_name"]: r for r in out.collect()}
    assert all(r["valid"] for r in rows.values())
    assert rows["a"]["doc_type"] == "invoice" and rows["b"]["statement"]["account_number"] == "XXXX-XXXX-9012"
    errors = spark.createDataFrame([("c", "e" * 600)], "doc_name string, error string")
    jobs = {r["doc_name"]: r for r in plan.job_results(out, errors=errors).collect()}
    assert jobs["b"]["queue"] == [] and len(jobs["a"]["queue"]) > 0 and jobs["c"]["status"] == "failed"
    events = {r["job_id"]: r["payload"] for r in plan.outcome_events(plan.job_results(out, errors=errors)).collect()}
    assert events["c"] == '{"error":"' + "e" * 600 + '"}'


def test_failed_calls_are_failed_jobs(spark):
    def call(text, hint):
        if "ACME" in text:
            raise RuntimeError("429 RESOURCE_EXHAUSTED PerDay")
        return {"invoice_number": "1"}

    invoices = [("a", "Invoice\nBill to: ACME"), ("b", "Invoice\nBill to: Beta"), ("s", STATEMENT)]
    out = plan.run_documents(docs(spark, invoices), extract=x.model_extractor(call))
    rows = {r["doc_name"]: r for r in out.collect()}
    assert all(r["valid"] for r in rows.values())
    assert (rows["a"]["invoice"], rows["a"]["error"]) == (None, "429 RESOURCE_EXHAUSTED PerDay") and rows["b"]["error"] is None
    jobs = {r["doc_name"]: r for r in plan.job_results(out).collect()}
    assert (jobs["a"]["status"], jobs["a"]["result"], jobs["a"]["queue"]) == ("failed", None, None)
    assert jobs["b"]["status"] == jobs["s"]["status"] == "done"


def test_retries_follow_the_kind_of_failure(spark):
    calls = []

    def batch(texts, hints):
        calls.append((list(texts), list(hints)))
        if len(calls) == 1:
            raise RuntimeError("503 UNAVAILABLE")
        return [{"invoice_number": 5} if t == "bad" and not h else {"invoice_number": t} for t, h in zip(texts, hints)]

    run = x.model_extractor(call_batch=batch)
    frames = list(_batches_of(run)(iter([pd.DataFrame({"text": ["bad", "good"]})])))
    assert [f["extract_error"].tolist() for f in frames] == [[None, None]]
    # A busy server is asked again as before; only the unusable reply is pointed out, and only to its own text.
    assert calls[1] == (["bad", "good"], [None, None])
    assert calls[2][0] == ["bad"] and "could not be used" in calls[2][1][0]


def _batches_of(extract):
    """The function an extractor gives to mapInPandas."""
    names = extract.__code__.co_freevars
    return extract.__closure__[names.index("batches")].cell_contents


def test_permanent_errors_are_not_retried(spark):
    asked = []

    def call(text, hint):
        asked.append(hint)
        raise RuntimeError("429 limit: 0")

    frame = next(_batches_of(x.model_extractor(call))(iter([pd.DataFrame({"text": ["a"]})])))
    assert frame["extract_error"].tolist() == ["429 limit: 0"] and asked == [None]


def test_model_extractor_for_statements(spark):
    def call(text, hint):
        return {"account_number": "1234-5678-9012", "closing_balance": "2,000.00", "bank_name": "B"}

    extract = x.model_extractor(call, fields=list(x.STATEMENT_RULES))
    out = plan.extract_statements(docs(spark, [("b", STATEMENT)]), extract=extract).first()
    assert (out["account_number"], out["closing_balance"], out["bank_name"]) == ("XXXX-XXXX-9012", 2000.0, "B")


def test_failed_second_pass_keeps_the_first(spark):
    def first(df):
        return df.withColumn("fields", F.array(fl.field_struct("vendor_name", F.lit("Acme"))))

    def doubt(df):
        return df.withColumn("fields", F.transform("fields", lambda f: fl.rebuilt(f, confidence=F.lit(0.1))))

    def call(text, hint):
        raise RuntimeError("503 UNAVAILABLE")

    past = spark.createDataFrame(
        [("p1", "invoice", "Acme", {"vendor_name": "Past"})], "id string, doc_type string, layout_text string, extracted_fields map<string,string>")
    row = plan.extract_invoices(
        docs(spark, [("a", "x")]), first, doubt, exemplars=past, embed=letter_profile, second_extract=x.model_extractor(call)
    ).select("extract_error", fl.raw_value(F.col("fields"), "vendor_name").alias("v")).first()
    assert tuple(row) == ("503 UNAVAILABLE", "Acme")


def test_repeated_cache_rows(spark):
    cache = spark.createDataFrame([("a", "f", 1, 1), ("a", "f", 2, 3), ("a", "f", 3, 2), ("b", "old", 4, 1)], "doc_name string, fingerprint string, fields int, written_at int")
    work = spark.createDataFrame([("a",), ("b",)], "doc_name string")
    assert [(r["doc_name"], r["fields"]) for r in inc.cached_results(work, cache, "f").collect()] == [("a", 2)]
    assert tuple(inc.cache_tally(work, cache, "f").first()) == (1, 1)


def test_statement_mask_opt_out(spark):
    out = plan.extract_statements(docs(spark, [("b", STATEMENT)]), mask_pii=False).first()
    assert out["account_number"] == "1234-5678-9012" and out["closing_balance"] == 2000.0


def test_incremental(spark):
    one = {"vendor_name": ("Acme", 0.9)}
    truth = documents(spark, {n: one for n in "abcd"})
    current, old = fingerprint("m", "2"), fingerprint("m", "1")
    cache = documents(spark, {"a": one, "b": {"vendor_name": ("old", 0.9)}}).withColumn(
        "fingerprint", F.when(F.col("doc_name") == "a", current).otherwise(old))
    asked = []

    def extract(todo):
        asked.extend(sorted(r["doc_name"] for r in todo.collect()))
        # One document fails and yields nothing.
        return truth.join(todo.select("doc_name"), "doc_name").filter("doc_name != 'd'")

    work = truth.select("doc_name")
    results, scored = evaluate(truth, work, cache, current, extract)
    assert asked == ["b", "c", "d"]
    assert {(r["doc_name"], r["cached"]) for r in results.collect()} == {("a", True), ("b", False), ("c", False)}
    assert {(r["doc_name"], r["correct"]) for r in scored.collect()} == {("a", True), ("b", True), ("c", True)}
    assert {r["doc_name"] for r in cache_rows(results, current).collect()} == {"b", "c"}
    assert tuple(inc.cache_tally(work, cache, current).first()) == (1, 3)
    gaps = {tuple(r) for r in inc.pairing_gaps(work, results).collect()}
    assert gaps == {("d", True, False)}


def test_model_verifier(spark):
    asked = []

    def call(text, fields, hint):
        asked.append(fields)
        if text == "down":
            raise RuntimeError("503")
        if text == "quota":
            raise RuntimeError("429 PerDay")
        if text == "odd" and hint is None:
            return {"vendor_name": {"confidence": 2}}
        if text == "never":
            return [1]
        return {"vendor_name": {"confidence": 1, "source_location": {"page": 1, "bbox": [0, 0, 1, 1]}}, "tax_total_tax": None}

    df = documents(spark, {t: {"vendor_name": ("Acme", 1.0), "tax": ("5", 1.0), "due_date": (None, 1.0)} for t in ("fine", "odd", "down", "quota", "never")})
    out = {r["doc_name"]: r for r in x.model_verifier(call)(df.withColumn("text", F.col("doc_name"))).collect()}

    def told(name):
        return {f["field"]: (f["confidence"], f["source_location"] and f["source_location"]["page"]) for f in out[name]["fields"] if f["field"] in ("vendor_name", "tax", "due_date")}

    sure, unsure = {"vendor_name": (1.0, 1), "tax": (0.5, None), "due_date": (0.5, None)}, {n: (0.5, None) for n in ("vendor_name", "tax", "due_date")}
    assert told("fine") == told("odd") == sure and told("down") == told("quota") == told("never") == unsure
    assert [out[t]["verify_error"] for t in ("fine", "odd", "down", "quota")] == [None, None, "503", "429 PerDay"]
    assert "expected a record" in out["never"]["verify_error"]


def test_steps_are_computed_once_below_the_long_form(spark):
    """What a generator takes in is put into a filter on its size too, unless it is staged."""
    from fieldtrust.functions.fields import fields_long
    from fieldtrust.operators.gate import review_queue

    docs = spark.createDataFrame([("a", "Invoice No: 7\nTotal: 1,250.00")], "doc_name string, text string")
    out = plan.extract_invoices(docs)
    for long in (fields_long(out, "doc_name"), review_queue(out)):
        steps = long._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert not [s for s in steps if s.strip(" :+-").startswith("Filter") and "lambda" in s]
    found = {r["field"]: (r["value"], r["confidence"]) for r in fields_long(out, "doc_name").collect()}
    assert found["invoice_number"] == ("7", 0.95) and found["total_amount"] == ("1,250.00", 0.95)


def test_incremental_queries_build_the_invoices_once(spark, monkeypatch):
    from fieldtrust import carriers
    from fieldtrust.catalog import documents as catalog

    ddl = """k long, doc_name string, invoice_number string, invoice_date string, due_date string, vendor_name string, vendor_gstin string,
        vendor_address string, buyer_name string, buyer_gstin string, currency string, subtotal double,
        tax struct<cgst:double,sgst:double,igst:double,total_tax:double>, total_amount double"""
    rows = [
        (k, f"invoice_{k}.pdf", f"INV-{k}", "2024-01-05", None, "Seller", "27G", "1 Street, X", "Buyer", None, "INR", 10.0, (None, None, None, 1.0), 11.0)
        for k in (1, 2, 3, 4, 10)
    ]
    calls = []

    def records(spark, sf):
        calls.append(sf)
        return spark.createDataFrame(rows, ddl)

    monkeypatch.setattr(carriers, "invoice_records", records)
    assert tuple(catalog.cache_round_trip(spark, "unused").first()) == (4, 1)
    progress = {x["doc_name"]: x["cached"] for x in catalog.incremental_progress(spark, "unused").collect()}
    assert progress == {"invoice_2.pdf": True, "invoice_3.pdf": False, "invoice_4.pdf": True, "invoice_10.pdf": False}
    assert catalog.incremental_evaluation(spark, "unused").first()["n_docs"] == 4
    assert len(calls) == 3
