from pyspark.sql import functions as F

from fieldtrust.functions import fields as fl
from fieldtrust.operators import gate
from tests.test_trust import documents


def test_gate_and_queue(spark):
    df = documents(spark, {"d": {
        "invoice_number": ("1", 0.8), "vendor_name": ("A", 0.79), "due_date": (None, 0.1), "currency": ("INR", 0.95),
    }})
    df = df.withColumn(
        "fields",
        F.transform("fields", lambda f: fl.rebuilt(
            f, source_location=F.when(f["field"] != "currency", f["source_location"]))),
    )
    gated = df.withColumn("fields", gate.apply_gate(F.col("fields")))
    status = {r["field"]: r["status"] for r in fl.fields_long(gated).collect()}
    # Equal to the threshold passes; a missing value is never abstained.
    assert status == {
        "invoice_number": "extracted", "vendor_name": "abstained", "due_date": "extracted", "currency": "extracted",
    }
    queue = {r["field_name"]: (r["reason"], r["extracted_value"]) for r in gate.review_queue(gated).collect()}
    assert queue == {
        "vendor_name": ("abstained", "A"), "due_date": ("low_confidence", None), "currency": ("no_source_location", "INR"),
    }
    row = gated.select(
        fl.abstained_fields(F.col("fields")).alias("a"), fl.ungrounded_fields(F.col("fields")).alias("u"),
        fl.value_record(F.col("fields"), ["vendor_name", "currency"]).alias("r"),
    ).first()
    assert row["a"] == ["vendor_name"] and row["u"] == ["currency"]
    assert tuple(row["r"]) == (None, "INR")
    assert fl.pivot_values(fl.fields_long(gated, "doc_name")).first()["currency"] == "INR"
    pairs = {r["field"]: r["extracted"] for r in fl.confidence_pairs(fl.fields_long(gated)).collect()}
    assert pairs == {"invoice_number": True, "vendor_name": None, "due_date": None, "currency": True}


def test_verification_defaults(spark):
    df = documents(spark, {"d": {"invoice_number": ("1", 1.0), "tax": ("2", 1.0), "currency": ("INR", 1.0)}})
    ddl = "struct<confidence:double,source_location:struct<page:int,bbox:array<double>>>"
    answers = F.map_from_arrays(
        F.array(F.lit("invoice_number"), F.lit("tax_total_tax")),
        F.array(F.lit(None).cast(ddl), F.struct(F.lit(0.95), fl.no_location()).cast(ddl)),
    )
    out = df.withColumn("fields", fl.apply_verification(F.col("fields"), answers))
    got = {r["field"]: r["confidence"] for r in fl.fields_long(out).collect()}
    assert got == {"invoice_number": 0.5, "tax": 0.95, "currency": 0.5}


def test_empty_input(spark):
    df = documents(spark, {"d": {"currency": ("INR", 1.0)}}).limit(0)
    assert gate.review_queue(df).collect() == []
    assert gate.checked(df).collect() == []


def test_violations(spark):
    df = documents(spark, {"d": {"currency": ("INR", 1.5), "vendor_name": ("A", 0.5)}})
    assert gate.checked(df).first()["violations"] == ["currency: confidence must lie in [0, 1]"]
