"""Accuracy, trust metrics, gate and queue over invoices and over scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust import carriers
from fieldtrust.catalog.sql import EVENT_SCORES, GATED, PRED_LONG, RECORDS, SCORED
from fieldtrust.functions import fields as fl
from fieldtrust.operators import gate, trust
from fieldtrust.plans.evaluation import report
from fieldtrust.schemas import INVOICE_FIELDS, LOCATION_DDL, SCORED_FIELDS, TAX_TOTAL


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    p = carriers.invoice_predictions(spark, sf)
    return p.withColumn("fields", gate.apply_gate(F.col("fields")))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return trust.score_documents(carriers.invoice_truth(spark, sf), _gated(spark, sf))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return carriers.scored_events(spark, sf)


def _event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return trust.calibrated(trust.cells(_events(spark, sf)), None)


def corpus_accuracy(spark, sf):
    return trust.corpus_metrics(trust.cells(_scored(spark, sf)))


def corpus_headline(spark, sf):
    return trust.corpus_summary(trust.cells(_scored(spark, sf)))


def document_accuracy(spark, sf):
    return trust.accuracy_wide(_scored(spark, sf))


def scored_fields(spark, sf):
    return _scored(spark, sf).select("doc_name", "field", "correct", F.round("confidence", 4).alias("confidence"))


def field_join_scores(spark, sf):
    def tagged(df):
        name = F.when(F.col("field") == "tax", F.lit(TAX_TOTAL)).otherwise(F.col("field"))
        return fl.fields_long(df, "doc_name").withColumn("field", name)

    scored = trust.match_fields(
        tagged(carriers.invoice_truth(spark, sf)), tagged(_gated(spark, sf))
    )
    return scored.groupBy("field", "status").agg(
        F.count_if(F.col("correct")).alias("n_correct"), F.count("correct").alias("n_scored")
    )


def doc_progress(spark, sf):
    return trust.doc_progress(_scored(spark, sf))


def calibration_error(spark, sf):
    return trust.expected_calibration_error(trust.calibrated(trust.cells(_scored(spark, sf))))


def reliability_bins(spark, sf):
    return trust.reliability_table(trust.calibrated(trust.cells(_scored(spark, sf))))


def hallucination_rate(spark, sf):
    return trust.hallucination_rate(trust.cells(_scored(spark, sf)))


def hallucination_rate_accepted(spark, sf):
    return trust.hallucination_rate(trust.cells(_scored(spark, sf)), accepted_only=True)


def coverage_at_precision(spark, sf):
    return trust.coverage_at_precision(_event_pairs(spark, sf), 0.9)


def precision_curve(spark, sf):
    return trust.precision_curve(_event_pairs(spark, sf)).select(
        "confidence", "accepted", "accepted_ok"
    )


def event_calibration(spark, sf):
    return trust.reliability_table(_event_pairs(spark, sf))


def abstention_rate(spark, sf):
    return trust.abstention_rate(trust.cells(_scored(spark, sf))).select(
        F.round("abstention_rate", 6).alias("abstention_rate")
    )


def trust_report(spark, sf):
    metrics, _ = report(_scored(spark, sf), 0.7)
    return metrics.withColumn("value", F.round("value", 4))


def regression_gate(spark, sf):
    return report(_scored(spark, sf))[1]


def precision_recall(spark, sf):
    return trust.precision_recall(_scored(spark, sf))


def gate_status(spark, sf):
    return fl.fields_long(_gated(spark, sf), "doc_name").select("doc_name", "field", "status")


def abstained_fields(spark, sf):
    names = fl.abstained_fields(F.col("fields"))
    return _gated(spark, sf).select("doc_name", F.array_join(names, ",").alias("abstained"))


def ungrounded_fields(spark, sf):
    names = fl.ungrounded_fields(F.col("fields"))
    return _gated(spark, sf).select("doc_name", F.array_join(names, ",").alias("ungrounded"))


def review_queue(spark, sf):
    return gate.review_queue(_gated(spark, sf)).select(
        "doc_name", "field_name", "extracted_value", F.round("confidence", 4).alias("confidence"), "reason"
    )


def review_queue_by_reason(spark, sf):
    queue = gate.review_queue(_gated(spark, sf))
    return queue.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("field_name").alias("n_fields")
    )


def review_queue_no_location(spark, sf):
    queue = gate.review_queue(_gated(spark, sf))
    return gate.queue_by_reason(queue, "no_source_location").select("doc_name", "field_name")


def confidence_pairs(spark, sf):
    pairs = fl.confidence_pairs(fl.fields_long(_gated(spark, sf), "doc_name"), "doc_name")
    return pairs.groupBy("field", "extracted").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence")
    )


def value_records(spark, sf):
    record = fl.value_record(F.col("fields"))
    return _gated(spark, sf).select("doc_name", record.alias("r")).select(
        "doc_name", *[F.col(f"r.{n}").alias(n) for n in INVOICE_FIELDS]
    )


def value_pivot(spark, sf):
    return fl.pivot_values(fl.fields_long(_gated(spark, sf), "doc_name"))


def verification_defaults(spark, sf):
    """Verifier answers by key: some fields missing, some null."""
    p = carriers.invoice_predictions(spark, sf)
    null = F.lit(None).cast(f"struct<confidence:double,source_location:{LOCATION_DDL}>")
    k = F.col("k")

    def answer(confidence: float):
        return F.struct(
            F.lit(confidence).alias("confidence"), fl.no_location().alias("source_location")
        )

    verification = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("invoice_number", "tax_total_tax", "currency")]),
        F.array(F.when(k % 2 == 0, answer(0.95)).otherwise(null), answer(0.7), answer(0.9)),
    )
    out = p.withColumn("fields", fl.apply_verification(F.col("fields"), verification))
    return fl.fields_long(out).groupBy("field", F.col("confidence")).agg(F.count(F.lit(1)).alias("n"))


def verification_join(spark, sf):
    """Extracted fields and verifier rows as two long tables; some fields have no answer."""
    p = carriers.invoice_predictions(spark, sf)
    extracted = fl.fields_long(p, "k", "doc_name")
    name = F.when(F.col("field") == "tax", F.lit("tax_total_tax")).otherwise(F.col("field"))
    answers = fl.fields_long(p, "k", "doc_name").filter(
        ~((F.col("field") == "currency") & (F.col("k") % 3 == 0))
    ).select("doc_name", name.alias("field"), "confidence", "source_location")
    bare = extracted.select("k", "doc_name", "field", "value")
    return fl.join_verification(bare, answers).groupBy("field").agg(
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.count("source_location").alias("n_located"), F.count(F.lit(1)).alias("n"),
    )


def schema_violations(spark, sf):
    """Fields with confidences and boxes out of range by key."""
    p = carriers.invoice_predictions(spark, sf)
    k = F.col("k")

    def broken(f):
        return fl.rebuilt(
            f,
            confidence=F.when((k % 5 == 0) & (f["field"] == "currency"), F.lit(1.5)).otherwise(f["confidence"]),
            source_location=F.when(
                (k % 7 == 0) & (f["field"] == "subtotal"),
                F.struct(F.lit(-1).alias("page"), F.array(F.lit(0.5)).alias("bbox")),
            ).otherwise(f["source_location"]),
        )

    out = gate.checked(p.withColumn("fields", F.transform("fields", broken)))
    return out.select(F.explode("violations").alias("violation")).groupBy("violation").agg(
        F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        corpus_accuracy, corpus_headline, document_accuracy, scored_fields, field_join_scores,
        doc_progress, calibration_error, reliability_bins, hallucination_rate,
        hallucination_rate_accepted, coverage_at_precision, precision_curve, event_calibration,
        abstention_rate, trust_report, regression_gate, precision_recall, gate_status,
        abstained_fields, ungrounded_fields, review_queue, review_queue_by_reason,
        review_queue_no_location, confidence_pairs, value_records, value_pivot,
        verification_defaults, verification_join, schema_violations,
    )
}

_CAL = "correct IS NOT NULL AND field <> 'tax.total_tax'"
_BINS = f"""bins AS (
  SELECT least(floor(confidence * 10)::BIGINT, 9) AS bin, avg(correct::INT) AS acc, avg(confidence) AS conf, count(*) AS n
  FROM scored WHERE {{where}} GROUP BY 1)"""
_CURVE = """curve AS (
  SELECT a.confidence, sum(b.n)::BIGINT AS accepted, sum(b.ok)::BIGINT AS accepted_ok
  FROM (SELECT DISTINCT confidence FROM scored WHERE {where}) a
  JOIN (SELECT confidence, count(*) AS n, count(*) FILTER (WHERE correct) AS ok FROM scored WHERE {where} GROUP BY 1) b
    ON b.confidence >= a.confidence GROUP BY 1)"""
_REASON = """CASE WHEN status = 'abstained' THEN 'abstained' WHEN value IS NOT NULL AND NOT located THEN 'no_source_location'
  WHEN confidence < 0.8::DOUBLE THEN 'low_confidence' END"""
_QUEUE = f"WITH {RECORDS}, {GATED}, queue AS (SELECT *, {_REASON} AS reason FROM gated)"
_SCORED_COLS = ", ".join(
    f"bool_or(correct) FILTER (WHERE field = '{f}') AS {f.replace('.', '_')}" for f in SCORED_FIELDS
)
_PIVOT_COLS = ", ".join(
    f"max(value) FILTER (WHERE field = '{f}' AND status <> 'abstained') AS {f}" for f in INVOICE_FIELDS
)
_PR = """per AS (SELECT field, count(*) FILTER (WHERE correct) AS tp,
    count(*) FILTER (WHERE value IS NOT NULL AND status <> 'abstained' AND NOT coalesce(correct, false)) AS fp,
    count(*) FILTER (WHERE correct = false) AS fn FROM scored GROUP BY field),
  pr AS (SELECT field, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM per),
  f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""

ORACLES = {
    "corpus_accuracy": f"""{SCORED} SELECT field, round(avg(correct::INT), 4) AS accuracy, count(correct) AS n_scored
        FROM scored GROUP BY GROUPING SETS ((field), ()) HAVING count(correct) > 0 OR grouping(field) = 1""",
    "corpus_headline": f"""{SCORED} SELECT round(avg(correct::INT), 4) AS macro_accuracy,
        count(DISTINCT doc_name) AS n_docs, count(correct) AS n_scored_pairs FROM scored""",
    "document_accuracy": f"{SCORED} SELECT doc_name, {_SCORED_COLS} FROM scored GROUP BY doc_name",
    "scored_fields": f"{SCORED} SELECT doc_name, field, correct, round(confidence, 4) AS confidence FROM scored",
    "field_join_scores": f"""{SCORED} SELECT field, status, count(*) FILTER (WHERE correct) AS n_correct,
        count(correct) AS n_scored FROM scored GROUP BY ALL""",
    "doc_progress": f"""{SCORED} SELECT doc_name, count(*) FILTER (WHERE correct) AS n_matched, count(correct) AS n_scored,
        count(*) FILTER (WHERE status = 'abstained') AS n_abstained FROM scored GROUP BY doc_name""",
    "calibration_error": f"""{SCORED}, {_BINS.format(where=_CAL)}
        SELECT round(sum(abs(acc - conf) * n) / sum(n), 4) AS ece FROM bins""",
    "reliability_bins": f"""{SCORED}, {_BINS.format(where=_CAL)} SELECT round((bin + 0.5::DOUBLE) / 10, 3) AS bin_mid,
        round(acc, 4) AS accuracy, round(conf, 4) AS confidence, n FROM bins""",
    "hallucination_rate": f"""{SCORED} SELECT round(count(*) FILTER (WHERE value IS NOT NULL AND NOT located)::DOUBLE
        / count(value), 4) AS hallucination_rate FROM scored""",
    "hallucination_rate_accepted": f"""{SCORED} SELECT round(count(*) FILTER (WHERE value IS NOT NULL AND NOT located)::DOUBLE
        / count(value), 4) AS hallucination_rate FROM scored WHERE status <> 'abstained'""",
    "coverage_at_precision": f"""{EVENT_SCORES}, {_CURVE.format(where='correct IS NOT NULL')}
        SELECT round(max(accepted) FILTER (WHERE accepted_ok::DOUBLE / accepted >= 0.9::DOUBLE)::DOUBLE / max(accepted), 4) AS coverage FROM curve""",
    "precision_curve": f"""{EVENT_SCORES}, {_CURVE.format(where='correct IS NOT NULL')} SELECT * FROM curve""",
    "event_calibration": f"""{EVENT_SCORES}, {_BINS.format(where='correct IS NOT NULL')}
        SELECT round((bin + 0.5::DOUBLE) / 10, 3) AS bin_mid, round(acc, 4) AS accuracy, round(conf, 4) AS confidence, n FROM bins""",
    "abstention_rate": f"""{SCORED} SELECT round(count(*) FILTER (WHERE status = 'abstained')::DOUBLE
        / greatest(1, count(correct)), 6) AS abstention_rate FROM scored""",
    "trust_report": f"""{SCORED}, {_BINS.format(where=_CAL)}, {_CURVE.format(where=_CAL)},
        head AS (SELECT avg(correct::INT) AS acc, count(DISTINCT doc_name)::DOUBLE AS docs, count(correct)::DOUBLE AS pairs,
          count(*) FILTER (WHERE value IS NOT NULL AND NOT located)::DOUBLE / count(value) AS hall,
          count(*) FILTER (WHERE status = 'abstained')::DOUBLE / count(correct) AS abst FROM scored)
        SELECT 'trust' AS section, 'macro_accuracy' AS metric, round(acc, 4) AS value FROM head
        UNION ALL SELECT 'trust', 'n_docs', docs FROM head UNION ALL SELECT 'trust', 'n_scored_pairs', pairs FROM head
        UNION ALL SELECT 'trust', 'ece', round(sum(abs(acc - conf) * n) / sum(n), 4) FROM bins
        UNION ALL SELECT 'trust', 'hallucination_rate', round(hall, 4) FROM head
        UNION ALL SELECT 'trust', 'coverage', round(max(accepted) FILTER (WHERE accepted_ok::DOUBLE / accepted >= 0.7::DOUBLE)::DOUBLE / max(accepted), 4) FROM curve
        UNION ALL SELECT 'trust', 'abstention_rate', round(abst, 4) FROM head
        UNION ALL SELECT 'field_accuracy', field, round(avg(correct::INT), 4) FROM scored GROUP BY field""",
    "regression_gate": f"""{SCORED}, head AS (SELECT round(avg(correct::INT), 4) AS acc FROM scored)
        SELECT coalesce(acc >= 0.96::DOUBLE, false) AS passed, CASE WHEN acc IS NULL THEN 'REGRESSION GATE FAILED: no documents were successfully evaluated.'
          ELSE 'REGRESSION GATE ' || CASE WHEN acc < 0.96::DOUBLE THEN 'FAILED' ELSE 'PASSED' END || ': macro accuracy ' || format('{{:.1f}}', acc * 100)
          || CASE WHEN acc < 0.96::DOUBLE THEN '% < ' ELSE '% >= ' END || 'floor 96.0% (baseline 98.0% - tolerance 2.0%)' END AS message FROM head""",
    "precision_recall": f"""{SCORED}, {_PR} SELECT field, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall,
        round(avg(f1), 4) AS f1 FROM f GROUP BY GROUPING SETS ((field), ())""",
    "gate_status": f"WITH {RECORDS}, {GATED} SELECT doc_name, field, status FROM gated",
    "abstained_fields": f"""WITH {RECORDS}, {GATED} SELECT doc_name,
        coalesce(string_agg(field, ',' ORDER BY i) FILTER (WHERE status = 'abstained'), '') AS abstained FROM gated GROUP BY doc_name""",
    "ungrounded_fields": f"""WITH {RECORDS}, {GATED} SELECT doc_name,
        coalesce(string_agg(field, ',' ORDER BY i) FILTER (WHERE value IS NOT NULL AND NOT located), '') AS ungrounded FROM gated GROUP BY doc_name""",
    "review_queue": f"""{_QUEUE} SELECT doc_name, field AS field_name, value AS extracted_value, round(confidence, 4) AS confidence, reason
        FROM queue WHERE reason IS NOT NULL""",
    "review_queue_by_reason": f"""{_QUEUE} SELECT reason, count(*) AS n, count(DISTINCT field) AS n_fields FROM queue
        WHERE reason IS NOT NULL GROUP BY reason""",
    "review_queue_no_location": f"{_QUEUE} SELECT doc_name, field AS field_name FROM queue WHERE reason = 'no_source_location'",
    "confidence_pairs": f"""WITH {RECORDS}, {GATED} SELECT field, CASE WHEN value IS NOT NULL AND status <> 'abstained' THEN true END AS extracted,
        count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM gated GROUP BY ALL""",
    "value_records": f"WITH {RECORDS}, {GATED} SELECT doc_name, {_PIVOT_COLS} FROM gated GROUP BY doc_name",
    "value_pivot": f"WITH {RECORDS}, {GATED} SELECT doc_name, {_PIVOT_COLS} FROM gated GROUP BY doc_name",
    "verification_defaults": f"""WITH {RECORDS}, {PRED_LONG} SELECT field, CASE WHEN field = 'invoice_number' AND k % 2 = 0 THEN 0.95::DOUBLE
        WHEN field = 'tax' THEN 0.7::DOUBLE WHEN field = 'currency' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, count(*) AS n
        FROM pred GROUP BY ALL""",
    "verification_join": f"""WITH {RECORDS}, {PRED_LONG}, a AS (SELECT *, field = 'currency' AND k % 3 = 0 AS gone FROM pred)
        SELECT field, round(avg(CASE WHEN gone THEN 0.5::DOUBLE ELSE confidence END), 4) AS mean_confidence,
        count(*) FILTER (WHERE located AND NOT gone) AS n_located, count(*) AS n FROM a GROUP BY field""",
    "schema_violations": f"""WITH {RECORDS} SELECT 'currency: confidence must lie in [0, 1]' AS violation, count(*) AS n FROM records WHERE k % 5 = 0
        UNION ALL SELECT 'subtotal: page must be >= 0', count(*) FROM records WHERE k % 7 = 0
        UNION ALL SELECT 'subtotal: bbox must hold 4 numbers', count(*) FROM records WHERE k % 7 = 0""",
}
