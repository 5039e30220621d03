"""Confidence gate and review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.fields import has_value, is_ungrounded_value, rebuilt
from fieldtrust.functions.staging import computed_once
from fieldtrust.schemas import DEFAULT_THRESHOLD, QUEUE_ITEM_DDL


def gated_status(f: Column | dict[str, Column], threshold: float | Column) -> Column:
    """Abstain a value below the threshold; equal confidence passes, a missing value stays."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    below = has_value(f) & (f["confidence"] < limit)
    return F.when(below, F.lit("abstained")).otherwise(f["status"])


def apply_gate(fields: Column, threshold: float | Column = DEFAULT_THRESHOLD) -> Column:
    """Gate over a document's ``fields`` array; value, confidence and location are kept."""
    return F.transform(fields, lambda f: rebuilt(f, status=gated_status(f, threshold)))


def review_reason(
    f: Column | dict[str, Column], threshold: float | Column = DEFAULT_THRESHOLD
) -> Column:
    """First reason that holds: abstained, value without location, low confidence; else NULL."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    return (
        F.when(f["status"] == "abstained", F.lit("abstained"))
        .when(is_ungrounded_value(f), F.lit("no_source_location"))
        .when((f["confidence"] < limit) & (f["status"] == "extracted"), F.lit("low_confidence"))
    )


def review_items(
    doc_name: Column, fields: Column, threshold: float | Column = DEFAULT_THRESHOLD
) -> Column:
    """Queue of one document as an array (at most one item per declared field)."""
    items = F.transform(
        fields,
        lambda f: F.struct(
            doc_name.alias("doc_name"),
            f["field"].alias("field_name"),
            f["value"].alias("extracted_value"),
            f["confidence"].alias("confidence"),
            f["source_location"].alias("source_location"),
            review_reason(f, threshold).alias("reason"),
            F.lit(False).alias("resolved"),
            F.lit(None).cast("string").alias("corrected_value"),
            F.lit(None).cast("string").alias("resolved_by"),
        ),
    )
    return F.filter(items, lambda i: i["reason"].isNotNull()).cast(f"array<{QUEUE_ITEM_DDL}>")


def review_queue(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, doc: str = "doc_name"
) -> DataFrame:
    """All items of a table of documents, one row each."""
    # Staged, since a generator's input is put into a filter on its size as well.
    return computed_once(df, "_items", review_items(F.col(doc), F.col("fields"), threshold)).select(F.inline("_items"))


def queue_by_reason(queue: DataFrame, reason: str) -> DataFrame:
    return queue.filter(F.col("reason") == reason)


def violations(f: Column) -> Column:
    """Error texts for members outside their declared range, as one array."""
    loc, conf = f["source_location"], f["confidence"]
    bbox = loc["bbox"]
    checks = [
        (~conf.between(0.0, 1.0), "confidence must lie in [0, 1]"),
        (loc["page"] < 0, "page must be >= 0"),
        (loc.isNotNull() & (F.coalesce(F.size(bbox), F.lit(0)) != 4), "bbox must hold 4 numbers"),
        (F.exists(bbox, lambda x: ~x.between(0.0, 1.0)), "bbox must lie in [0, 1]"),
        (~f["status"].isin("extracted", "abstained"), "status must be extracted or abstained"),
    ]
    texts = F.array(
        *[F.when(bad, F.concat(f["field"], F.lit(": " + text))) for bad, text in checks]
    )
    return F.filter(texts, lambda t: t.isNotNull())


def checked(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Documents with a ``violations`` array; empty means valid."""
    return df.withColumn(
        "violations", F.flatten(F.transform(F.col(fields), lambda f: violations(f)))
    )
