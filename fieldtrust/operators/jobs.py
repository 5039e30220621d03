"""Job view, review queue and statistics over the append-only audit log.

There is no table to update in place: the log is the truth and the job table an aggregate of it.
Log rows have the columns of ``EVENT_DDL`` plus whatever a job carries; ``ord`` orders the events of
a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.operators.ranking import value_at_fraction
from fieldtrust.schemas import STATUS_OF_EVENT
from fieldtrust.session import materialised

JOB_COLUMNS = ["doc_type", "queue", "error_message", "processing_time_s"]


def status_of_event(event_type: Column) -> Column:
    """State a job enters with an event; NULL for events that leave it (a resolution)."""
    result = F.lit(None).cast("string")
    for event, status in STATUS_OF_EVENT.items():
        result = F.when(event_type == event, F.lit(status)).otherwise(result)
    return result


def latest(column: str, order: str = "ord") -> Column:
    """Last non-null value in event order (an aggregate, combined before the shuffle)."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def job_view(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Current state per created job: status always the latest, others the latest non-null.

    Events of a job that was never created are ignored.
    """
    names = [c for c in (JOB_COLUMNS if columns is None else columns) if c in log.columns]
    created = F.col("event_type") == "doc_received"
    return (
        log.withColumn("_status", status_of_event(F.col("event_type")))
        .groupBy("job_id")
        .agg(
            F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col("ord"))).alias("status"),
            F.min(F.when(created, F.col("ord"))).alias("created_ord"),
            F.max("ord").alias("updated_ord"),
            F.max_by("doc_name", F.when(created, F.col("ord"))).alias("doc_name"),
            *[latest(n).alias(n) for n in names],
        )
        .filter(F.col("created_ord").isNotNull())
    )


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def queue_listing(jobs: DataFrame, pending_only: bool = False) -> DataFrame:
    """Items of all done jobs, resolved ones too unless asked otherwise."""
    items = jobs.filter((F.col("status") == "done") & F.col("queue").isNotNull()).select(
        "job_id", F.col("doc_name").alias("job_doc_name"), F.inline("queue")
    )
    items = items.withColumn("doc_name", F.coalesce("doc_name", "job_doc_name")).drop("job_doc_name")
    return items.filter(~is_resolved()) if pending_only else items


def is_resolved() -> Column:
    return F.coalesce(F.col("resolved"), F.lit(False))


def resolve_items(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Apply corrections (job_id, field_name, ord, corrected_value, resolved_by) to queue rows.

    Every item with the field is marked; the latest resolution of a field wins; an unnamed
    reviewer is ``human``.
    """
    last = resolutions.groupBy("job_id", "field_name").agg(
        F.max_by(F.struct("corrected_value", "resolved_by"), "ord").alias("_r")
    )
    kept = [c for c in items.columns if c not in ("resolved", "corrected_value", "resolved_by")]
    hit = F.col("_r").isNotNull()
    return items.join(last, ["job_id", "field_name"], "left").select(
        *kept,
        (hit | is_resolved()).alias("resolved"),
        F.when(hit, F.col("_r.corrected_value")).otherwise(F.col("corrected_value")).alias("corrected_value"),
        F.when(hit, F.coalesce(F.col("_r.resolved_by"), F.lit("human")))
        .otherwise(F.col("resolved_by")).alias("resolved_by"),
    )


def resolve_in_queue(
    queue: Column, field_name: Column, corrected_value: Column, resolved_by: Column
) -> Column:
    """The same on one job's queue array."""
    return F.transform(
        queue,
        lambda i: F.when(
            i["field_name"] == field_name,
            i.withField("resolved", F.lit(True))
            .withField("corrected_value", corrected_value)
            .withField("resolved_by", F.coalesce(resolved_by, F.lit("human"))),
        ).otherwise(i),
    )


def resolution_events(resolutions: DataFrame) -> DataFrame:
    """One audit event per resolution."""
    return resolutions.select(
        "job_id", F.lit("field_resolved").alias("event_type"), "ord",
        F.to_json(F.struct("field_name", "resolved_by")).alias("payload"),
    )


def pending_split(items: DataFrame) -> DataFrame:
    return items.groupBy(is_resolved().alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


def breakdown(jobs: DataFrame, key: str) -> DataFrame:
    """Count and share of the total per key; keys that are missing or empty are left out."""
    counts = jobs.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n")
    )
    return with_share(materialised(counts, "breakdown"))


def with_share(counts: DataFrame) -> DataFrame:
    """Add each row's share of the sum of ``n``; a zero total gives no rows."""
    total = counts.agg(F.sum("n").alias("_total"))
    return (
        counts.withColumn("_total", total.scalar())
        .filter(F.col("_total") > 0)
        .withColumn("share", F.col("n") / F.col("_total"))
        .drop("_total")
    )


def job_stats(jobs: DataFrame) -> DataFrame:
    """Statistics as rows (metric, key, value).

    The job view is computed once, merged to one row per (status, type, time) with counts, and
    written; all statistics read that.
    """
    open_items = F.size(F.filter("queue", lambda i: ~F.coalesce(i["resolved"], F.lit(False))))
    merged = materialised(
        jobs.groupBy("status", "doc_type", "processing_time_s").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("queue").isNotNull(), open_items).otherwise(0)).alias("n_open"),
        ),
        "job-stats",
    )

    def rows(df: DataFrame, metric: str, key: Column | None = None) -> DataFrame:
        shown = F.lit(None).cast("string") if key is None else key
        return df.select(
            F.lit(metric).alias("metric"), shown.alias("key"), F.col("value").cast("double").alias("value")
        )

    n = F.sum("n").alias("value")
    timed = merged.filter(F.col("processing_time_s").isNotNull())
    total_time = F.sum(F.col("processing_time_s") * F.col("n"))
    p95 = value_at_fraction(timed, "processing_time_s", 0.95, weight="n")
    return (
        rows(merged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")), "total_jobs")
        .unionAll(rows(merged.groupBy("status").agg(n), "by_status", F.col("status")))
        .unionAll(
            rows(
                merged.filter(F.coalesce(F.col("doc_type"), F.lit("")) != "").groupBy("doc_type").agg(n),
                "by_doc_type", F.col("doc_type"),
            )
        )
        .unionAll(
            rows(
                timed.agg(F.round(F.try_divide(total_time, F.sum("n")), 2).alias("value")),
                "avg_processing_time_s",
            )
        )
        .unionAll(rows(p95.select(F.round("p95", 2).alias("value")), "p95_processing_time_s"))
        .unionAll(
            rows(merged.agg(F.coalesce(F.sum("n_open"), F.lit(0)).alias("value")), "pending_review_items")
        )
    )
