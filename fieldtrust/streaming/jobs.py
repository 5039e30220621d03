"""Structured Streaming over the audit log: current states, live statistics, append-only copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldtrust.operators.job_table import JobTable
from fieldtrust.operators.jobs import job_view


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files that keep arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def job_states(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Streaming twin of the batch job view: one state row per job, kept by partial aggregates.

    The log has no late-data rule: events may come in any order, and a job stays in state.
    """
    return job_view(events, columns)


def append_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append-only copy of the stream; ends when the present files are done."""
    return (
        events.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def publish_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the jobs that changed in each trigger, as whole state rows, to ``path/batch=<n>``.

    A trigger costs what changed, not all jobs. Rewriting a batch after a failure replaces the same
    folder; ``current_states`` reads the newest row per job.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        states.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """Newest published state per job."""
    published = spark.read.parquet(path)
    columns = [c for c in published.columns if c not in ("job_id", "batch")]
    newest = F.max_by(F.struct(*columns), "batch")
    return published.groupBy("job_id").agg(newest.alias("s")).select("job_id", "s.*")


def merge_states(states: DataFrame, table: JobTable, checkpoint: str) -> StreamingQuery:
    """Merge the jobs that changed in each trigger into a stored table, whose reading costs the same after any number of triggers.

    A trigger rewrites the buckets of the jobs it changed; one that is done again after a failure changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch)

    return (
        states.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def publish_stats(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Live counts and mean times by status, a few rows per trigger under ``path/batch=<n>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        live_stats(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        states.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def live_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("processing_time_s"), 2).alias("avg_processing_time_s"),
    )


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest published batch."""
    published = spark.read.parquet(path)
    newest = published.agg(F.max("batch").alias("b"))
    return published.filter(F.col("batch") == newest.scalar()).drop("batch")
