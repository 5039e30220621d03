"""Sinks. All are distributed writes through Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.functions.masking import mask_account_number

#: Most rows of a packed file of labels.
PACKED_ROWS = 200_000


def write_labels(labels: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """Labels as JSON lines below one folder per document type.

    Plain files, to be corrected by hand, unless ``compression`` names a codec. A packed file is read by one task, so
    those have a bound.
    """
    kind = F.coalesce(F.col("_meta.doc_type"), F.lit("invoice"))
    out = labels.withColumn("doc_type", kind).write.mode(mode).partitionBy("doc_type")
    if compression is not None:
        out = out.option("compression", compression).option("maxRecordsPerFile", PACKED_ROWS)
    out.json(path)


def write_training_csv(training: DataFrame, path: str, mode: str = "overwrite") -> None:
    training.select("doc_name", "text", "label").write.mode(mode).option("header", True).option(
        "quote", '"'
    ).option("escape", '"').csv(path)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema("doc_name string, text string, label string")
        .option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def append_events(events: DataFrame, path: str) -> None:
    """Audit events, append only, one folder per day where they carry a time."""
    if "created_at" in events.columns:
        events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
    else:
        events.write.mode("append").parquet(path)


def append_exemplars(exemplars: DataFrame, path: str) -> None:
    exemplars.write.mode("append").partitionBy("doc_type").parquet(path)


def append_cache(rows: DataFrame, path: str) -> None:
    """Cache entries; partitioned by fingerprint, so a run reads only its own."""
    rows.write.mode("append").partitionBy("fingerprint").parquet(path)


def append_trace(trace: DataFrame, path: str) -> None:
    """One row per model call; latency kept to three decimals."""
    trace.withColumn("latency_s", F.round("latency_s", 3)).write.mode("append").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric rows; a re-run replaces the sections it contains and leaves the others."""
    (
        metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("section").parquet(path)
    )


def write_ordered(df: DataFrame, path: str, order: list[str | Column], partitions: int | None = None) -> None:
    """Rows as files that follow one another in the order of ``order``; a re-run replaces them.

    Rows are dealt by ranges of the order and sorted inside a range, so no task sorts all of them. ``files`` beside
    the rows says for each file how many rows stand before it, which gives every row its position without another
    sort (``read_ordered``). The order should have no ties; rows that tie are in any order, and in one file.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    written = spark.read.schema(df.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"))
    # A row per file from here on; a task numbers its files one by one.
    files = written.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    task = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    before = Window.orderBy(task, "file").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("first", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{path}/files")


def write_statements(statements: DataFrame, path: str, mask_pii: bool = True) -> None:
    out = statements
    if mask_pii:
        out = out.withColumn("account_number", mask_account_number(F.col("account_number")))
    out.write.mode("overwrite").parquet(path)
