"""Cutting rows into ranges of ids, each of which a task walks through in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges per shuffle partition, and at most.
SPREAD, MOST_RANGES = 4, 2000


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id long) with _range, which rises with the id; null ids are in range 0.

    Bounds are quantiles of the ids, at most ``MOST_RANGES`` numbers that the driver gathers. Rows of one
    id stay in one range.
    """
    ranges = min(MOST_RANGES, SPREAD * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", steps, 10 * ranges)).first()[0] or []))
    number = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    return rows.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(number))
