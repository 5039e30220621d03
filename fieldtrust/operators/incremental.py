"""Reprocessing of only what the current model and pipeline have not done yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_cache(cache: DataFrame, current: str | Column, doc: str = "doc_name") -> DataFrame:
    """One cache row per document under the current fingerprint.

    Appended caches repeat rows after a retried write. With a column ``written_at`` the latest
    counts, else any.
    """
    rows = cache.filter(F.col("fingerprint") == current)
    others = [c for c in cache.columns if c != doc]
    if "written_at" in others:
        latest = F.max_by(F.struct(*others), F.col("written_at"))
    else:
        latest = F.any_value(F.struct(*others))
    return rows.groupBy(doc).agg(latest.alias("_row")).select(doc, "_row.*")


def cached_results(
    work: DataFrame, cache: DataFrame, current: str | Column, doc: str = "doc_name"
) -> DataFrame:
    """Cache rows of wanted documents made under the current fingerprint, one per document."""
    return usable_cache(cache, current, doc).join(work.select(doc), doc, "left_semi")


def work_list(
    work: DataFrame, cache: DataFrame, current: str | Column, doc: str = "doc_name"
) -> DataFrame:
    """Documents without a usable cache row: never done, failed, or done under another version."""
    done = cache.filter(F.col("fingerprint") == current).select(doc)
    return work.join(done, doc, "left_anti")


def with_cache(
    work: DataFrame, cache: DataFrame, current: str | Column, doc: str = "doc_name"
) -> DataFrame:
    """``work`` with ``_cached`` (the cache row, NULL where there is none): hits and work list in one join."""
    rows = usable_cache(cache, current, doc)
    packed = rows.select(doc, F.struct(*[c for c in rows.columns if c != doc]).alias("_cached"))
    return work.join(packed, doc, "left")


def merge_results(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    return cached.unionByName(fresh, allowMissingColumns=True)


def cache_tally(
    work: DataFrame, cache: DataFrame, current: str | Column, doc: str = "doc_name"
) -> DataFrame:
    """Hits and fresh calls."""
    done = usable_cache(cache, current, doc).select(doc, F.lit(True).alias("_hit"))
    return work.join(done, doc, "left").agg(
        F.count_if(F.col("_hit")).alias("n_cache_hits"),
        F.count_if(F.col("_hit").isNull()).alias("n_fresh_calls"),
    )


def pairing_gaps(left: DataFrame, right: DataFrame, doc: str = "doc_name") -> DataFrame:
    """Documents present on one side only; metrics need this to be empty."""
    a = left.select(doc, F.lit(True).alias("in_left"))
    b = right.select(doc, F.lit(True).alias("in_right"))
    return a.join(b, doc, "full").filter(F.col("in_left").isNull() | F.col("in_right").isNull()).select(
        doc, F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"),
    )


def replace_documents(first: DataFrame, second: DataFrame, doc: str = "doc_name") -> DataFrame:
    """Documents of the second pass replace the first pass whole; the others stay."""
    return first.join(second.select(doc), doc, "left_anti").unionByName(second)
