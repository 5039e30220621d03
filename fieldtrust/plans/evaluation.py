"""Incremental evaluation: extract what is not cached, score, summarise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.operators.incremental import merge_results, with_cache
from fieldtrust.operators.trust import (
    corpus_summary,
    metrics_of_cells,
    regression_gate,
    score_documents,
    written_cells,
)
from fieldtrust.session import materialised


def evaluate(
    truth: DataFrame, docs: DataFrame, cache: DataFrame, current: str | Column,
    extract: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """(results, scored): all extraction results under ``current`` and their scored long table.

    ``truth`` and the results are (doc_name, fields), the truth may be plain records as well; ``cache`` adds
    ``fingerprint``. A document whose extraction failed yields no result and is left out of the scores, not counted as a miss.
    """
    # Written at once: extraction is what the cache is there to spare, whoever reads the results.
    split = materialised(with_cache(docs, cache, current), "work", lean=True)
    hits = split.filter(F.col("_cached").isNotNull()).select(
        "doc_name", F.col("_cached.fields").alias("fields"), F.lit(True).alias("cached")
    )
    todo = split.filter(F.col("_cached").isNull()).select(*docs.columns)
    done = extract(todo)
    if "extract_error" in done.columns:
        done = done.filter(F.col("extract_error").isNull())
    fresh = materialised(done.select("doc_name", "fields", F.lit(False).alias("cached")), "fresh-results", lean=True)
    results = merge_results(hits, fresh)
    scored = score_documents(truth, results).filter(F.col("extracted_doc"))
    return results, scored


def cache_rows(results: DataFrame, current: str | Column) -> DataFrame:
    """Fresh results as rows to append to the cache."""
    tag = F.lit(current) if isinstance(current, str) else current
    return results.filter(~F.col("cached")).select("doc_name", tag.alias("fingerprint"), "fields")


def report(scored: DataFrame, target: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(metric rows, regression gate row). Scoring runs once, when this is called: both read what it wrote."""
    merged = written_cells(scored)
    return metrics_of_cells(merged, target), regression_gate(corpus_summary(merged))
