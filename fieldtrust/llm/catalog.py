"""The subpackage's registered queries, each beside its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldtrust.llm import alignment, bpe, chat, hard_negatives, jaccard, lempel_ziv, mixing, pieces, token_index, topk, toxicity, url_filter, warc

_MODULES = (alignment, bpe, chat, hard_negatives, jaccard, lempel_ziv, mixing, pieces, token_index, topk, toxicity, url_filter, warc)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def llm_oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
