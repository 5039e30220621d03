"""Registered queries: operators over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldtrust.catalog import documents, imports, invoices, jobs, pages, retrieval, router, scalars

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (invoices, scalars, imports, jobs, retrieval, router, documents, pages)


def all_queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
