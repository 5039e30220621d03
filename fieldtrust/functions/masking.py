"""Masking of account numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_account_number(c: Column, visible_digits: int = 4) -> Column:
    """X for every digit but the last ``visible_digits``; other characters stay in place."""
    if visible_digits <= 0:
        return F.regexp_replace(c, r"\p{Nd}", "X")
    return F.regexp_replace(c, rf"\p{{Nd}}(?=(?:\P{{Nd}}*\p{{Nd}}){{{visible_digits}}})", "X")


def mask_statements(df: DataFrame, mask_pii: bool = True, column: str = "account_number") -> DataFrame:
    """Statements with the account number masked; with ``mask_pii=False`` unchanged."""
    return df.withColumn(column, mask_account_number(F.col(column))) if mask_pii else df
