"""Expensive intermediate columns that must be computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, never inlined where it is used.

    The optimizer substitutes a projected column into filters above it (and struct members into
    their users), which multiplies parsing and regex work. It does not do so through the generator
    this one-element array passes.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
