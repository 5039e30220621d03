"""What the operators share: the given tables, null-safe texts, even spreading of rows."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.session import fresh_path, materialised

__all__ = ["fresh_path", "materialised", "sample_by_hash", "slices", "slices_by_bytes", "table", "whole_text", "tokenizer_path"]

#: Rows that a task turns into Python objects at a time.
SLICE = 256
#: Bytes of text that a task cuts into words at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; each operator takes the path as a parameter."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time, so that long texts do not pile up in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices whose texts in ``column`` take less than ``most`` bytes besides the longest."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype("i8"))
        edges = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def sample_by_hash(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """At most ``size`` of the rows, the first by the hash of ``columns``.

    Rows are thinned by the same hash before they are ordered, to about twice as many, so that what leaves
    the tasks is bounded however many there are. Reads ``rows`` once to count them.
    """
    count, span = rows.count(), 1 << 31
    place = F.pmod(F.xxhash64(*columns), F.lit(span))
    if count > 2 * size:
        rows = rows.where(place < int(span * 2 * size / count))
    return rows.orderBy(place, *columns).limit(size)
