"""Extracted fields with their trust signal.

One document is one row with a bounded ``fields`` array (one struct per declared field). Steps that
look at one document only stay row-local on that array; corpus metrics explode it. ``values_long``
and friends convert between that form and plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.functions.staging import computed_once
from fieldtrust.schemas import FIELD_DDL, INVOICE_FIELDS, LOCATION_DDL, TAX_TOTAL

_NUMERIC = (T.DoubleType, T.FloatType, T.DecimalType, T.IntegralType)

DEFAULT_CONFIDENCE = 0.5


def no_location() -> Column:
    return F.lit(None).cast(LOCATION_DDL)


def location(page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    bbox = F.array(*[c.cast("double") for c in (x0, y0, x1, y1)])
    return F.struct(page.cast("int").alias("page"), bbox.alias("bbox"))


def field_struct(
    name: str,
    value: Column,
    value_num: Column | None = None,
    confidence: Column | None = None,
    source_location: Column | None = None,
) -> Column:
    """One wrapped field; a value never verified counts as certain (confidence 1)."""
    return F.struct(
        F.lit(name).alias("field"),
        value.cast("string").alias("value"),
        (F.lit(None) if value_num is None else value_num).cast("double").alias("value_num"),
        (F.lit(1.0) if confidence is None else confidence).cast("double").alias("confidence"),
        (no_location() if source_location is None else source_location).alias("source_location"),
        F.lit("extracted").alias("status"),
    )


def _path_type(schema: T.StructType, path: str) -> T.DataType:
    node: T.DataType = schema
    for part in path.split("."):
        node = node[part].dataType
    return node


def plain_field(df: DataFrame, name: str, path: str, prefix: str = "") -> Column:
    """Wrapped field read from a plain column (numbers keep their numeric value)."""
    full = f"{prefix}{path}"
    c = F.col(full)
    numeric = isinstance(_path_type(df.schema, full), _NUMERIC)
    return field_struct(name, c, c if numeric else None)


def wrap_fields(df: DataFrame, fields: list[str] = INVOICE_FIELDS, prefix: str = "") -> Column:
    """Plain record -> ``fields`` array; the tax field takes the nested total as its value."""
    paths = [TAX_TOTAL if f == "tax" else f for f in fields]
    return F.array(*[plain_field(df, f, p, prefix) for f, p in zip(fields, paths)])


def has_value(f: Column) -> Column:
    return f["value"].isNotNull() | f["value_num"].isNotNull()


def is_abstained(f: Column) -> Column:
    return f["status"] == "abstained"


def is_grounded(f: Column) -> Column:
    return f["source_location"].isNotNull()


def is_ungrounded_value(f: Column) -> Column:
    """A value nobody can point to in the document; abstention does not excuse it."""
    return has_value(f) & ~is_grounded(f)


def effective_value(f: Column) -> Column:
    return F.when(~is_abstained(f), f["value"])


def effective_number(f: Column) -> Column:
    return F.when(~is_abstained(f), f["value_num"])


def raw_value(fields: Column, name: str) -> Column:
    """Value of one field of a document even if abstained."""
    return F.get(F.filter(fields, lambda f: f["field"] == name), F.lit(0))["value"]


def rebuilt(f: Column, **changes: Column) -> Column:
    """Copy of a wrapped field with some members replaced."""
    names = ["field", "value", "value_num", "confidence", "source_location", "status"]
    return F.struct(*[changes.get(n, f[n]).alias(n) for n in names])


def abstained_fields(fields: Column) -> Column:
    return F.transform(F.filter(fields, is_abstained), lambda f: f["field"])


def ungrounded_fields(fields: Column) -> Column:
    return F.transform(F.filter(fields, is_ungrounded_value), lambda f: f["field"])


def apply_verification(fields: Column, verification: Column) -> Column:
    """Attach a verifier's answer, a map field -> struct(confidence, source_location).

    An entry that is missing or null means "uncertain, no location". The answer for the tax field
    comes under the key ``tax_total_tax``.
    """

    def attach(f: Column) -> Column:
        key = F.when(f["field"] == "tax", F.lit("tax_total_tax")).otherwise(f["field"])
        answer = F.try_element_at(verification, key)
        return rebuilt(
            f,
            confidence=F.coalesce(answer["confidence"], F.lit(DEFAULT_CONFIDENCE)),
            source_location=answer["source_location"].cast(LOCATION_DDL),
        )

    return F.transform(fields, attach)


def join_verification(
    extracted: DataFrame, answers: DataFrame, keys: tuple[str, str] = ("doc_name", "field")
) -> DataFrame:
    """The same for long tables: extracted fields with a verifier's rows (keys, confidence,
    source_location), left join on document and field."""
    named = answers.select(
        *[
            F.when(F.col(k) == "tax_total_tax", F.lit("tax")).otherwise(F.col(k)).alias(k)
            if k == keys[1]
            else F.col(k)
            for k in keys
        ],
        F.col("confidence").alias("_confidence"),
        F.col("source_location").alias("_location"),
    )
    kept = [c for c in extracted.columns if c not in ("confidence", "source_location")]
    return extracted.join(named, list(keys), "left").select(
        *kept,
        F.coalesce("_confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.col("_location").alias("source_location"),
    )


def fields_long(df: DataFrame, *keys: str, fields: str = "fields") -> DataFrame:
    """One row per (document, field)."""
    # Staged, since a generator's input is put into a filter on its size as well, and would be computed twice.
    staged = computed_once(df.select(*keys, F.col(fields).cast(f"array<{FIELD_DDL}>").alias("_cast")), "_fields", F.col("_cast"))
    return staged.select(*keys, F.inline("_fields"))


def confidence_pairs(long: DataFrame, *keys: str) -> DataFrame:
    """(field, confidence, extracted): extracted is true, or NULL where nothing is accepted."""
    shown = has_value(_row()) & ~is_abstained(_row())
    return long.select(
        *keys, "field", "confidence", F.when(shown, F.lit(True)).alias("extracted")
    )


def _row() -> dict[str, Column]:
    return {n: F.col(n) for n in ("value", "value_num", "status", "source_location")}


def value_record(fields: Column, names: list[str] = INVOICE_FIELDS) -> Column:
    """Plain record of a document's effective values, read off its array (no shuffle)."""

    def pick(name: str) -> Column:
        hit = F.get(F.filter(fields, lambda f: f["field"] == name), F.lit(0))
        return effective_value(hit)

    return F.struct(*[pick(n).alias(n) for n in names])


def pivot_values(
    long: DataFrame, key: str = "doc_name", names: list[str] = INVOICE_FIELDS
) -> DataFrame:
    """Long -> wide where only the long table exists; declared columns, partial aggregation."""
    shown = F.when(F.col("status") != "abstained", F.col("value"))
    return long.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == n, shown)).alias(n) for n in names]
    )
