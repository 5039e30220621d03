"""Comparison of one predicted value with its ground truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrust.functions.normalize import (
    normalize_address,
    normalize_date,
    normalize_number,
    normalize_string,
)
from fieldtrust.schemas import ADDRESS_FIELDS, DATE_FIELDS, NUMBER_FIELDS

NUMBER_TOLERANCE = 0.011


def field_match(
    field: Column,
    pred: Column,
    truth: Column,
    pred_num: Column | None = None,
    truth_num: Column | None = None,
) -> Column:
    """True / False for a scored pair, NULL where there is no ground truth.

    Works on the long form, so that one expression serves all fields. ``*_num`` carry values that are
    numbers already.
    """
    pred_num = F.lit(None).cast("double") if pred_num is None else pred_num
    truth_num = F.lit(None).cast("double") if truth_num is None else truth_num
    p = F.coalesce(pred_num, normalize_number(pred))
    g = F.coalesce(truth_num, normalize_number(truth))
    missing = pred.isNull() & pred_num.isNull()

    def canonical(value: Column) -> Column:
        return (
            F.when(field.isin(DATE_FIELDS), normalize_date(value))
            .when(field.isin(ADDRESS_FIELDS), normalize_address(value))
            .otherwise(normalize_string(value))
        )

    # Both sides go through one expression: written out twice, the normal forms would make a method
    # larger than the JIT compiles. Equal texts, the usual case, need no normal form at all.
    forms = F.transform(F.array(pred, truth), canonical)
    same = (
        F.when(field.isin(NUMBER_FIELDS), F.abs(p - g) < NUMBER_TOLERANCE)
        .when(pred == truth, F.lit(True))
        .otherwise(F.size(F.array_distinct(forms)) == 1)
    )
    no_truth = truth.isNull() & truth_num.isNull()
    return F.when(~no_truth, ~missing & F.coalesce(same, F.lit(False)))
