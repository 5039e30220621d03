"""Accuracy and trust metrics over the long table of scored fields.

Populations differ between metrics, and each is a named filter here:

* accuracy: every (document, field) pair with ground truth, the tax total among them;
* calibration and coverage: the same pairs without the tax total, whose dotted name does not match
  the extraction's field name;
* ungrounded values: every non-null value, scored or not, abstained or not;
* abstention rate: abstained fields of all twelve, over the scored pairs.

A value is judged after the gate, so an abstained value that was right counts as a miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.fields import (
    effective_number,
    effective_value,
    has_value,
    is_abstained,
    is_ungrounded_value,
    wrap_fields,
)
from fieldtrust.functions.grounding import find_exact
from fieldtrust.functions.matching import field_match
from fieldtrust.functions.normalize import normalize_string
from fieldtrust.operators.ranking import running_sums
from fieldtrust.schemas import CALIBRATED_FIELDS, INVOICE_FIELDS, LOCATION_DDL, SCORED_FIELDS, TAX_TOTAL
from fieldtrust.session import materialised

# A wrapped field's members in the order of ``FIELD_DDL``.
_MEMBERS_DDL = {
    "field": "string", "value": "string", "value_num": "double", "confidence": "double", "source_location": LOCATION_DDL,
    "status": "string",
}
_MEMBERS = list(_MEMBERS_DDL)
# States of a field that extraction and gate give.
_STATES = ["extracted", "abstained"]


def score_documents(
    truth: DataFrame, predicted: DataFrame, doc: str = "doc_name",
    fields: list[str] = SCORED_FIELDS,
) -> DataFrame:
    """Scored long table from documents with ``fields`` arrays on both sides.

    Joined per document, one row each, and only then exploded: the shuffle carries a twelfth of
    the rows a join per (document, field) would. It carries an array per member instead of one of structs, so
    members nobody reads are left out. ``truth`` may also be plain records, which take less room still and are
    wrapped after the join. Truth drives; a document without prediction gives misses, and so does a field missing
    from the prediction. ``first_of_doc`` marks one row of every document.
    """
    # Lists of names and states are nearly always made of these, so that others only are written out.
    usual = F.array(*[F.lit("tax" if f == TAX_TOTAL else f) for f in fields])
    states = F.array(*[F.lit(s) for s in _STATES])

    def member(df: DataFrame, name: str) -> Column:
        theirs = df.schema["fields"].dataType.elementType.names
        return F.col("fields")[theirs[_MEMBERS.index(name)]].cast(f"array<{_MEMBERS_DDL[name]}>")

    def unusual(names: Column) -> Column:
        return F.when(names != usual, names)

    status = member(predicted, "status")
    pred = predicted.select(
        doc, unusual(member(predicted, "field")).alias("_p_field"),
        *[member(predicted, n).alias(f"_p_{n}") for n in _MEMBERS[1:-1]],
        F.transform(status, lambda s: F.array_position(states, s).cast("tinyint")).alias("_p_state"),
        F.when(F.exists(status, lambda s: ~s.isin(_STATES)), status).alias("_p_status"),
        F.lit(True).alias("extracted_doc"),
    )
    if "fields" in truth.columns:
        named = truth.select(
            doc, unusual(member(truth, "field")).alias("_t_field"),
            *[member(truth, n).alias(f"_t_{n}") for n in ("value", "value_num")],
        )
        joined = named.join(pred, doc, "left")
        # A document without a list of values has no list of names either.
        joined = joined.withColumn("_t_field", F.when(F.col("_t_value").isNotNull(), F.coalesce("_t_field", usual)))
    else:
        joined = truth.select(doc, *INVOICE_FIELDS).join(pred, doc, "left")
        joined = joined.select(*pred.columns, *[wrap_fields(joined)[n].alias(f"_t_{n}") for n in ("field", "value", "value_num")])
    joined = joined.withColumn("_p_field", F.coalesce("_p_field", usual))

    def dotted(field: Column) -> Column:
        return F.when(field == "tax", F.lit(TAX_TOTAL)).otherwise(field)

    first = F.array_position(F.transform("_t_field", lambda f: dotted(f).isin(fields)), F.lit(True))
    arrays = [c for c in joined.columns if c not in (doc, "extracted_doc")]
    placed = joined.withColumn("_first", first).select(
        doc, F.coalesce("extracted_doc", F.lit(False)).alias("extracted_doc"), "_first", *arrays,
        F.posexplode("_t_field").alias("_i", "_field"),
    ).filter(dotted(F.col("_field")).isin(fields))
    # Both sides normally list the fields in declared order; search only where they do not.
    place = F.when(F.get("_p_field", F.col("_i")) == F.col("_field"), F.col("_i")).otherwise(
        F.array_position("_p_field", F.col("_field")).cast("int") - 1
    )
    long = placed.withColumn("_at", place).select(
        doc, "extracted_doc",
        dotted(F.col("_field")).alias("field"),
        F.get("_t_value", F.col("_i")).alias("truth"),
        F.get("_t_value_num", F.col("_i")).alias("truth_num"),
        (F.col("_i") + 1 == F.col("_first")).alias("first_of_doc"),
        *[F.get(f"_p_{n}", F.col("_at")).alias(n) for n in _MEMBERS[1:-1]],
        F.coalesce(F.get("_p_status", F.col("_at")), F.get(states, F.get("_p_state", F.col("_at")) - 1)).alias("status"),
    )
    return scored(long, field_members())


def scored(long: DataFrame, p: Column | dict[str, Column] | None = None) -> DataFrame:
    """Add the three-valued ``correct`` to a long table with ``truth``/``truth_num`` and struct ``p``, or with the
    members ``p`` as columns."""
    p = F.col("p") if p is None else p
    correct = field_match(
        F.col("field"), effective_value(p), F.col("truth"), effective_number(p), F.col("truth_num")
    )
    return long.select(
        *[c for c in long.columns if c not in ("p", *_MEMBERS[1:])], *[p[m].alias(m) for m in _MEMBERS[1:]],
        correct.alias("correct"),
    )


def field_members() -> dict[str, Column]:
    """The wrapped-field members of a long table, for the predicates of ``functions.fields``."""
    return {c: F.col(c) for c in ("value", "value_num", "confidence", "source_location", "status")}


def match_fields(
    truth_long: DataFrame, pred_long: DataFrame, keys: tuple[str, str] = ("doc_name", "field")
) -> DataFrame:
    """Per-field join, for tables that exist in long form only."""
    t = truth_long.select(*keys, F.col("value").alias("truth"), F.col("value_num").alias("truth_num"))
    p = pred_long.select(
        *keys,
        F.struct(
            F.col("field"), "value", "value_num", "confidence", "source_location", "status"
        ).alias("p"),
    )
    return scored(t.join(p, list(keys), "left"))


def accuracy_wide(scored_long: DataFrame, doc: str = "doc_name") -> DataFrame:
    """One three-valued column per scored field (partial aggregation, declared columns)."""
    return scored_long.groupBy(doc).agg(
        *[F.max(F.when(F.col("field") == f, F.col("correct"))).alias(f.replace(".", "_"))
          for f in SCORED_FIELDS]
    )


def cells(scored_long: DataFrame, merge: bool = False) -> DataFrame:
    """Weighted rows (field, confidence, counts) that all corpus metrics below sum up.

    Unmerged this is a projection, so a single metric aggregates straight from its input. With
    ``merge`` equal (field, confidence) rows are added up once and several metrics share that one
    shuffle.
    """
    f = field_members()

    def one(condition: Column) -> Column:
        return F.coalesce(condition.cast("bigint"), F.lit(0).cast("bigint"))

    out = scored_long.select(
        "field",
        "confidence",
        F.lit(1).cast("bigint").alias("n"),
        *([one(F.col("first_of_doc")).alias("n_docs")] if "first_of_doc" in scored_long.columns else []),
        one(F.col("correct").isNotNull()).alias("n_scored"),
        one(F.col("correct")).alias("n_correct"),
        one(has_value(f)).alias("n_value"),
        one(is_ungrounded_value(f)).alias("n_ungrounded"),
        one(is_abstained(f)).alias("n_abstained"),
        one(has_value(f) & ~is_abstained(f)).alias("n_accepted"),
        one(is_ungrounded_value(f) & ~is_abstained(f)).alias("n_accepted_ungrounded"),
    )
    if not merge:
        return out
    counts = [c for c in out.columns if c.startswith("n")]
    return out.groupBy("field", "confidence").agg(*[F.sum(c).alias(c) for c in counts])


def corpus_metrics(cell_rows: DataFrame) -> DataFrame:
    """Per-field accuracy and, in the row ``field = NULL``, the accuracy pooled over all pairs.

    Fields without any scored pair do not appear.
    """
    return (
        cell_rows.rollup("field")
        .agg(
            F.sum("n_correct").alias("_hits"), F.sum("n_scored").alias("n_scored"),
            F.grouping("field").alias("_all"),
        )
        .filter((F.col("n_scored") > 0) | (F.col("_all") == 1))
        .select(
            "field",
            F.round(F.try_divide("_hits", "n_scored"), 4).alias("accuracy"),
            F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        )
    )


def corpus_summary(cell_rows: DataFrame) -> DataFrame:
    """The headline row: pooled accuracy, documents, scored pairs.

    Documents scored by ``score_documents`` are counted one by one. Of tables that exist in long form only, the fullest
    field tells their number, as a document has one row per field there.
    """
    counted = "n_docs" in cell_rows.columns
    per_field = cell_rows.groupBy("field").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_scored", "n_correct", *["n_docs"] * counted)]
    )
    return per_field.agg(
        F.round(F.try_divide(F.sum("n_correct"), F.sum("n_scored")), 4).alias("macro_accuracy"),
        F.coalesce(F.sum("n_docs") if counted else F.max("n"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum("n_scored"), F.lit(0)).alias("n_scored_pairs"),
    )


def doc_progress(scored_long: DataFrame, doc: str = "doc_name", *extra: str) -> DataFrame:
    """Per document: fields matched, fields scored, fields abstained."""
    f = field_members()
    return scored_long.groupBy(doc, *extra).agg(
        F.count_if(F.col("correct")).alias("n_matched"),
        F.count("correct").alias("n_scored"),
        F.count_if(is_abstained(f)).alias("n_abstained"),
    )


def calibrated(cell_rows: DataFrame, fields: list[str] | None = CALIBRATED_FIELDS) -> DataFrame:
    """The scored pairs with a confidence that calibration and coverage look at."""
    pairs = cell_rows.filter((F.col("n_scored") > 0) & F.col("confidence").isNotNull())
    return pairs if fields is None else pairs.filter(F.col("field").isin(fields))


def reliability(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """Non-empty equal-width bins: index, mid, accuracy, mean confidence, size (unrounded)."""
    # Confidences lie in [0, 1]; the last bin takes 1 itself.
    index = F.least(F.floor(F.col("confidence") * n_bins), F.lit(n_bins - 1).cast("bigint"))
    return (
        pairs.groupBy(index.alias("bin"))
        .agg(
            F.sum("n_correct").alias("_ok"),
            F.sum(F.col("confidence") * F.col("n_scored")).alias("_conf"),
            F.sum("n_scored").alias("n"),
        )
        .select(
            "bin", F.round((F.col("bin") + 0.5) / n_bins, 3).alias("bin_mid"),
            (F.col("_ok") / F.col("n")).alias("accuracy"),
            (F.col("_conf") / F.col("n")).alias("confidence"), "n",
        )
    )


def reliability_table(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """Reliability bins as reported, four decimals."""
    return reliability(pairs, n_bins).select(
        "bin_mid", F.round("accuracy", 4).alias("accuracy"),
        F.round("confidence", 4).alias("confidence"), "n",
    )


def expected_calibration_error(pairs: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row ``ece``; NULL without pairs."""
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")
    return reliability(pairs, n_bins).agg(
        F.round(F.try_divide(F.sum(gap), F.sum("n")), 4).alias("ece")
    )


def hallucination_rate(cell_rows: DataFrame, accepted_only: bool = False) -> DataFrame:
    """Share of values without location; NULL without rows, 0 without values.

    Abstained values count unless ``accepted_only`` asks for the stricter reading.
    """
    n = F.sum("n_accepted" if accepted_only else "n_value")
    bad = F.sum("n_accepted_ungrounded" if accepted_only else "n_ungrounded")
    return cell_rows.agg(
        F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(bad, n), 4)).alias(
            "hallucination_rate"
        )
    )


def precision_curve(pairs: DataFrame) -> DataFrame:
    """Per distinct threshold: how many pairs reach it and how many of those are right."""
    distinct = pairs.groupBy("confidence").agg(
        F.sum("n_scored").alias("n"), F.sum("n_correct").alias("ok")
    )
    return running_sums(
        distinct, "confidence", {"n": "accepted", "ok": "accepted_ok"}, descending=True
    )


def coverage_at_precision(pairs: DataFrame, target: float = 0.99) -> DataFrame:
    """Largest share of pairs that one threshold accepts at precision >= target; NULL if none.

    Precision may dip below the target and recover at a lower threshold; the lowest one that
    holds counts.
    """
    holds = F.col("accepted_ok") / F.col("accepted") >= F.lit(float(target))
    return precision_curve(pairs).agg(
        F.round(
            F.try_divide(F.max(F.when(holds, F.col("accepted"))), F.max("accepted")), 4
        ).alias("coverage")
    )


def abstention_rate(cell_rows: DataFrame) -> DataFrame:
    """Abstained fields, scored or not, over the scored pairs (at least one)."""
    return cell_rows.agg(
        (
            F.coalesce(F.sum("n_abstained"), F.lit(0))
            / F.greatest(F.lit(1).cast("bigint"), F.sum("n_scored"))
        ).alias("abstention_rate")
    )


def written_cells(scored_long: DataFrame) -> DataFrame:
    """The merged cells of a scored table, written when this is called."""
    return materialised(cells(scored_long, merge=True), "trust-cells")


def trust_metrics(scored_long: DataFrame, target: float = 0.99, n_bins: int = 10) -> DataFrame:
    """All headline metrics as rows (section, metric, value).

    ``scored_long`` holds all twelve fields per document (one without truth has a NULL result),
    so every metric's population can be cut from it. Scoring runs once; all metrics read the merged
    rows, written in between.
    """
    return metrics_of_cells(written_cells(scored_long), target, n_bins)


def metrics_of_cells(merged: DataFrame, target: float = 0.99, n_bins: int = 10) -> DataFrame:
    """The headline metrics of merged cells."""
    pairs = calibrated(merged)

    def rows(df: DataFrame, *metrics: str) -> DataFrame:
        entries = [
            F.struct(
                F.lit("trust").alias("section"), F.lit(m).alias("metric"),
                F.col(m).cast("double").alias("value"),
            )
            for m in metrics
        ]
        return df.select(F.inline(F.array(*entries)))

    per_field = corpus_metrics(merged).filter(F.col("field").isNotNull())
    return (
        rows(corpus_summary(merged), "macro_accuracy", "n_docs", "n_scored_pairs")
        .unionAll(rows(expected_calibration_error(pairs, n_bins), "ece"))
        .unionAll(rows(hallucination_rate(merged), "hallucination_rate"))
        .unionAll(rows(coverage_at_precision(pairs, target), "coverage"))
        .unionAll(rows(abstention_rate(merged), "abstention_rate"))
        .unionAll(
            per_field.select(
                F.lit("field_accuracy").alias("section"), F.col("field").alias("metric"),
                F.col("accuracy").alias("value"),
            )
        )
    )


# Accuracy of the first published run, and the drop below it that is tolerated.
BASELINE_ACCURACY = 0.98
DEFAULT_TOLERANCE = 0.02


def regression_gate(
    summary: DataFrame, baseline: float = BASELINE_ACCURACY, tolerance: float = DEFAULT_TOLERANCE
) -> DataFrame:
    """(passed, message) for the headline row; nothing evaluated fails."""
    floor = baseline - tolerance
    acc = F.col("macro_accuracy")

    def pct(c: Column) -> Column:
        return F.concat(F.format_number(c * 100, 1), F.lit("%"))

    # The wording of the messages.
    bounds = f"floor {floor:.1%} (baseline {baseline:.1%} - tolerance {tolerance:.1%})"
    return summary.select(
        F.coalesce(acc >= F.lit(floor), F.lit(False)).alias("passed"),
        F.when(acc.isNull(), "REGRESSION GATE FAILED: no documents were successfully evaluated.")
        .when(
            acc < F.lit(floor),
            F.concat(F.lit("REGRESSION GATE FAILED: macro accuracy "), pct(acc), F.lit(f" < {bounds}")),
        )
        .otherwise(
            F.concat(F.lit("REGRESSION GATE PASSED: macro accuracy "), pct(acc), F.lit(f" >= {bounds}"))
        )
        .alias("message"),
    )


def precision_recall(scored_long: DataFrame) -> DataFrame:
    """Per-field precision, recall and F1, and their mean over fields in the row ``field = NULL``.

    A prediction counts against precision when it does not match or there is no truth; a truth
    that is not matched counts against recall.
    """
    f = field_members()
    predicted = has_value(f) & ~is_abstained(f)
    hit = F.coalesce(F.col("correct"), F.lit(False))
    per_field = (
        scored_long.groupBy("field")
        .agg(
            F.count_if(hit).alias("tp"),
            F.count_if(predicted & ~hit).alias("fp"),
            F.count_if(F.col("correct").isNotNull() & ~hit).alias("fn"),
        )
        .select(
            "field",
            F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"),
        )
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
                ),
                F.lit(0.0),
            ),
        )
    )
    # Grouping sets over the per-field rows: the overall row is their plain mean.
    return per_field.rollup("field").agg(
        *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")]
    )


def ungrounded_in_text(df: DataFrame, text: str = "text", fields: str = "fields") -> DataFrame:
    """Documents with the accepted values that do not occur in their own text, as words and numbers of their own."""
    body = normalize_string(F.col(text))
    return df.withColumn("_body", body).withColumn(
        "absent_fields",
        F.transform(
            F.filter(
                F.col(fields),
                lambda f: f["value"].isNotNull() & ~is_abstained(f)
                & (find_exact(F.col("_body"), normalize_string(f["value"])) == 0),
            ),
            lambda f: f["field"],
        ),
    ).drop("_body")


def unbalanced_items(pages: DataFrame, doc: str = "doc_name", tolerance: float = 0.011) -> DataFrame:
    """Documents whose items do not add up to their subtotal: (doc, n_items, items_total, subtotal).

    ``pages`` has any number of rows per document (line_items, subtotal); a page sums its own items before documents
    meet. Items without a total and documents without a subtotal do not count.
    """
    money = "decimal(18,2)"
    totals = F.filter(F.transform("line_items", lambda i: i["line_total"].cast(money)), lambda t: t.isNotNull())
    page = pages.select(
        doc, F.size(totals).alias("_n"), "subtotal",
        F.aggregate(totals, F.lit(0).cast(money), lambda a, b: (a + b).cast(money)).alias("_sum"),
    )
    summed = page.groupBy(doc).agg(
        F.sum("_n").alias("n_items"), F.sum("_sum").cast("double").alias("items_total"), F.max("subtotal").alias("subtotal")
    )
    return summed.filter(F.abs(F.col("items_total") - F.col("subtotal")) >= tolerance)


def call_costs(trace: DataFrame, price_per_token: float, doc: str = "doc_name") -> DataFrame:
    """Latency and cost of all model calls of a document."""
    return trace.groupBy(doc).agg(
        F.sum("latency_s").alias("latency_s"),
        (F.sum("tokens") * F.lit(price_per_token)).alias("cost"),
        F.count(F.lit(1)).alias("n_calls"),
    )
