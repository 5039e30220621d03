"""Text -> typed fields, and text -> confidence and location per field.

Both steps are plugged in. The defaults work by rules, as expressions; a model of the user's own
runs batch-wise inside ``mapInPandas``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.functions.fields import apply_verification, field_struct, no_location, rebuilt
from fieldtrust.functions.grounding import find_exact, find_words, one_page_length, page_location, text_index, token_span, token_words
from fieldtrust.functions.normalize import normalize_date, normalize_number, strip
from fieldtrust.functions.staging import computed_once
from fieldtrust.functions.tables import TableRule, bound, text_tables
from fieldtrust.schemas import DATE_FIELDS, INVOICE_FIELDS, LINE_ITEM_DDL, LOCATION_DDL, NUMBER_FIELDS, TAX_DDL, TRANSACTION_DDL

# Task code travels with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Line-oriented rules for plain-text invoices: first group is the value.
INVOICE_RULES = {
    "invoice_number": r"(?im)^\s*invoice (?:no|number)\s*[:.]\s*(\S[^\r\n]*)$",
    "invoice_date": r"(?im)^\s*(?:invoice )?date(?: of issue)?\s*:\s*(\S[^\r\n]*)$",
    "due_date": r"(?im)^\s*due(?: date)?\s*:\s*(\S[^\r\n]*)$",
    "vendor_name": r"(?im)^\s*(?:seller|vendor)\s*:\s*(\S[^\r\n]*)$",
    "vendor_gstin": r"(?im)^\s*(?:seller |vendor )?gstin\s*:\s*(\S[^\r\n]*)$",
    "vendor_address": r"(?im)^\s*address\s*:\s*(\S[^\r\n]*)$",
    "buyer_name": r"(?im)^\s*(?:client|buyer|bill to)\s*:\s*(\S[^\r\n]*)$",
    "buyer_gstin": r"(?im)^\s*(?:client|buyer) gstin\s*:\s*(\S[^\r\n]*)$",
    "currency": r"(?im)^\s*currency\s*:\s*(\S[^\r\n]*)$",
    "subtotal": r"(?im)^\s*(?:subtotal|net worth)\s*:\s*(\S[^\r\n]*)$",
    "total_amount": r"(?im)^\s*(?:total|gross worth)\s*:\s*(\S[^\r\n]*)$",
    "tax": r"(?im)^\s*(?:tax|vat)\s*:\s*(\S[^\r\n]*)$",
}

STATEMENT_RULES = {
    "account_holder_name": r"(?im)^\s*account holder\s*:\s*(\S[^\r\n]*)$",
    "account_number": r"(?im)^\s*account (?:no|number)\s*:\s*(\S[^\r\n]*)$",
    "bank_name": r"(?im)^\s*bank\s*:\s*(\S[^\r\n]*)$",
    "ifsc": r"(?im)^\s*ifsc\s*:\s*(\S[^\r\n]*)$",
    "currency": r"(?im)^\s*currency\s*:\s*(\S[^\r\n]*)$",
    "opening_balance": r"(?im)^\s*opening balance\s*:\s*(\S[^\r\n]*)$",
    "closing_balance": r"(?im)^\s*closing balance\s*:\s*(\S[^\r\n]*)$",
}
STATEMENT_NUMBERS = ["opening_balance", "closing_balance"]

# Item sections of an invoice and booking sections of a statement.
ITEM_TABLE = TableRule(
    columns={
        "description": (r"description|item|particulars|goods|services?", "text"),
        "hsn_sac": (r"(?:hsn|sac)(?:\s*/\s*sac)?(?: code)?", "text"),
        "quantity": (r"qty|quantity", "number"),
        "unit_price": (r"unit price|price|rate", "number"),
        "line_total": (r"amount|line total|net worth", "number"),
    },
    heading=["description", "quantity"],
    required=["description", "quantity"],
    end=r"sub ?total\b|total\b|net worth\b|terms\b|$",
)
BOOKING_TABLE = TableRule(
    columns={
        "date": (r"(?:value |txn )?date", "date"),
        "narration": (r"narration|description|particulars", "text"),
        "debit": (r"debit|withdrawals?", "number"),
        "credit": (r"credit|deposits?", "number"),
        "balance": (r"(?:running )?balance", "number"),
        "ref_no": (r"ref(?:erence)?(?: no)?|che?que no", "text"),
    },
    heading=["date", "balance"],
    required=["date", "balance"],
    end=r"closing balance\b|page\b|$",
)

# The parts of an invoice's tax, and its total where it is written.
TAX_RULES = {
    "cgst": r"(?im)^\s*cgst\b[^:\r\n]*:\s*(\S[^\r\n]*)$",
    "sgst": r"(?im)^\s*sgst\b[^:\r\n]*:\s*(\S[^\r\n]*)$",
    "igst": r"(?im)^\s*igst\b[^:\r\n]*:\s*(\S[^\r\n]*)$",
    "total_tax": r"(?im)^\s*(?:total )?(?:tax|vat)\s*:\s*(\S[^\r\n]*)$",
}
PERIOD_RULE = r"(?im)^\s*(?:statement )?period\s*:\s*(\S[^\r\n]*?)\s+(?:to|until|-)\s+(\S[^\r\n]*)$"


def rule_value(text: Column, pattern: str) -> Column:
    return F.nullif(strip(F.regexp_extract(text, pattern, 1)), F.lit(""))


def rule_record(
    df: DataFrame, rules: dict[str, str], numbers: list[str], text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Plain record per document: one column per rule, numbers parsed."""
    kept = df.columns if keep is None else keep
    found = df.select(*kept, *[rule_value(F.col(text), p).alias(n) for n, p in rules.items()])
    return found.select(
        *kept,
        *[(normalize_number(F.col(n)) if n in numbers else F.col(n)).alias(n) for n in rules],
    )


def line_items(text: Column, rule: TableRule = ITEM_TABLE) -> Column:
    """Items of an invoice text in order, of all its item sections."""
    names = ("description", "hsn_sac", "quantity", "unit_price", "line_total")
    found = F.transform(text_tables(text, rule), lambda r: F.struct(*[r[n].alias(n) for n in names]))
    return found.cast(f"array<{LINE_ITEM_DDL}>")


def transactions(text: Column, rule: TableRule = BOOKING_TABLE) -> Column:
    """Bookings of a statement text in order."""
    names = ("date", "narration", "debit", "credit", "balance", "ref_no")
    found = F.transform(text_tables(text, rule), lambda r: F.struct(*[r[n].alias(n) for n in names]))
    return found.cast(f"array<{TRANSACTION_DDL}>")


def tax_breakdown(text: Column) -> Column:
    """Parts of the tax and their total: the written one, else the sum of what parts there are; NULL without any."""
    parts = [normalize_number(rule_value(text, p)).alias(n) for n, p in TAX_RULES.items()]

    def whole(tax: Column) -> Column:
        given = F.array_compact(F.array(tax["cgst"], tax["sgst"], tax["igst"]))
        total = F.aggregate(given, F.lit(0).cast("decimal(20,2)"), lambda a, b: (a + b.cast("decimal(18,2)")).cast("decimal(20,2)"))
        total = F.coalesce(tax["total_tax"], F.when(F.size(given) > 0, total.cast("double")))
        return F.when(total.isNotNull(), F.struct(tax["cgst"].alias("cgst"), tax["sgst"].alias("sgst"), tax["igst"].alias("igst"), total.alias("total_tax")))

    return bound(F.struct(*parts), whole).cast(TAX_DDL)


def statement_period(text: Column) -> Column:
    """First and last day of a statement as ISO dates; NULL where the text names none."""
    day = lambda i: bound(normalize_date(F.regexp_extract(text, PERIOD_RULE, i)), lambda d: F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), d))
    period = F.struct(day(1).alias("start"), day(2).alias("end"))
    return F.when(text.rlike(PERIOD_RULE), period)


def rule_extractor(
    rules: dict[str, str] = INVOICE_RULES, numbers: list[str] = NUMBER_FIELDS
) -> Callable[[DataFrame], DataFrame]:
    """Extractor that adds ``fields`` to rows with ``text``; values keep the text they came from."""

    def extract(df: DataFrame) -> DataFrame:
        # Value and number of a field come from one run of its pattern.
        raw = computed_once(
            df, "_raw", F.struct(*[rule_value(F.col("text"), p).alias(n) for n, p in rules.items()])
        )
        fields = []
        for name in rules:
            value = F.col(f"_raw.{name}")
            fields.append(field_struct(name, value, normalize_number(value) if name in numbers else None))
        return raw.withColumn("fields", F.array(*fields)).drop("_raw")

    return extract


def is_permanent(error: str) -> bool:
    """Whether a model error stays however long one waits; ``failure_kind`` says the same of a column."""
    limited = "429" in error or "RESOURCE_EXHAUSTED" in error
    return "limit: 0" in error or ("PerDay" in error and limited)


def model_extractor(
    call: Callable[[str, str | None], dict] | None = None, fields: list[str] = INVOICE_FIELDS,
    max_retries: int = 3, max_parallel: int | None = None,
    call_batch: Callable[[list[str], list[str | None]], list[dict]] | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """Extractor around a user's model: ``call(text, instruction) -> {field: value}``.

    A model that takes many texts at once goes in as ``call_batch(texts, instructions)``, one reply per
    text. A reply that is no record of declared scalar values is asked for again with what was wrong as
    part of the instruction; a call that raises is made again as it was, unless its error is permanent.
    After ``max_retries`` tries the document has its last error in ``extract_error`` and no values.
    ``max_parallel`` bounds the calls running at once.
    """
    numbers = set(NUMBER_FIELDS)

    def checked_reply(reply: object) -> dict:
        if not isinstance(reply, dict):
            raise ValueError(f"expected a record, got {type(reply).__name__}")
        for name, value in reply.items():
            if name not in fields:
                raise ValueError(f"unknown field {name}")
            if value is None:
                continue
            if name in numbers:
                float(value)
            elif not isinstance(value, str):
                raise ValueError(f"{name} must be text")
        return reply

    def replies(texts: list[str], hints: list[str | None]) -> list:
        """A reply or the exception raised instead, for each text."""
        if call_batch is None:
            found = []
            for text, hint in zip(texts, hints):
                try:
                    found.append(call(text, hint))
                except Exception as exc:  # noqa: BLE001 - a failed call is data here
                    found.append(exc)
            return found
        try:
            found = list(call_batch(texts, hints))
        except Exception as exc:  # noqa: BLE001
            return [exc] * len(texts)
        short = RuntimeError(f"{len(found)} replies to {len(texts)} texts")
        return found if len(found) == len(texts) else [short] * len(texts)

    def all_of(texts: list[str], instructions: list[str | None]) -> list[tuple[dict, str | None]]:
        hints, done = list(instructions), [({}, None)] * len(texts)
        open_ = list(range(len(texts)))
        for _ in range(max_retries):
            again = []
            for i, reply in zip(open_, replies([texts[i] for i in open_], [hints[i] for i in open_])):
                if isinstance(reply, Exception):
                    done[i] = ({}, str(reply))
                    if not is_permanent(str(reply)):
                        again.append(i)
                    continue
                try:
                    done[i] = (checked_reply(reply), None)
                except (ValueError, TypeError) as exc:
                    done[i] = ({}, str(exc))
                    hints[i] = f"{instructions[i] or ''}\nThe last reply could not be used: {exc}"
                    again.append(i)
            open_ = again
            if not open_:
                break
        return done

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            hints = list(pdf["instruction"]) if "instruction" in pdf else [None] * len(pdf)
            found = all_of(list(pdf["text"]), hints)
            values = [[None if reply.get(f) is None else str(reply[f]) for f in fields] for reply, _ in found]
            yield pdf.assign(_values=values, extract_error=[error for _, error in found])

    def extract(df: DataFrame) -> DataFrame:
        bounded = df if max_parallel is None else df.repartition(max_parallel)
        schema = T.StructType(
            [
                *df.schema.fields,
                T.StructField("_values", T.ArrayType(T.StringType())),
                T.StructField("extract_error", T.StringType()),
            ]
        )
        replies = bounded.mapInPandas(batches, schema)
        wrapped = []
        for i, name in enumerate(fields):
            value = F.get("_values", F.lit(i))
            wrapped.append(
                field_struct(name, value, value.try_cast("double") if name in numbers else None)
            )
        return replies.withColumn("fields", F.array(*wrapped)).drop("_values")

    return extract


def model_verifier(
    call: Callable[[str, dict[str, str], str | None], dict], max_retries: int = 3,
) -> Callable[[DataFrame], DataFrame]:
    """Verifier around a user's model: ``call(text, {field: value}, hint) -> {field: answer}``.

    Only fields with a value are asked for, the tax under ``tax_total_tax``. An answer is None or a record with
    ``confidence`` (0 to 1) and, where the value was found, ``source_location`` with ``page`` and the four numbers of
    ``bbox``. A reply of another shape is asked for again with what was wrong as the hint; a call that raises is made
    again, unless its error is permanent. After ``max_retries`` tries all fields count as uncertain, and the document
    has the last error in ``verify_error``. Fields without an answer, or asked for in vain, get the default.
    """

    def checked(reply: object, asked: dict[str, str]) -> dict:
        if not isinstance(reply, dict):
            raise ValueError(f"expected a record, got {type(reply).__name__}")
        answers = {}
        for name, answer in reply.items():
            if name not in asked:
                raise ValueError(f"unknown field {name}")
            if answer is None:
                continue
            confidence, place = float(answer["confidence"]), answer.get("source_location")
            if not 0 <= confidence <= 1:
                raise ValueError(f"confidence of {name} is not between 0 and 1")
            if place is not None:
                box = [float(x) for x in place["bbox"]]
                if len(box) != 4:
                    raise ValueError(f"bbox of {name} has {len(box)} numbers")
                place = {"page": int(place["page"]), "bbox": box}
            answers[name] = {"confidence": confidence, "source_location": place}
        return answers

    def verified(text: str, asked: dict[str, str]) -> dict:
        hint, error = None, None
        for _ in range(max_retries):
            try:
                reply = call(text, asked, hint)
            except Exception as exc:  # noqa: BLE001 - a failed call is data here
                error = str(exc)
                if is_permanent(error):
                    break
                continue
            try:
                return {"answers": checked(reply, asked)}
            except (ValueError, TypeError, KeyError, AttributeError) as exc:
                error = f"{type(exc).__name__}: {exc}"
                hint = f"The last reply could not be used: {exc}"
        return {"error": error}

    @F.pandas_udf("string")
    def replies(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(verified(t or "", json.loads(a))) for t, a in zip(texts, asked)], dtype=object)

    replies = replies.asNondeterministic()

    def verify(df: DataFrame) -> DataFrame:
        key = lambda f: F.when(f["field"] == "tax", F.lit("tax_total_tax")).otherwise(f["field"])
        asked = F.transform(F.filter("fields", lambda f: f["value"].isNotNull()), lambda f: F.struct(key(f), f["value"]))
        staged = computed_once(df, "_reply", replies(F.col("text"), F.to_json(F.map_from_entries(asked))))
        answer = f"struct<answers:map<string,struct<confidence:double,source_location:{LOCATION_DDL}>>,error:string>"
        parsed = computed_once(staged, "_parsed", F.from_json("_reply", answer))
        return parsed.withColumns({
            "fields": apply_verification(F.col("fields"), F.col("_parsed.answers")), "verify_error": F.col("_parsed.error"),
        }).drop("_reply", "_parsed")

    return verify


# Confidence by how a value is found, inside the bands 0.9-1 (as it stands), 0.7-0.9 (other
# format), 0.5-0.7 (partly) and below 0.5 (not at all). A missing value cannot be confirmed.
EXACT, REFORMATTED, PARTIAL, ABSENT = 0.95, 0.8, 0.6, 0.2


# Written dates as token sequences, separators aside.
_DATE_WORDS = [
    "yyyy MM dd", "dd MM yyyy", "MM dd yyyy", "d M yyyy",
    "MMMM dd yyyy", "MMMM d yyyy", "dd MMMM yyyy", "d MMMM yyyy",
]


def text_verifier(df: DataFrame, text: str = "text") -> DataFrame:
    """Set confidence and location of every field by looking its value up in the document's text.

    A value counts as it stands, else by its tokens, as a date in another form, or as a number written otherwise; always
    at word edges. Of a value found in part, at least half of its tokens have to stand in the text; it has no place.
    Pages are separated by form feeds, and a location is the span of characters on its page.
    """
    body = F.col(text)
    exact = F.transform("fields", lambda f: F.when(f["value"].isNotNull(), F.coalesce(find_exact(body, f["value"]), F.lit(0))))
    staged = computed_once(df, "_exact", exact)
    # Most documents have every value as it stands, and need no index.
    staged = computed_once(staged, "_index", F.when(F.exists("_exact", lambda at: at == 0), text_index(body)))
    staged = computed_once(staged, "_length", one_page_length(body))
    index = F.col("_index")

    def other_form_at(f: Column, words: Column) -> Column:
        """struct(first, count): place of the value in another spelling, by tokens, as a date, or as a number."""
        day = normalize_date(f["value"]).try_cast("date")
        found = lambda w: F.struct(find_words(index, w).alias("first"), (F.size(F.split(w, " ")) - 2).alias("count"))
        padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        number = F.regexp_replace(f["value"], r"[^0-9.\-]", "")
        written = F.when(
            f["field"].isin(DATE_FIELDS) & day.isNotNull(), F.array(*[padded(F.lower(F.date_format(day, form))) for form in _DATE_WORDS])
        ).when(f["field"].isin(NUMBER_FIELDS), F.array(token_words(number)))
        forms = F.concat(F.array(words), F.coalesce(written, F.array().cast("array<string>")))
        return F.get(F.filter(F.transform(forms, found), lambda r: r["first"] > 0), F.lit(0))

    def is_partly_there(words: Column) -> Column:
        """Whether at least half of the value's tokens stand in the text."""
        tokens = F.filter(F.split(words, " "), lambda t: t != "")
        hits = F.filter(tokens, lambda t: F.instr(index["words"], F.concat(F.lit(" "), t, F.lit(" "))) > 0)
        return (F.size(tokens) > 0) & (F.size(hits) * 2 >= F.size(tokens))

    def verify(f: Column, number: Column) -> Column:
        value, at = f["value"], F.get(F.col("_exact"), number)
        unlocated = lambda confidence: F.struct(F.lit(confidence).alias("confidence"), no_location().alias("place"))

        def at_run(run: Column) -> Column:
            place = bound(token_span(index, run["first"], run["count"]), lambda s: page_location(body, s["start"], s["length"], F.col("_length")))
            return F.struct(F.lit(REFORMATTED).alias("confidence"), place.alias("place"))

        # Each look-up only where the ones before it found nothing.
        def otherwise_written(words: Column) -> Column:
            partly = F.when(is_partly_there(words), unlocated(PARTIAL)).otherwise(unlocated(ABSENT))
            return bound(other_form_at(f, words), lambda run: F.when(run.isNotNull(), at_run(run)).otherwise(partly))

        as_it_stands = F.struct(F.lit(EXACT).alias("confidence"), page_location(body, at, F.length(value), F.col("_length")).alias("place"))
        found = F.when(value.isNull(), unlocated(ABSENT)).when(at > 0, as_it_stands).otherwise(bound(token_words(value), otherwise_written))
        return bound(found, lambda r: rebuilt(f, confidence=r["confidence"], source_location=r["place"]))

    return staged.withColumn("fields", F.transform("fields", verify)).drop("_exact", "_index", "_length")
