"""Normal forms used before two field values are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace in the Unicode sense, spelled out so that Java regex treats it alike everywhere.
_WS = r"[\s\p{Z}\x1c-\x1f\x85]"
_EDGES = rf"^{_WS}+|{_WS}+$"

# English month names in calendar order.
_MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]


def strip(c: Column) -> Column:
    """Value without leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, _EDGES, "")


def normalize_string(c: Column) -> Column:
    """Lower case, whitespace runs collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), rf"{_WS}+", " "))


def normalize_address(c: Column) -> Column:
    """Bare word sequence: anything that is no letter, digit or underscore separates words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def normalize_number(c: Column) -> Column:
    """Number inside a formatted string; NULL when what remains is no number."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


# One pattern for the forms that are not ISO already, rewritten to year-month-day. Groups that take
# no part in a match are empty in the replacement, so the three alternatives share it.
_WRITTEN = (
    r"^(?:([a-z]+)\s+(\d{1,2}),\s+|(\d{1,2})\s+([a-z]+)\s+|(\d{1,2})([/.\-])(\d{1,2})\6)(\d{4})$"
)
_YEAR_MONTH_DAY = "$8-$1$4$7-$2$3$5"


def normalize_date(c: Column) -> Column:
    """ISO date when one of the accepted forms fits, else the stripped input.

    Accepted, first fit wins: Y-m-d, d/m/Y, d-m-Y, m/d/Y, d.m.Y, "Month d, Y", "d Month Y".
    Casts decide whether a day exists: unlike format parsers they raise nothing internally on the
    many rows that do not fit. The expression is kept small, since it is compiled inline into every
    stage that compares dates.
    """
    text = strip(c)
    ordered = F.regexp_replace(F.lower(text), _WRITTEN, _YEAR_MONTH_DAY)
    swapped = F.regexp_replace(ordered, r"^(\d{4})-(\d+)-(\d+)$", "$1-$3-$2")
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.split_part(ordered, F.lit("-"), F.lit(2)))
    named = F.concat(
        F.split_part(ordered, F.lit("-"), F.lit(1)), F.lit("-"), month.cast("string"), F.lit("-"),
        F.split_part(ordered, F.lit("-"), F.lit(3)),
    )
    parsed = F.when(
        ordered.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"),
        # Month before day is accepted with slashes only.
        F.coalesce(
            ordered.try_cast("date"), F.when(text.contains("/"), swapped.try_cast("date"))
        ),
    ).when(
        # An unknown name has position 0, which is no month; written forms with a name have no dash.
        ~text.contains("-") & ordered.rlike(r"^(?!0000)\d{4}-[a-z]+-\d{1,2}$"),
        named.try_cast("date"),
    )
    return F.coalesce(parsed.cast("string"), text)
