"""Repeated groups in plain texts: sections with a heading line and the rows below it.

A section begins at a line that names its columns and goes on to the line that ends it, or to the next heading. Which
cell is which column follows from the heading of that very section, so orders and missing columns may differ from one
to the next. Everything is row-local: a text becomes an array of structs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrust.functions.normalize import normalize_date, normalize_number, strip


@dataclass(frozen=True)
class TableRule:
    """How a kind of section looks. Patterns ignore case.

    ``columns`` gives each column a pattern for its title and a kind (``text``, ``number`` or ``date``). A line is a
    heading where a title of every column of ``heading`` stands in it; ``end`` matches the beginning of the line
    that ends a section. Rows without a value for each column of ``required`` (remarks, page numbers) are no rows.
    """

    columns: dict[str, tuple[str, str]]
    heading: list[str]
    required: list[str]
    end: str
    cells: str = r"\s{2,}|\s*[\t|]\s*"
    nothing: list[str] = field(default_factory=lambda: ["", "-", "—"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cells(line: Column, rule: TableRule) -> Column:
    return F.split(F.regexp_replace(line, r"^[\s|]+|[\s|]+$", ""), rule.cells)


def _position(titles: Column, pattern: str) -> Column:
    """1-based place of the first title that fits, 0 without one."""
    return F.array_position(F.transform(titles, lambda t: t.rlike(f"(?i)^(?:{pattern})$")), F.lit(True)).cast("int")


def _typed(cell: Column, kind: str) -> Column:
    if kind == "number":
        return normalize_number(cell)
    if kind == "date":
        return bound(normalize_date(cell), lambda d: F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), d))
    return cell


def text_tables(text: Column, rule: TableRule) -> Column:
    """All rows of all such sections of a text in order: array of structs (section, row, one member per column).

    ``section`` and ``row`` count from 0, rows by their line below the heading. A missing column and an empty cell
    are NULL, also a number or date that cannot be read. A text without sections gives an empty array, NULL gives NULL.
    """
    titles = [f"(?=.*(?:{rule.columns[name][0]}))" for name in rule.heading]
    heading = "".join(titles)
    # A section begins with its heading line, and what ends it is cut off.
    parts = F.filter(F.split(text, rf"(?im)^(?={heading})"), lambda s: s.rlike(rf"(?i)^{heading}"))
    lines = F.transform(parts, lambda s: F.split(F.get(F.split(s, rf"(?im)^(?=[^\S\r\n]*(?:{rule.end}))", 2), F.lit(0)), r"\r?\n"))

    def section(of: Column) -> Column:
        places = bound(
            _cells(F.get(of, F.lit(0)), rule),
            lambda found: F.struct(*[_position(found, pattern).alias(name) for name, (pattern, _) in rule.columns.items()]),
        )
        return F.struct(places.alias("places"), F.transform(F.slice(of, 2, F.size(of)), lambda line: _cells(line, rule)).alias("rows"))

    def rows(of: Column, number: Column) -> Column:
        def row(cells: Column, at: Column) -> Column:
            values = []
            for name, (_, kind) in rule.columns.items():
                place = of["places"][name]
                cell = strip(F.when(place > 0, F.get(cells, place - 1)))
                given = bound(cell, lambda c: F.when(~c.isin(rule.nothing), c))
                values.append(_typed(given, kind).alias(name))
            return F.struct(number.alias("section"), at.alias("row"), *values)

        def whole(r: Column) -> Column:
            return F.array_size(F.array_compact(F.array(*[r[n].cast("string") for n in rule.required]))) == len(rule.required)

        return F.filter(F.transform(of["rows"], row), whole)

    return F.flatten(F.transform(F.transform(lines, section), rows))
