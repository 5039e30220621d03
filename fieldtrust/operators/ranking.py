"""Exact ranks and running sums that never sort a whole column in one task.

``order_key`` maps a double to a 64-bit integer in the same order. Its high digits form cells; the
running sum over cells plus the running sum inside a cell is the running sum over all rows. Every
window therefore runs inside one cell, whose number of distinct keys the digit width bounds,
whatever the distribution: rows with equal values were merged before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.session import materialised

# Digits of the 63-bit key from high to low: a window never spans more than 2^21 keys.
_DIGIT_BITS = (21, 21, 21)

#: Rows of a group that one window numbers; larger groups are numbered cell by cell.
GROUP_ROWS = 1 << 20


def order_key(c: Column) -> Column:
    """Integer in the order of the double (the value's own exponent and mantissa bits)."""
    v = F.abs(c.cast("double"))
    guess = F.least(F.floor(F.log2(v)), F.lit(1023).cast("bigint"))
    # log2 may be off by one next to powers of two; powers of two themselves are exact.
    exp = (
        F.when(F.pow(F.lit(2.0), guess) > v, guess - 1)
        .when(F.pow(F.lit(2.0), guess + 1) <= v, guess + 1)
        .otherwise(guess)
    )
    exp = F.greatest(exp, F.lit(-1022).cast("bigint"))
    mantissa = F.floor((v / F.pow(F.lit(2.0), exp)) * F.lit(float(2**52)))
    bits = (exp + 1022) * F.lit(2**52).cast("bigint") + mantissa
    bits = (
        F.when(v == 0, F.lit(0).cast("bigint"))
        .when(v >= float("inf"), F.lit(2047 * 2**52).cast("bigint"))
        .otherwise(bits.cast("bigint"))
    )
    return F.when(c < 0, -bits).otherwise(bits)


def with_digits(df: DataFrame, value: str) -> tuple[DataFrame, list[str]]:
    """Add the key's digits as columns ``_d0``, ``_d1``, ``_d2`` (high to low, may be negative)."""
    names, shift = [], sum(_DIGIT_BITS)
    out = df.withColumn("_key", order_key(F.col(value)))
    for i, bits in enumerate(_DIGIT_BITS):
        shift -= bits
        digit = F.shiftright(F.col("_key"), shift)
        # Arithmetic shift keeps the order below zero too; lower digits are taken modulo.
        if i:
            digit = F.pmod(digit, F.lit(2**bits).cast("bigint"))
        out = out.withColumn(f"_d{i}", digit)
        names.append(f"_d{i}")
    return out.drop("_key"), names


def running_sums(
    df: DataFrame, value: str, sums: dict[str, str], groups: list[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Running totals of ``sums`` (column -> output name) over distinct ``value``, per group.

    ``df`` holds one row per (group, value), i.e. is pre-aggregated. Ties are thus one row.
    """
    groups = groups or []
    keyed, digits = with_digits(df, value)
    levels = [keyed]
    for depth in range(len(digits) - 1, 0, -1):
        levels.insert(
            0,
            levels[0]
            .groupBy(*groups, *digits[:depth])
            .agg(*[F.sum(c).alias(c) for c in sums]),
        )
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    offsets: DataFrame | None = None
    for depth, level in enumerate(levels):
        last = depth == len(levels) - 1
        cell = groups + digits[:depth]
        sort = order(value) if last else order(digits[depth])
        window = Window.partitionBy(*cell).orderBy(sort)
        inside = {
            c: F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, 0)) for c in sums
        }
        level = level.select("*", *[inside[c].alias(f"_run_{c}") for c in sums])
        if offsets is not None:
            level = _join_offsets(level, offsets, cell)
            level = level.select(
                *[c for c in level.columns if not c.startswith(("_off_", "_run_"))],
                *[(F.col(f"_run_{c}") + F.col(f"_off_{c}")).alias(f"_run_{c}") for c in sums],
            )
        if not last:
            # What lies before this cell is the offset of everything inside it.
            offsets = level.select(
                *cell, digits[depth], *[(F.col(f"_run_{c}") - F.col(c)).alias(f"_off_{c}") for c in sums]
            )
        else:
            offsets = level
    return offsets.select(
        *[c for c in df.columns], *[F.col(f"_run_{c}").alias(name) for c, name in sums.items()]
    )


def _join_offsets(level: DataFrame, offsets: DataFrame, cell: list[str]) -> DataFrame:
    # Null-safe, since a group may be NULL.
    renamed = offsets.select(
        *[F.col(c).alias(f"_o_{c}") for c in cell],
        *[c for c in offsets.columns if c.startswith("_off_")],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in cell])
    return level.join(renamed, same, "inner").drop(*[f"_o_{c}" for c in cell])


def value_at_fraction(
    df: DataFrame, value: str, fraction: float = 0.95, groups: list[str] | None = None,
    alias: str = "p95", weight: str | None = None,
) -> DataFrame:
    """Per group the value at 0-based index ``int(n * fraction)`` of the sorted non-null values.

    Neither interpolated nor ``percentile_disc``: of 20 values the 0.95 one is the largest.
    ``weight`` names a column saying how many rows a row stands for.
    """
    groups = groups or []
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    )
    keyed, digits = with_digits(counts, value)
    # Walk down the digits, each time keeping only the cell that holds the wanted index.
    chosen: DataFrame | None = None
    for depth in range(len(digits)):
        cell = groups + digits[:depth]
        level = keyed if chosen is None else _in_chosen(keyed, chosen, cell)
        extra = [] if chosen is None else ["_left"]
        level = level.groupBy(*cell, *extra, digits[depth]).agg(F.sum("_n").alias("_n"))
        window = Window.partitionBy(*cell).orderBy(digits[depth])
        upto = F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, 0))
        if chosen is None:
            total = F.sum("_n").over(Window.partitionBy(*cell))
            wanted = F.floor(total * F.lit(float(fraction)))
        else:
            wanted = F.col("_left")
        chosen = (
            level.select("*", upto.alias("_upto"), wanted.alias("_wanted"))
            .filter((F.col("_upto") > F.col("_wanted")) & (F.col("_upto") - F.col("_n") <= F.col("_wanted")))
            .select(*cell, digits[depth], (F.col("_wanted") - (F.col("_upto") - F.col("_n"))).alias("_left"))
        )
    # All digits fixed: the cell is one value.
    hit = _in_chosen(keyed, chosen, groups + digits)
    # Reading _n here too makes this branch's counts the same as those above, so Spark computes them once.
    return hit.filter(F.col("_n").isNotNull()).select(*groups, F.col(value).alias(alias))


def _in_chosen(keyed: DataFrame, chosen: DataFrame, cell: list[str]) -> DataFrame:
    if not cell:
        return keyed
    renamed = chosen.select(*[F.col(c).alias(f"_c_{c}") for c in cell], "_left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in cell])
    return keyed.join(renamed, same, "inner").drop(*[f"_c_{c}" for c in cell])


def stratified_folds(
    df: DataFrame, label: str, key: str, n_folds: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Fold 0..n-1 per row, fold sizes of a label differing by one at most.

    Rows are shuffled by a seeded digest of their unique key. The rank inside a label is summed up
    from 65 536 digest cells, so a label holding most rows is still spread over all tasks.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    keyed = df.withColumn("_digest", digest).withColumn("_cell", F.substring("_digest", 1, 4))
    cells = keyed.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        F.col(label).alias("_label"),
        F.col("_cell").alias("_off_cell"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(label, "_cell").orderBy("_digest", key)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(
        offsets, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_cell") == F.col("_off_cell"))
    )
    fold = F.pmod(F.col("_before") + F.col("_rank"), F.lit(n_folds).cast("bigint")).cast("int")
    return joined.withColumn(out, fold).select(*df.columns, out)


def spread_positions(df: DataFrame, groups: list[str], out: str = "position", group_rows: int = GROUP_ROWS) -> DataFrame:
    """0-based position of every row inside its group, in the order of a digest of the whole row.

    The order says nothing, but numbers are without gaps, so a group can be cut into parts of bounded size.
    Positions in groups of more than ``group_rows`` rows are summed up from 65 536 digest cells, so a group holding
    most rows is still spread over all tasks; one window numbers any other group, in the same order. Equal rows get
    numbers in any order. Groups are counted when this is called.
    """
    keyed = df.withColumn("_digest", F.xxhash64(*df.columns))
    keyed = keyed.withColumn("_cell", F.pmod("_digest", F.lit(65_536)))
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > group_rows)
    # A row per so many rows at most.
    large = materialised(sizes.select(*[F.col(g).alias(f"_l_{g}") for g in groups]), "large-groups")
    is_large = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_l_{g}")) for g in groups])
    if large.isEmpty():
        return _numbered(keyed, groups).select(*df.columns, F.col("_inside").cast("bigint").alias(out))
    rest = _numbered(keyed.join(large, is_large, "left_anti"), groups)
    spread = _spread(keyed.join(large, is_large, "left_semi"), groups)
    both = rest.withColumn("_before", F.lit(0).cast("bigint")).unionByName(spread)
    return both.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))


def _numbered(keyed: DataFrame, groups: list[str]) -> DataFrame:
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy("_cell", "_digest")) - 1
    return keyed.withColumn("_inside", inside)


def _spread(keyed: DataFrame, groups: list[str]) -> DataFrame:
    counts = keyed.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy("_digest")) - 1
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups], F.col("_cell") == F.col("_c"))
    joined = keyed.withColumn("_inside", inside).join(offsets, same)
    return joined.select(*keyed.columns, "_inside", "_before")
