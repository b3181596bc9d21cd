"""Exact grouped quantiles without holding a group in one task.

The built-in exact percentile keeps every distinct value of a group in one buffer.
Here values are counted first (combining on the map side). A value's leading
significant digits name its cell; a group has a bounded number of cells, so a
running count over them is cheap and tells which cell holds the wanted rank. Only
the values of that cell are kept, then cut again by further digits, and the few
left are put in order. A group whose key is NULL is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewise.operators.scale import join_groups

# Significant digits of the successive cells: at most 100,000 cells per power of ten on either level. Doubles that
# share ten digits are some millions at most, so what is left to order is bounded too.
DIGITS = (5, 10)
SMALLEST_POWER, LARGEST_POWER = -300, 308


def _cell(value: Column, digits: int) -> Column:
    """Integer that never decreases as ``value`` grows: its power of ten and first digits.

    Every step is monotone in floating point, so cells keep the order of values.
    """
    size = F.abs(value)
    finite = F.when(F.isnan(value) | (size == float("inf")), None).otherwise(size)
    power = F.greatest(F.floor(F.log10(finite)), F.lit(SMALLEST_POWER))
    step = 10 ** digits
    lead = F.least(F.floor(finite / F.pow(F.lit(10.0), power) * (step // 10)), F.lit(step - 1))
    rank = (power - SMALLEST_POWER + 1) * step + lead
    beyond = F.lit((LARGEST_POWER - SMALLEST_POWER + 3) * step).cast("bigint")
    return (
        F.when(F.isnan(value), beyond + 1)
        .when(value == 0, F.lit(0).cast("bigint"))
        .otherwise(F.signum(value).cast("bigint") * F.coalesce(rank.cast("bigint"), beyond))
    )


def _running(df: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """Rows before (``__before``) and up to (``__upto``) each counted row of its group."""
    window = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__upto", F.sum("__n").over(window)).withColumn(
        "__before", F.col("__upto") - F.col("__n")
    )


def _wanted(probs: dict[str, float], size: Column) -> Column:
    """The ranks on both sides of each quantile, with the way between them."""
    wanted = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (size - 1)
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            wanted.append(
                F.struct(
                    F.lit(name).alias("q"),
                    F.lit(side).alias("side"),
                    (at - F.floor(at)).alias("share"),
                    rank.cast("bigint").alias("rank"),
                )
            )
    return F.array(*wanted)


def _reached() -> Column:
    return (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__upto"))


def _meet(rows: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with each of the wanted ranks of their group, a few per group."""
    return join_groups(rows, targets, groups, "inner")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    digits: Sequence[int] = DIGITS,
) -> DataFrame:
    """One row per key with the quantiles named in ``probs``.

    Linear interpolation between neighbouring values, NULLs skipped, as the exact
    percentile has it. Groups with no value are absent.
    """
    keys = list(keys)
    candidates = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    if not keys:  # one group holding every row
        candidates, keys = candidates.withColumn("__all", F.lit(0)), ["__all"]

    cells = [f"__cell{level}" for level in range(len(digits))]
    candidates = candidates.withColumns(
        {cell: _cell(F.col("__v"), count) for cell, count in zip(cells, digits, strict=True)}
    )
    # Counted once by the cells of all levels; upper levels are sums of that table.
    counted = candidates.groupBy(*keys, *cells).agg(F.sum("__n").alias("__n"))
    targets = None
    for level, cell in enumerate(cells):
        groups, table = keys + cells[:level], counted
        if level < len(cells) - 1:
            table = counted.groupBy(*groups, cell).agg(F.sum("__n").alias("__n"))
        if targets is None:
            placed = _running(table, groups, cell).withColumn(
                "__size", F.sum("__n").over(Window.partitionBy(*groups))
            )
            inside = placed.withColumn("__t", F.explode(_wanted(probs, F.col("__size"))))
            inside = inside.withColumn("__rank", F.col("__t.rank"))
        else:
            inside = _running(_meet(table, targets, groups), [*groups, "__t"], cell)
        targets = inside.where(_reached()).select(
            *groups, cell, "__t", (F.col("__rank") - F.col("__before")).alias("__rank")
        )
    groups = keys + cells
    found = _running(_meet(candidates, targets, groups), [*groups, "__t"], "__v").where(_reached())
    picked = []
    for name in probs:
        here = F.col("__t.q") == name
        low = F.max(F.when(here & (F.col("__t.side") == "low"), F.col("__v")))
        high = F.max(F.when(here & (F.col("__t.side") == "high"), F.col("__v")))
        share = F.max(F.when(here, F.col("__t.share")))
        picked.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return found.groupBy(*keys).agg(*picked).drop("__all")


def exact_medians(df: DataFrame, keys: Sequence[str], medians: dict[str, str]) -> DataFrame:
    """Medians of several columns in one pass: ``{output: input column}``. A group without values has NULL."""
    keys = list(keys)
    values = F.array(
        *(F.struct(F.lit(out).alias("m"), F.col(src).cast("double").alias("v")) for out, src in medians.items())
    )
    long = df.select(*keys, F.explode(values).alias("__m")).select(
        *keys, F.col("__m.m").alias("__out"), F.col("__m.v").alias("__val")
    )
    tall = exact_quantiles(long, [*keys, "__out"], "__val", {"__median": 0.5})
    found = tall.groupBy(*keys).agg(
        *(F.max(F.when(F.col("__out") == out, F.col("__median"))).alias(out) for out in medians)
    )
    # Without keys the aggregation has its one row anyhow.
    return join_groups(df.select(*keys).distinct(), found, keys) if keys else found
