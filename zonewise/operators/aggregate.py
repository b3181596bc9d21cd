"""Aggregate expressions that treat missing values the way exposure tables need."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def across(
    names: Iterable[str], fn: Callable[[Column], Column], template: str = "{col}"
) -> list[Column]:
    """One aliased expression per column, all meant for a single ``agg``/``select``."""
    return [fn(F.col(f"`{n}`")).alias(template.format(col=n)) for n in names]


def weighted_sum(values: Column, digits: int = 9, zero_fill: bool = False) -> Column:
    """Sum of the non-NULL values; NULL, or 0 with ``zero_fill``, when there are none."""
    total = F.sum(values)
    return F.round(F.coalesce(total, F.lit(0.0)) if zero_fill else total, digits)


def any_detect(flag: Column, strict: bool = False) -> Column:
    """1 if any flag is 1, else 0; NULL when undecided.

    Undecided means no flag known, or under ``strict`` at least one unknown.
    """
    if not strict:
        return F.max(F.when(flag == 1, 1.0).when(flag.isNotNull(), 0.0))
    hit = F.max(F.when(flag == 1, 1).otherwise(0))
    known = F.count(flag) == F.count(F.lit(1))
    return F.when(hit == 1, F.lit(1.0)).when(known, F.lit(0.0))


def if_complete(values: Column, aggregated: Column) -> Column:
    """``aggregated`` only where no value is NULL."""
    return F.when(F.count(values) == F.count(F.lit(1)), aggregated)


def strict_max(values: Column) -> Column:
    return if_complete(values, F.max(values))


def strict_sum(values: Column) -> Column:
    return if_complete(values, F.sum(values))


def n_distinct(values: Column, count_null: bool = False) -> Column:
    """Distinct values; ``count_null`` counts NULL as one more value."""
    known = F.count_distinct(values)
    if not count_null:
        return known
    return known + F.coalesce(F.max(values.isNull().cast("int")), F.lit(0)).cast("bigint")
