"""Row-wise numeric expressions. A zero divisor gives NULL, never an error."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.functions.columns import any_of, numeric_cols


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if digits is None else F.round(value, digits)


def sum_of(columns: Iterable[Column]) -> Column:
    """Row-wise sum; one NULL makes the sum NULL."""
    return reduce(add, columns)


def density_per_km2(count: Column, area_m2: Column) -> Column:
    return ratio(count, area_m2.cast("double") / F.lit(1e6))


def substitute_nondetect(value: Column, detection_limit: Column) -> Column:
    """A missing reading becomes limit/sqrt(2); a missing limit counts as zero."""
    return F.coalesce(value, detection_limit_or_zero(detection_limit) / F.sqrt(F.lit(2.0)))


def detection_limit_or_zero(detection_limit: Column) -> Column:
    return F.coalesce(detection_limit, F.lit(0.0))


def row_median(*columns: Column) -> Column:
    """Median of the non-NULL values in one row; NULL when there are none."""
    present = F.array_sort(F.array_compact(F.array(*columns)))
    n = F.size(present)
    lower = F.try_element_at(present, F.floor((n + 1) / 2).cast("int"))
    upper = F.try_element_at(present, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def row_max(df: DataFrame, names: Iterable[str]) -> Column:
    """Largest non-NULL value among those of ``names`` that exist in ``df``."""
    present = [F.col(n) for n in any_of(df, names)]
    if not present:
        return F.lit(None).cast("double")
    return present[0] if len(present) == 1 else F.greatest(*present)


def round_numeric(df: DataFrame, digits: int, exclude: Iterable[str] = ()) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in numeric_cols(df, exclude)})


def zero_fill(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """NULL -> 0 in every numeric column."""
    names = numeric_cols(df, exclude)
    return df.fillna(0, subset=names) if names else df
