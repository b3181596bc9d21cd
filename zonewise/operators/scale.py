"""Group totals that stay balanced when one key holds many of the rows.

A window would send a whole group to one task. Totals are aggregated instead, which combines on the
map side, and joined back; adaptive execution splits a hot key's rows over several tasks and copies
its single row of totals to each. There is one plan for every input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of all keys, NULL being equal to NULL."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)))


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add the columns of ``groups``, which has one row per key, to ``rows``. NULL keys match NULL keys.

    Columns keep the order of ``rows``, followed by those of ``groups``.
    """
    names = list(keys)
    renamed = groups.withColumnsRenamed({k: f"__g_{k}" for k in names})
    on = same_keys([rows[k] for k in names], [renamed[f"__g_{k}"] for k in names])
    return rows.join(renamed, on, how).drop(*(f"__g_{k}" for k in names))


def attach_totals(rows: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Add group aggregates to every row. NULL forms a group of its own."""
    names = list(keys)
    grouped = rows.groupBy(*names).agg(*(total.alias(name) for name, total in totals.items()))
    return join_groups(rows, grouped, names, "inner")
