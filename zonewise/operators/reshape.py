"""Wide to long, long to wide, and the labels of long exposure tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise import lookups


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    names_to: str = "measures",
    values_to: str = "value",
    drop_null: bool = False,
) -> DataFrame:
    chosen = [c for c in df.columns if c not in set(ids)] if values is None else list(values)
    long = df.unpivot(list(ids), chosen, names_to, values_to)
    return long.where(F.col(values_to).isNotNull()) if drop_null else long


def to_wide(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, names: Sequence[str]) -> DataFrame:
    """One column per name; the names are given, so no pass is spent finding them."""
    return df.groupBy(*ids).pivot(names_from, list(names)).agg(F.max(values_from))


def parse_measure(long: DataFrame, measures: str = "measures") -> DataFrame:
    """Split ``pfoa_35_medpws_weighted`` into ``contaminant`` and ``stat_clean``.

    The digits after the first underscore belong to the contaminant's name.
    """
    glued = F.regexp_replace(F.col(measures), r"^([a-zA-Z]+)_(\d+)", "$1$2")
    stat = F.split_part("__glued", F.lit("_"), F.lit(2))
    return long.withColumn("__glued", glued).withColumns(
        {
            "contaminant": F.split_part("__glued", F.lit("_"), F.lit(1)),
            "stat_clean": F.when(stat == "detectpws", "detect_level")
            .when(stat.contains("max"), "max")
            .otherwise("median"),
        }
    ).drop("__glued")


def group_of(value: Column, groups: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """The label whose list holds ``value``."""
    expr = F.lit(default)
    for label, members in reversed(list(groups.items())):
        expr = F.when(value.isin(*members), label).otherwise(expr)
    return expr


def contaminant_group(contaminant: Column) -> Column:
    return group_of(contaminant, lookups.CONTAMINANT_GROUPS, lookups.UNGROUPED)


def first_rule(text: Column, rules: Iterable[tuple[str, str]], default: str | None) -> Column:
    """The label of the first regex found in ``text``."""
    expr = F.lit(default)
    for pattern, label in reversed(list(rules)):
        expr = F.when(text.rlike(pattern), label).otherwise(expr)
    return expr


def round_of(flag: Column, suffix: str = "_detectpws") -> Column:
    """Measurement round of a detection flag column name."""
    at = F.length(flag) - len(suffix)
    stem = F.when(F.endswith(flag, F.lit(suffix)), F.substr(flag, F.lit(1), at)).otherwise(flag)
    return recode(stem, lookups.ROUND_OF, lookups.OTHER_ROUND)


def recode(value: Column, labels: Mapping, default=None) -> Column:
    expr = F.lit(default)
    for code, label in reversed(list(labels.items())):
        expr = F.when(value == code, label).otherwise(expr)
    return expr


def with_state(df: DataFrame, fips: str = "st_fips") -> DataFrame:
    """Add state postal code and name; codes that are no state keep NULLs."""
    crosswalk = lookups.states(df.sparkSession).withColumnRenamed("state_fips", fips)
    return df.join(F.broadcast(crosswalk), fips, "left")  # 51 rows


def dominant_state(overlay: DataFrame, zone: str = "geoid", system: str = "pwsid") -> DataFrame:
    """(system, st_fips, n_states): the state holding most of a system's overlap."""
    per_state = overlay.groupBy(system, F.substring(zone, 1, 2).alias("st_fips")).agg(
        F.sum("overlap_area").alias("area")
    )
    return per_state.groupBy(system).agg(
        F.max(F.struct("area", "st_fips"))["st_fips"].alias("st_fips"),
        F.count(F.lit(1)).alias("n_states"),
    )
