"""Long result tables, the covariate table and the final analytic table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewise import lookups
from zonewise.functions import ids
from zonewise.functions.columns import clean_names, rename_by_pattern
from zonewise.functions.numeric import zero_fill
from zonewise.operators.coverage import filter_covered
from zonewise.operators.covariates import left_reduce
from zonewise.operators.reshape import contaminant_group, parse_measure, to_long, with_state


def _labelled(long: DataFrame, keep_ungrouped: bool) -> DataFrame:
    labelled = parse_measure(long).withColumn("contaminant_group", contaminant_group(F.col("contaminant")))
    labelled = labelled.drop("measures")
    return labelled if keep_ungrouped else labelled.where(F.col("contaminant_group") != lookups.UNGROUPED)


def tract_long(exposure: DataFrame, values: Sequence[str], keep_ungrouped: bool = False) -> DataFrame:
    """Weighted tract values, one row per contaminant and statistic, with labels."""
    long = to_long(exposure.select("tract_geoid", *values), ["tract_geoid"])
    long = long.withColumn("st_fips", ids.state_of(F.col("tract_geoid")))
    return with_state(_labelled(long, keep_ungrouped))


def system_long(
    table: DataFrame, values: Sequence[str], states: DataFrame, system: str = "pwsid",
    missing_as_zero: bool = False, keep_ungrouped: bool = False,
) -> DataFrame:
    """System values, one row per contaminant and statistic, with labels.

    ``states`` holds one row (system, st_fips, ...) per system.
    """
    chosen = table.select(system, *values)
    if missing_as_zero:
        chosen = zero_fill(chosen)
    placed = chosen.join(states, system, "left")
    long = to_long(placed, [system, *(c for c in states.columns if c != system)], values)
    return with_state(_labelled(long, keep_ungrouped))


def covariate_table(
    tract_tables: Mapping[str, DataFrame],
    keys: Mapping[str, str],
    county: DataFrame | None = None,
    county_key: str = "GEOID10",
    drop: Sequence[str] = (),
    drop_types: Sequence[str] = ("water", "special_land_use"),
) -> DataFrame:
    """Tract covariates on the first table's tracts, then county covariates."""
    joined = left_reduce(tract_tables, keys, drop=drop).withColumn(
        "co_geoid", ids.county_of(F.col("tract_geoid"))
    )
    if county is not None:
        joined = joined.join(county.withColumnRenamed(county_key, "co_geoid"), "co_geoid", "left")
    return joined.where(~ids.tract_type(F.col("tract_geoid")).isin(*drop_types))


def final_analytic(
    exposure: DataFrame,
    covariates: DataFrame,
    threshold: float = 0.5,
    drop_types: Sequence[str] = ("special_land_use",),
) -> DataFrame:
    """Covered tracts with their covariates, under the published column names."""
    kept = filter_covered(exposure, threshold).where(
        ~ids.tract_type(F.col("tract_geoid")).isin(*drop_types)
    )
    joined = clean_names(kept.join(covariates, "tract_geoid", "left"))
    return rename_by_pattern(joined, lookups.FINAL_RENAMES)
