"""Exposure tables: measurements of systems rolled up to tracts and to systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from zonewise.functions.columns import cols
from zonewise.functions.numeric import ratio
from zonewise.operators import weights
from zonewise.operators.aggregate import across, any_detect, weighted_sum

DETECT = "_detectpws"
FAN = "__fan"


def measure_columns(measures: DataFrame, system: str = "pwsid") -> tuple[list[str], list[str]]:
    """(concentration columns, detection flag columns) by name pattern."""
    flags = cols(measures, ends_with=DETECT)
    return cols(measures, exclude=[system, *cols(measures, contains="_detect")]), flags


def _one_row_per_system(
    measures: DataFrame, values: Sequence[str], flags: Sequence[str], system: str
) -> DataFrame:
    """Repeats of a system are added up, and counted so that shares can be scaled back."""
    return measures.groupBy(system).agg(
        *across(values, F.sum), *across(flags, any_detect), F.count(F.lit(1)).alias(FAN)
    )


def audit_metrics() -> list[Column]:
    """Figures over weighted pairs: how many zones' weights are capped, what that takes away, and what is left out."""
    over = F.col("wgt_sum") > 1
    return [
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(over).alias("n_capped"),
        F.max("wgt_sum").alias("max_wgt_sum"),
        F.sum(F.when(over, F.col("value") * F.col("wgt"))).alias("pop_uncapped"),
        F.sum(F.when(over, F.col("bg_wgt_pop"))).alias("pop_capped"),
        F.sum("bg_wgt_pop").alias("pop_served"),
        F.count_if(F.col("bg_wgt_pop").isNull()).alias("n_unweighted"),
    ]


def write_served_population(
    overlay: DataFrame, measures: DataFrame, path: str, attributes: DataFrame | None = None
) -> tuple[DataFrame, dict]:
    """Write the served population per (tract, system), and audit its weights in the same pass.

    Returns the table as written, and the figures of ``audit_metrics`` over the pairs that went into it. No second scan reads
    the overlay. Figures of a task that had to run again are counted again: repeat the write where executors were lost.
    """
    watch = Observation()
    pairs = weights.dedupe_pairs(weights.only_eligible(overlay, measures))
    weighted = weights.areal_weights(pairs).observe(watch, *audit_metrics())
    served = weights.rollup(weighted, attributes=attributes)
    served.write.mode("overwrite").parquet(path)
    return overlay.sparkSession.read.schema(served.schema).parquet(path), watch.get


def tract_exposure(
    served: DataFrame,
    measures: DataFrame,
    zone_totals: DataFrame | None = None,
    values: Sequence[str] | None = None,
    flags: Sequence[str] | None = None,
    system: str = "pwsid",
    count_as: str = "n_pws_ucmr",
    served_as: str = "ct_pop_pws",
    renormalize: bool = False,
    digits: int = 9,
) -> DataFrame:
    """Population-weighted measurements, detection flags and coverage per tract.

    A system's weight is its share of the tract's served population, so the
    weighted mean is sum(value * served) / sum(served): one aggregation, with no
    per-group pass to normalise shares first. Systems without a value keep their
    share of the denominator unless ``renormalize`` is set.

    ``zone_totals`` holds (tract_geoid, tract_total_pop); without it the coverage
    columns are left out.
    """
    found_values, found_flags = measure_columns(measures, system)
    values = list(found_values if values is None else values)
    flags = list(found_flags if flags is None else flags)
    per_system = _one_row_per_system(measures, values, flags, system)
    served = served.select("tract_geoid", system, "bg_wgt_pop")
    rows = served.join(per_system, system, "left")
    fan = F.coalesce(F.col(FAN), F.lit(1))
    whole = F.sum(F.col("bg_wgt_pop") * fan)

    def mean(value):
        base = F.sum(F.when(value.isNotNull(), F.col("bg_wgt_pop") * fan)) if renormalize else whole
        return F.round(F.try_divide(F.sum(value * F.col("bg_wgt_pop")), base), digits)

    by_tract = rows.groupBy("tract_geoid").agg(
        *across(values, mean, "{col}_weighted"),
        F.count(F.lit(1)).alias(count_as),
        F.sum("bg_wgt_pop").alias(served_as),
        *across(flags, any_detect),
    )
    if zone_totals is None:
        return by_tract
    return by_tract.join(zone_totals, "tract_geoid", "left").withColumns(
        {
            "pws_coverage_proportion": weights.coverage(F.col(served_as), F.col("tract_total_pop")),
            "prop_no_pws": 1 - weights.coverage(F.col(served_as), F.col("tract_total_pop")),
        }
    )


def capture_rate(
    served: DataFrame, published: DataFrame, system: str = "pwsid", threshold: float = 0.1
) -> DataFrame:
    """Interpolated population against the published one, with an inclusion flag.

    ``published`` holds (system, population_served_count), one row per system.
    """
    rate = ratio(F.col("served_pop"), F.col("population_served_count"))
    return (
        served.groupBy(system)
        .agg(F.sum("bg_wgt_pop").alias("served_pop"))
        .join(published, system, "left")
        .withColumn("capture_rate", rate)
        .withColumn(
            "inclusion_flag",
            F.when(F.col("capture_rate") >= threshold, "yes").when(F.col("capture_rate").isNotNull(), "no"),
        )
    )


def system_exposure(
    served: DataFrame,
    measures: DataFrame,
    published: DataFrame,
    values: Sequence[str] | None = None,
    flags: Sequence[str] | None = None,
    system: str = "pwsid",
    digits: int = 9,
) -> DataFrame:
    """Measurements weighted over the tracts a system serves, per system.

    Each (tract, system) weighs in with its capped share of the system's served population; a system without
    any value sums to 0. The flags of repeated measurement rows are combined.
    """
    found_values, found_flags = measure_columns(measures, system)
    values = list(found_values if values is None else values)
    flags = list(found_flags if flags is None else flags)
    weighted = weights.population_weight(
        served.select("tract_geoid", system, "bg_wgt_pop"), system, measures.select(system, *values)
    )

    def total(value):
        return weighted_sum(value * F.col("population_weight"), digits, zero_fill=True)

    sums = weighted.groupBy(system).agg(*across(values, total, "{col}_weighted_sum"))
    covered = capture_rate(served, published, system)
    summed = sums.join(covered, system).select(
        system,
        *(f"{v}_weighted_sum" for v in values),
        "served_pop",
        "population_served_count",
        "capture_rate",
        "inclusion_flag",
    )
    if not flags:
        return summed
    return summed.join(measures.groupBy(system).agg(*across(flags, any_detect)), system, "left")


def review_exposure(served: DataFrame, medians: DataFrame, system: str = "pwsid") -> DataFrame:
    """Tract exposure from harmonised review medians, under its own column names."""
    return tract_exposure(
        served,
        medians,
        values=cols(medians, ends_with="_fin_median"),
        flags=cols(medians, ends_with="_detect_flag"),
        system=system,
        count_as="n_pws_syr",
        served_as="ct_pop_pws_syr",
    )
