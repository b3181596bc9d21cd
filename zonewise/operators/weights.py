"""From overlay rows to population weights.

Columns follow one naming scheme throughout: ``geoid`` (small zone), ``pwsid``
(service system), ``tract_geoid`` (reporting zone), ``overlap_area``,
``zone_area``, ``value`` (zone population). Every name is an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.functions import ids
from zonewise.functions.numeric import ratio
from zonewise.operators.scale import attach_totals


def eligible_systems(measures: DataFrame, overlay: DataFrame, system: str = "pwsid") -> DataFrame:
    """Distinct systems that have measurements and appear in the overlay."""
    # distinct first: both sides shrink before the exchange of the semi join
    return measures.select(system).distinct().join(overlay.select(system).distinct(), system, "left_semi")


def only_eligible(overlay: DataFrame, measures: DataFrame, system: str = "pwsid") -> DataFrame:
    """Overlay rows of systems with measurements, so others do not inflate denominators."""
    return overlay.join(measures.select(system).where(F.col(system).isNotNull()), system, "left_semi")


def dedupe_pairs(
    overlay: DataFrame,
    zone: str = "geoid",
    system: str = "pwsid",
    overlap: str = "overlap_area",
    constants: Sequence[str] = ("value", "zone_area"),
) -> DataFrame:
    """One row per (zone, system): overlaps added, zone attributes kept once."""
    return overlay.groupBy(zone, system).agg(
        F.sum(overlap).alias(overlap), *(F.max(c).alias(c) for c in constants)
    )


def capped_weight(weight: Column, weight_sum: Column) -> Column:
    """Scale down to a total of 1, but only where the total is over 1."""
    return F.when(weight_sum > 1, weight / weight_sum).otherwise(weight)


def areal_weights(
    pairs: DataFrame,
    zone: str = "geoid",
    overlap: str = "overlap_area",
    zone_area: str = "zone_area",
    value: str = "value",
) -> DataFrame:
    """Add ``wgt``, ``wgt_sum``, ``wgt_normalized`` and ``bg_wgt_pop`` to each pair."""
    # Areas are added before dividing: a zone exactly filled then sums to exactly 1.
    weighted = pairs.withColumn("wgt", ratio(F.col(overlap), F.col(zone_area)))
    return (
        attach_totals(weighted, [zone], wgt_sum=F.sum(overlap))
        .withColumn("wgt_sum", ratio(F.col("wgt_sum"), F.col(zone_area)))
        .withColumn("wgt_normalized", capped_weight(F.col("wgt"), F.col("wgt_sum")))
        .withColumn("bg_wgt_pop", F.col(value) * F.col("wgt_normalized"))
    )


def rollup(
    weighted: DataFrame,
    zone: str = "geoid",
    system: str = "pwsid",
    value: str = "value",
    population: str = "bg_wgt_pop",
    to: Column | None = None,
    attributes: DataFrame | None = None,
) -> DataFrame:
    """Served population per (tract, system); pairs serving nobody are dropped.

    ``attributes`` (tract_geoid, system, ...) is reduced to one row per pair
    before it is joined, so repeated pairs cannot multiply rows.
    """
    target = ids.tract_of(F.col(zone)) if to is None else to
    rolled = (
        weighted.groupBy(target.alias("tract_geoid"), system)
        .agg(F.sum(population).alias("bg_wgt_pop"), F.sum(value).alias("total_unwgt_pop"))
        .where(F.col("bg_wgt_pop") != 0)
    )
    if attributes is None:
        return rolled
    keys = ["tract_geoid", system]
    extra = [c for c in attributes.columns if c not in keys]
    return rolled.join(attributes.groupBy(*keys).agg(*(F.max(c).alias(c) for c in extra)), keys, "left")


def served_population(overlay: DataFrame, measures: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Overlay rows + measured systems -> served population per (tract, system)."""
    pairs = dedupe_pairs(only_eligible(overlay, measures))
    return rollup(areal_weights(pairs), attributes=attributes)


def pop_by(served: DataFrame, key: str, count_as: str, pop_as: str) -> DataFrame:
    return served.groupBy(key).agg(
        F.count(F.lit(1)).alias(count_as), F.sum("bg_wgt_pop").alias(pop_as)
    )


def pop_by_tract(served: DataFrame) -> DataFrame:
    return pop_by(served, "tract_geoid", "n_pws", "ct_pop_pws")


def pop_by_system(served: DataFrame, system: str = "pwsid") -> DataFrame:
    return pop_by(served, system, "n_tracts", "pws_total_pop")


def pair_shares(served: DataFrame, zone_totals: DataFrame, digits: int = 2) -> DataFrame:
    """Each pair's share of its tract's population and of the tract's served population.

    ``zone_totals`` holds (tract_geoid, tract_total_pop).
    """
    by_tract = attach_totals(
        served, ["tract_geoid"], n_pws=F.count(F.lit(1)), ct_pop_pws=F.sum("bg_wgt_pop")
    )
    return by_tract.join(zone_totals, "tract_geoid", "left").withColumns(
        {
            "pws_ct_total_prop": ratio(F.col("bg_wgt_pop"), F.col("tract_total_pop"), digits),
            "pws_ct_pwsarea_prop": ratio(F.col("bg_wgt_pop"), F.col("ct_pop_pws"), digits),
        }
    )


def population_weight(served: DataFrame, by: str, measured: DataFrame | None = None, system: str = "pwsid") -> DataFrame:
    """Each pair's share of the served population of its ``by`` group.

    Joining ``measured`` may repeat a pair; shares are then scaled back to a total
    of 1. Adds ``served_total``, ``pop_weight_sum`` and ``population_weight``.
    """
    fan = F.lit(1)
    if measured is not None:
        repeats = measured.groupBy(system).agg(F.count(F.lit(1)).alias("__fan"))
        served = served.join(repeats, system, "left")
        fan = F.coalesce(F.col("__fan"), F.lit(1))
    shares = attach_totals(
        served,
        [by],
        served_total=F.sum("bg_wgt_pop"),
        __fanned=F.sum(F.col("bg_wgt_pop") * fan),
    )
    share = ratio(F.col("bg_wgt_pop"), F.col("served_total"))
    shares = (
        shares.withColumn("pop_weight_sum", ratio(F.col("__fanned"), F.col("served_total")))
        .withColumn("population_weight", capped_weight(share, F.col("pop_weight_sum")))
        .drop("__fan", "__fanned")
    )
    return shares if measured is None else shares.join(measured, system, "left")


def coverage(served_pop: Column, total_pop: Column, digits: int = 3) -> Column:
    return ratio(served_pop, total_pop, digits)


def legacy_cap(pairs: DataFrame, zone_totals: DataFrame) -> DataFrame:
    """The earlier method: uncapped weights, tract total clipped to its population."""
    raw = pairs.withColumn("bg_wgt_pop", F.col("value") * ratio(F.col("overlap_area"), F.col("zone_area")))
    by_tract = pop_by_tract(rollup(raw))
    return by_tract.join(zone_totals, "tract_geoid", "left").withColumns(
        {
            "ct_pop_pws_relevel": F.least("ct_pop_pws", "tract_total_pop"),
            "diff": F.col("ct_pop_pws") - F.col("tract_total_pop"),
        }
    )


def allocate(
    counts: DataFrame,
    crosswalk: DataFrame,
    measures: Sequence[str],
    source: str,
    target: str,
    weight: str = "weight",
) -> DataFrame:
    """Re-express source-zone counts on target zones: sum of count x weight.

    ``counts`` has one row per source zone.
    """
    joined = crosswalk.select(source, target, weight).join(counts.select(source, *measures), source)
    return joined.groupBy(target).agg(*(F.sum(F.col(m) * F.col(weight)).alias(m) for m in measures))
