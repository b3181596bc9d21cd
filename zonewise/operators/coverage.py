"""How much of the population the estimates cover, by state, round and system type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.functions import ids
from zonewise.functions.numeric import ratio
from zonewise.operators.reshape import round_of, to_long


def filter_covered(exposure: DataFrame, threshold: float = 0.5, column: str = "pws_coverage_proportion") -> DataFrame:
    return exposure.where(F.col(column) >= threshold)


def by_state(geoid: str = "tract_geoid") -> Column:
    return ids.state_of(F.col(geoid)).alias("st_fips")


def retention(exposure: DataFrame, keep: Column) -> DataFrame:
    """Per state: rows before and after a filter, and the share kept, in one pass."""
    counted = exposure.groupBy(by_state()).agg(
        F.count(F.lit(1)).alias("n_og"), F.count_if(keep).alias("n_post_filter")
    )
    return counted.withColumn("pct_included", ratio(F.col("n_post_filter"), F.col("n_og")))


def reference_totals(zones: Sequence[DataFrame], geoid: str = "tract_geoid", value: str = "tract_total_pop") -> DataFrame:
    """Population and zone count by state over the regional zone tables."""
    every = zones[0].select(geoid, value)
    for z in zones[1:]:
        every = every.unionByName(z.select(geoid, value))
    return every.groupBy(by_state(geoid)).agg(F.sum(value).alias("ref_pop"), F.count(F.lit(1)).alias("n_actual"))


def with_arms(
    exposure: DataFrame, served: DataFrame, systems: DataFrame, arms: Sequence[str], system: str = "pwsid"
) -> DataFrame:
    """Mark the tracts served by at least one system of each arm.

    ``systems`` holds (system, arm...) with one boolean column per arm. All arms
    share one join and one aggregation.
    """
    marked = served.select("tract_geoid", system).join(systems.select(system, *arms), system)
    per_tract = marked.groupBy("tract_geoid").agg(*(F.bool_or(a).alias(a) for a in arms))
    return exposure.join(per_tract, "tract_geoid", "left")


def arm_totals(exposure: DataFrame, arms: Sequence[str] = (), threshold: float = 0.1) -> DataFrame:
    """Served and total population by state of covered tracts, in all and per arm."""

    def totals(member: Column, suffix: str) -> list[Column]:
        return [
            F.sum(F.when(member, F.col("ct_pop_pws"))).alias(f"pop_in_pws{suffix}"),
            F.sum(F.when(member, F.col("tract_total_pop"))).alias(f"tract_int_tot_pop{suffix}"),
            F.nullif(F.count_if(member), F.lit(0)).alias(f"n_tracts_joined{suffix}"),
        ]

    columns = totals(F.lit(True), "")
    for arm in arms:
        columns += totals(F.col(arm), f"_{arm}")
    return filter_covered(exposure, threshold).groupBy(by_state()).agg(*columns)


def _ratios(arms: Sequence[str]) -> dict[str, Column]:
    main = F.col("pop_in_pws")
    ratios = {"main_cov": ratio(main, F.col("ref_pop"))}
    for arm in arms:
        part = F.col(f"pop_in_pws_{arm}")
        ratios[f"cov_{arm}"] = ratio(part, F.col("ref_pop"))
        ratios[f"cov_of_main_{arm}"] = ratio(part, main)
    return ratios


def compare(reference: DataFrame, totals: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Main coverage, and each arm's coverage against the reference and against main."""
    return reference.join(totals, "st_fips", "left").withColumns(_ratios(arms))


def grid(spine: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Every distinct row of ``spine`` with each of the given (few) ``values``."""
    return spine.distinct().withColumn(column, F.explode(F.array(*(F.lit(v) for v in values))))


def by_round(exposure: DataFrame, flags: Sequence[str], arms: Sequence[str] = ()) -> DataFrame:
    """Served population by (state, measurement round) of tracts with any known flag.

    The rounds of one tract are found in its own row, so tracts are neither
    unpivoted into the shuffle nor deduplicated there. ``arms`` names boolean
    columns to total apart.
    """
    rounds = F.array_distinct(
        F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), round_of(F.lit(f))) for f in flags)))
    )
    served = F.col("ct_pop_pws")
    return (
        exposure.select(by_state(), F.explode(rounds).alias("round"), "ct_pop_pws", *arms)
        .groupBy("st_fips", "round")
        .agg(
            F.sum(served).alias("pop_in_pws"),
            *(F.sum(F.when(F.col(a), served)).alias(f"pop_in_pws_{a}") for a in arms),
        )
    )


def round_coverage(reference: DataFrame, rounds: Sequence[str], totals: DataFrame, arms: Sequence[str]) -> DataFrame:
    """``by_round`` totals on the full (state, round) grid; gaps are 0."""
    table = grid(reference.select("st_fips", "ref_pop"), "round", rounds).join(totals, ["st_fips", "round"], "left")
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in ("pop_in_pws", *(f"pop_in_pws_{a}" for a in arms))}
    ratios = _ratios(arms)
    for arm in arms:
        ratios[f"cov_of_main_{arm}"] = F.when(F.col("pop_in_pws") > 0, ratios[f"cov_of_main_{arm}"])
    return table.withColumns(filled).withColumns(ratios)


def by_agency_type(
    master: DataFrame,
    boundaries: DataFrame,
    sampled: Mapping[str, DataFrame],
    keys: Sequence[str] = ("agency", "type_code"),
    population: str = "population",
    system: str = "pwsid",
) -> DataFrame:
    """Population of sampled systems against the master list, by agency and type.

    ``boundaries`` holds (system, boundary_pop); ``sampled`` maps a name to the
    systems with a sample of it. Groups without samples get a ratio of 0.
    """
    keys = list(keys)
    result = master.groupBy(*keys).agg(F.sum(population).alias("ref_pop"))
    located = boundaries.join(master.select(system, *keys), system, "left")
    for name, systems in sampled.items():
        covered = (
            located.join(systems.select(system), system, "left_semi")
            .groupBy(*keys)
            .agg(F.sum("boundary_pop").alias(f"{name}_pop_coverage"))
        )
        result = result.join(covered, keys, "left").withColumn(
            f"{name}_pop_comp",
            F.coalesce(ratio(F.col(f"{name}_pop_coverage"), F.col("ref_pop")), F.lit(0.0)),
        )
    return result


def flags_long(exposure: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Known flags in long form with their round: (ids..., flag, hit, round)."""
    ids_kept = [c for c in exposure.columns if c not in set(flags)]
    long = to_long(exposure, ids_kept, list(flags), "flag", "hit", drop_null=True)
    return long.withColumn("round", round_of(F.col("flag")))
