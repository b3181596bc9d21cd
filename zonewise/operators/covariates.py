"""Cleaning covariate tables and joining them to zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewise.functions import text
from zonewise.functions.numeric import density_per_km2, ratio, sum_of
from zonewise.operators.scale import join_groups

# Bits of an ordinal per level of blocks: no window has more than 2^21 rows, whatever the ordinals.
FILL_BITS = 21

# Census table variables, by the short names used here.
RACE_SHARES = {
    "RACE_WHITENH": ["race_whitenhE"],
    "RACE_BLACKNH": ["race_blacknhE"],
    "RACE_ASIANNH": ["race_asiannhE"],
    "RACE_HISP": ["race_hispE"],
    "RACE_MULTIPLENH": ["race_multinhE"],
    "RACE_OTHERNH": ["race_aiannhE", "race_nhpinhE", "race_othernhE"],
}
SCHOOLING = ["hsged", "sc1", "sc2", "assoc", "bach", "mast", "prof", "doct"]


def full_reduce(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of all frames; the key of either side survives."""
    return reduce(lambda a, b: a.join(b, [key], "full"), frames)


def left_reduce(
    frames: Mapping[str, DataFrame], keys: Mapping[str, str], key: str = "tract_geoid", drop: Sequence[str] = ()
) -> DataFrame:
    """Left join every frame to the first one.

    ``keys`` says what each frame calls the key. Columns in ``drop``, and columns
    a previous frame already brought, are left out.
    """
    joined: DataFrame | None = None
    for name, frame in frames.items():
        aligned = frame.withColumnRenamed(keys[name], key).drop(*drop)
        if joined is None:
            joined = aligned
            continue
        fresh = [c for c in aligned.columns if c not in joined.columns]
        joined = joined.join(aligned.select(key, *fresh), key, "left")
    if joined is None:
        raise ValueError("no frames given")
    return joined


def period_mean(df: DataFrame, key: str, means: Mapping[str, str]) -> DataFrame:
    """Average of a series per key: ``{output: input column}``; text is cast."""
    return df.groupBy(key).agg(
        *(F.avg(F.col(f"`{c}`").try_cast("double")).alias(out) for out, c in means.items())
    )


def fill_down(df: DataFrame, column: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Replace NULL by the last value above it, in the order of a non-negative integer column.

    Ordinals are cut into blocks by their higher bits, on two levels. The last value of each block is found by
    aggregation and carried over the blocks of its parent, so every window is bounded. Rows that share an
    ordinal share its value (the largest of them) where their own is NULL.
    """
    within = list(within)
    at = F.col(order).cast("bigint")
    ordinals = df.groupBy(*within, at.alias("__at")).agg(F.max(column).alias("__own"))
    ordinals = ordinals.withColumns(
        {"__b1": F.shiftright("__at", FILL_BITS), "__b2": F.shiftright("__at", 2 * FILL_BITS)}
    )
    last = F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("__at"))).alias("__last")

    def carried(blocks: DataFrame, parents: Sequence[str], block: str, name: str) -> DataFrame:
        earlier = Window.partitionBy(*parents).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.withColumn(name, F.last("__last", ignorenulls=True).over(earlier)).drop("__last")

    upper = carried(ordinals.groupBy(*within, "__b2").agg(last), within, "__b2", "__from2")
    middle = carried(ordinals.groupBy(*within, "__b2", "__b1").agg(last), [*within, "__b2"], "__b1", "__from1")
    inside = Window.partitionBy(*within, "__b2", "__b1").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    found = ordinals.withColumn("__here", F.last("__own", ignorenulls=True).over(inside))
    found = join_groups(found, middle, [*within, "__b2", "__b1"])
    found = join_groups(found, upper, [*within, "__b2"])
    filled = found.select(*within, "__at", F.coalesce("__here", "__from1", "__from2").alias("__filled"))
    rows = join_groups(df.withColumn("__at", at), filled, [*within, "__at"])
    return rows.withColumn(column, F.coalesce(column, "__filled")).select(*df.columns)


def parse_interval(df: DataFrame, source: str, name: str) -> DataFrame:
    """``"23.1 (22.0,24.2)"`` -> point, lower and upper columns."""
    names = [name, f"{name}_lower", f"{name}_upper"]
    return df.withColumns(dict(zip(names, text.interval_parts(F.col(source)), strict=True)))


def split_entities(df: DataFrame, column: str, part: str = "county_part", delimiter: str = "/") -> DataFrame:
    """One row per entity of a combined name, each with the values of the whole.

    The trailing state code is taken before splitting, so every part has it.
    """
    pieces = df.withColumn("state_abb", text.trailing_state(F.col(column))).select(
        "*", F.posexplode(F.split(F.col(column), delimiter)).alias("part_no", part)
    )
    return pieces.withColumn("name_clean", text.place_name(F.col(part), F.col("state_abb")))


def demographics(acs: DataFrame, areas: DataFrame, geoid: str = "GEOID", area_geoid: str = "GEOID10") -> DataFrame:
    """Census counts -> race shares, poverty, income, schooling and density per tract."""
    shares = {
        out: ratio(sum_of([F.col(c) for c in cols]), F.col("race_totalE")) for out, cols in RACE_SHARES.items()
    }
    schooled = [F.col(f"edu_{sex}_{level}E") for sex in ("m", "f") for level in SCHOOLING]
    derived = {
        **shares,
        "POV_ALLAGE": ratio(F.col("pov_belowE"), F.col("pov_totalE")),
        "MEDHHINC": F.col("medhhincE"),
        "PCT_HSPLUS": ratio(sum_of(schooled), F.col("edu_totalE")),
    }
    named = [c for c in ("NAME",) if c in acs.columns]
    measures = acs.select(geoid, *named, "race_totalE", *(e.alias(n) for n, e in derived.items()))
    land = areas.select(F.col(area_geoid).alias(geoid), "ALAND10")
    return measures.join(land, geoid, "left").withColumn(
        "POP_DENSITY_SQKM", density_per_km2(F.col("race_totalE"), F.col("ALAND10"))
    )
