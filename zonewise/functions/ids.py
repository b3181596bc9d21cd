"""Geographic identifiers. They are strings throughout: leading zeros matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACT_DIGITS = 11
COUNTY_DIGITS = 5
STATE_DIGITS = 2


def tract_of(geoid: Column) -> Column:
    return F.substring(geoid, 1, TRACT_DIGITS)


def county_of(geoid: Column) -> Column:
    return F.substring(geoid, 1, COUNTY_DIGITS)


def state_of(geoid: Column) -> Column:
    """State digits of a zone id, or the agency letters of a system id."""
    return F.substring(geoid, 1, STATE_DIGITS)


def in_state(geoid: Column, state: str) -> Column:
    """Prefix predicate; unlike ``substring(...) = s`` it reaches the Parquet scan."""
    return geoid.startswith(state)


def pad_geoid(geoid: Column, width: int = TRACT_DIGITS) -> Column:
    """Left-pad with zeros; ids already long enough are left whole."""
    text = geoid.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def gisjoin_to_geoid(gisjoin: Column) -> Column:
    """``G`` SS ``0`` CCC ``0`` TTTTTT -> SSCCCTTTTTT."""
    return F.concat(
        F.substring(gisjoin, 2, 2), F.substring(gisjoin, 5, 3), F.substring(gisjoin, 9, 6)
    )


def tract_code(tract_geoid: Column) -> Column:
    return F.substring(tract_geoid, 6, 6).try_cast("int")


def tract_type(tract_geoid: Column) -> Column:
    """Census numbering: which kind of tract an id denotes."""
    code = tract_code(tract_geoid)
    # The census tract code ranges.
    return (
        F.when(code.between(990000, 999800), "water")
        .when(code.between(980000, 989999), "special_land_use")
        .when(code.between(940000, 949999), "american_indian_area")
        .otherwise("standard")
    )
