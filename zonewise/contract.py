"""The column contract of the final table, and what a table violates of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from zonewise.lookups import ROUNDS


@dataclass(frozen=True)
class Field:
    """A declared column. Kinds: id (of so many digits), text, number, integer, share (0 to 1) and flag (0, 1 or missing)."""

    name: str
    kind: str
    digits: int = 0
    key: bool = False


# Stems whose measurements are sums over a class, with the statistics that are kept of them.
SUMS = {
    "pfasany_3": ["med", "max"], "pfasany_5": ["med", "max"], "pfasany_5t": ["med", "max"],
    "pfospfoa_3": ["max"], "pfospfoa_5": ["max"],
}
# Stems without a detection flag.
UNFLAGGED = ["pfospfoa_3", "pfospfoa_5"]
# The columns that belong to no contaminant, by kind.
OTHERS = {
    "id": [("tract_geoid", 11), ("co_geoid", 5), ("statefp10", 2)],
    "text": ["name", "gisjoin", "county_name_clean"],
    "integer": ["n_cws_ucmr", "race_total_e", "n_cws_syr"],
    "number": [
        "tract_total_pop", "ct_pop_cws", "medhhinc", "aland10", "pop_density_sqkm", "tree_can", "ndvi_max", "ndvi_mean",
        "ndvi_median", "nobs_mean", "mean_pm25_value", "mean_pm25_sd", "arsenic_fin_median_weighted",
        "tthm_fin_median_weighted", "ct_pop_cws_syr", "smoking_prev", "smoking_prev_lower", "smoking_prev_upper",
    ],
    "share": [
        "cws_coverage_proportion", "prop_no_cws", "race_whitenh", "race_blacknh", "race_asiannh", "race_hisp",
        "race_multiplenh", "race_othernh", "pov_allage", "pct_hsplus",
    ],
    "flag": ["arsenic_detect_flag", "tthm_detect_flag"],
}


def final_fields() -> list[Field]:
    """The declared columns: each contaminant's weighted median, maximum and detection flag, then the others."""
    stems = [stem.lower() for own in ROUNDS.values() for stem in own]
    plain = [s for s in stems if s not in SUMS]
    out = [Field(f"{s}_{stat}cws_weighted", "number") for s in plain for stat in ("med", "max")]
    out += [Field(f"{s}_sumcws{stat}_weighted", "number") for s, stats in SUMS.items() for stat in stats]
    out += [Field(f"{s}_detectcws", "flag") for s in stems if s not in UNFLAGGED]
    for kind, names in OTHERS.items():
        if kind == "id":
            out += [Field(name, "id", digits, key=name == "tract_geoid") for name, digits in names]
        else:
            out += [Field(name, kind) for name in names]
    return out


def _breach(field: Field) -> Column | None:
    """Whether a value, where there is one, breaks the rule of its kind."""
    value = F.col(f"`{field.name}`")
    if field.kind == "id":
        return ~value.rlike(f"^[0-9]{{{field.digits}}}$")
    if field.kind == "integer":
        return value != F.floor(value)
    if field.kind == "share":
        return ~value.between(0, 1)
    return ~value.isin(0, 1) if field.kind == "flag" else None


def _fits(field: Field, data_type) -> bool:
    return isinstance(data_type, StringType if field.kind in ("id", "text") else NumericType)


def violations(df: DataFrame, fields: Sequence[Field], partial: bool = False) -> DataFrame:
    """(column, rule, n): how many rows break each rule, zeros included.

    Rules about columns (``missing``, ``undeclared``, ``type``) count 1 where broken; ``partial`` allows missing ones. Rules
    about rows are counted in one pass: ``malformed`` values, and for key columns ``null`` ones and ``repeated`` keys.
    """
    spark, types = df.sparkSession, {f.name: f.dataType for f in df.schema.fields}
    declared = {f.name: f for f in fields}
    broken = [] if partial else [(f.name, "missing") for f in fields if f.name not in types]
    broken += [(name, "undeclared") for name in types if name not in declared]
    broken += [(f.name, "type") for f in fields if f.name in types and not _fits(f, types[f.name])]
    sound = [f for f in fields if f.name in types and _fits(f, types[f.name])]
    rules = [(f.name, "malformed", _breach(f)) for f in sound if _breach(f) is not None]
    keys = [f.name for f in sound if f.key]
    rules += [(k, "null", F.col(k).isNull()) for k in keys]
    parts = [spark.createDataFrame([(c, r, 1) for c, r in broken], "column string, rule string, n bigint")]
    if rules:
        counted = df.agg(F.array(*(F.count_if(rule).alias(f"n{i}") for i, (_, _, rule) in enumerate(rules))).alias("n"))
        names = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule")) for c, r, _ in rules))
        each = counted.select(F.explode(F.arrays_zip(names.alias("of"), F.col("n").alias("n"))).alias("z"))
        parts.append(each.select("z.of.column", "z.of.rule", "z.n"))
    if keys:
        again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        repeated = again.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
        parts.append(repeated.select(F.lit(",".join(keys)).alias("column"), F.lit("repeated").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts)
