"""Reconciliation of sources and audits of the weighting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewise.functions.numeric import ratio
from zonewise.operators.aggregate import if_complete, n_distinct
from zonewise.operators.quantiles import exact_medians, exact_quantiles
from zonewise.operators.scale import attach_totals, join_groups
from zonewise.operators.weights import areal_weights
from zonewise.session import cut_lineage


def any_not_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with a value in at least one of the columns."""
    return df.where(F.coalesce(*(F.col(f"`{n}`") for n in names)).isNotNull())


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str], null_matches: bool = False) -> DataFrame:
    """Rows of ``left`` with no partner; ``null_matches`` lets NULL keys pair up."""
    keys = list(on)
    if not null_matches:
        return left.join(right.select(*keys), keys, "left_anti")
    other = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"__r_{k}"])
    return left.join(other, same, "left_anti")


def distinct_counts(df: DataFrame, names: Sequence[str], count_null: bool = False) -> DataFrame:
    return df.agg(*(n_distinct(F.col(n), count_null).alias(f"n_{n}") for n in names))


def tabyl(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value with their share of all rows and of all known rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    known = counts.agg(F.sum(F.when(F.col(column).isNotNull(), F.col("n")))).scalar()
    return counts.select(
        column,
        "n",
        ratio(F.col("n"), whole).alias("percent"),
        F.when(F.col(column).isNotNull(), ratio(F.col("n"), known)).alias("valid_percent"),
    )


def get_dupes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once, with the number of occurrences."""
    return attach_totals(df, keys, dupe_count=F.count(F.lit(1))).where(F.col("dupe_count") > 1)


def distinct_keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First whole row of each key in ascending order (which should break all ties).

    A negated number puts large values first. An aggregation rather than a ranking window: it combines on the map side.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__first")).select(
        *keys, *(F.col(f"__first.`{c}`").alias(c) for c in rest)
    ).select(*df.columns)


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Leading rows; ``order`` should end with a unique column."""
    return df.orderBy(*order).limit(k)


def weight_audit(pairs: DataFrame) -> DataFrame:
    """Pairs of zones whose weights exceed 1, with populations before and after capping."""
    over = areal_weights(pairs).where(F.col("wgt_sum") > 1).withColumnRenamed("bg_wgt_pop", "bg_wgt_norm_pop")
    return over.withColumn("bg_wgt_pop", F.col("value") * F.col("wgt"))


def excess(
    df: DataFrame, served: str = "ct_pop_pws", total: str = "tract_total_pop", noise: float = 1e-6
) -> DataFrame:
    """How many rows serve more people than live there, and by how much.

    Excess below ``noise`` is counted apart: it comes from floating point.
    """
    over = df.where(F.col(served) > F.col(total)).select((F.col(served) - F.col(total)).alias("diff"))
    counted = over.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("diff") < noise).alias("n_fp_noise"),
        F.count_if(F.col("diff") >= noise).alias("n_real_excess"),
        F.max("diff").alias("max_diff"),
    )
    middle = exact_quantiles(over, [], "diff", {"median_diff": 0.5}).agg(F.max("median_diff")).scalar()
    return counted.withColumn("median_diff", middle)


def share_with_data(systems: DataFrame, measured: DataFrame, system: str = "pwsid") -> DataFrame:
    """How many systems have measurements, and which share of all rows that is."""
    listed = systems.agg(F.count(F.lit(1))).scalar()
    with_data = systems.select(system).join(measured.select(system), system, "left_semi")
    return with_data.agg(F.count_distinct(system).alias("systems_with_data")).withColumns(
        {"systems": listed, "prop_with_data": ratio(F.col("systems_with_data"), listed)}
    )


def distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """Spread of per-key medians: min, quartiles, mean, max and missing count.

    A key with any missing value has no median.
    """
    complete = df.groupBy(key).agg(if_complete(F.col(value), F.lit(True)).alias("complete"))
    medians = join_groups(complete, exact_medians(df, [key], {"med": value}), [key]).select(
        key, F.when(F.col("complete"), F.col("med")).alias("med")
    )
    medians = cut_lineage(medians)  # used four times below
    quartiles = exact_quantiles(medians, [], "med", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = medians.agg(
        F.min("med").alias("min"),
        F.avg("med").alias("mean"),
        F.max("med").alias("max"),
        F.count_if(F.col("med").isNull()).alias("n_missing"),
    )
    cells = quartiles.agg(F.struct(*(F.max(q).alias(q) for q in ("q1", "median", "q3")))).scalar()
    return spread.withColumn("q", cells).select("min", "q.q1", "q.median", "mean", "q.q3", "max", "n_missing")


def reconcile(
    measures: DataFrame, boundaries: DataFrame, master: DataFrame, rounds: Mapping[str, Sequence[str]],
    system: str = "pwsid",
) -> DataFrame:
    """Per measurement round and activity code: systems, and those without a boundary.

    ``rounds`` maps a round to its measure columns. Rounds of a system are found
    in its own row, so all rounds share one join and one aggregation.
    """
    present = [
        F.when(F.coalesce(*(F.col(f"`{c}`") for c in cols)).isNotNull(), F.lit(name))
        for name, cols in rounds.items()
    ]
    in_rounds = measures.select(system, F.explode(F.array_compact(F.array(*present))).alias("round"))
    placed = boundaries.select(system).distinct().withColumn("bounded", F.lit(True))
    return (
        in_rounds.join(master.select(system, "activity_code"), system, "left")
        .join(placed, system, "left")
        .groupBy("round", "activity_code")
        .agg(
            F.count(F.lit(1)).alias("n_systems"),
            F.count_if(F.col("bounded").isNull()).alias("n_no_boundary"),
        )
    )
