"""Weights, exposure tables and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.views import Views, with_views
from zonewise.operators import checks, weights
from zonewise.operators.aggregate import any_detect, strict_max
from zonewise.plans import exposure
from zonewise.session import checkpoint_folder


def served(v: Views) -> DataFrame:
    return weights.served_population(v.bg_pws(), v.measures())


def pairs(v: Views) -> DataFrame:
    return weights.dedupe_pairs(weights.only_eligible(v.bg_pws(), v.measures()))


def tract_table(v: Views) -> DataFrame:
    return exposure.tract_exposure(served(v), v.measures(), v.tract())


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def settled(df: DataFrame, **digits: int) -> DataFrame:
    """Round with a nudge, for values that often lie halfway: the last bits of a sum
    depend on its order, and must not decide."""
    return df.withColumns({c: F.round(F.col(c) + 10.0 ** -(d + 3), d) for c, d in digits.items()})


def sql_settled(columns: str, **digits: int) -> str:
    return ", ".join([columns] * bool(columns) + [f"round({c} + 1e-{d + 3}, {d}) as {c}" for c, d in digits.items()])


def sql_rounded(columns: str, **digits: int) -> str:
    return ", ".join([columns] * bool(columns) + [f"round({c}, {d}) as {c}" for c, d in digits.items()])


EXPOSURE_DIGITS = dict(
    dcpa_medpws_weighted=6, dcpa_maxpws_weighted=6, pfoa_35_medpws_weighted=6, ct_pop_pws=4,
    tract_total_pop=2, pws_coverage_proportion=3, prop_no_pws=3,
)
EXPOSURE_SQL = "select " + sql_rounded(
    "tract_geoid, n_pws_ucmr, dcpa_detectpws, pfoa_35_detectpws", **EXPOSURE_DIGITS
) + " from exposure"


def tract_exposure_wide(v: Views) -> DataFrame:
    return rounded(tract_table(v), **EXPOSURE_DIGITS)


def areal_weights(v: Views) -> DataFrame:
    out = weights.areal_weights(pairs(v))
    return settled(
        out.select("geoid", "pwsid", "wgt", "wgt_sum", "wgt_normalized", "bg_wgt_pop"),
        wgt=6, wgt_sum=6, wgt_normalized=6, bg_wgt_pop=4,
    )


def weight_audit(v: Views) -> DataFrame:
    out = checks.weight_audit(pairs(v)).select(
        "geoid", "pwsid", "value", "wgt", "wgt_sum", "wgt_normalized", "bg_wgt_pop", "bg_wgt_norm_pop"
    )
    return settled(out, value=4, wgt=4, wgt_sum=4, wgt_normalized=6, bg_wgt_pop=4, bg_wgt_norm_pop=4)


def written_audit(v: Views) -> DataFrame:
    """Audit figures observed while the served population is written, beside totals of the table as written."""
    path = f"{checkpoint_folder(v.spark)}/served-{uuid.uuid4().hex[:12]}"
    table, figures = exposure.write_served_population(v.bg_pws(), v.measures(), path)
    totals = table.agg(F.count(F.lit(1)).alias("n_written"), F.sum("bg_wgt_pop").alias("pop_written"))
    out = totals.withColumns({name: F.lit(value) for name, value in figures.items()})
    return rounded(out, max_wgt_sum=6, pop_uncapped=1, pop_capped=1, pop_served=1, pop_written=1)


def legacy_cap(v: Views) -> DataFrame:
    out = weights.legacy_cap(pairs(v), v.tract())
    return rounded(out, ct_pop_pws=4, tract_total_pop=2, ct_pop_pws_relevel=4, diff=4)


def population_weight(v: Views, by: str) -> DataFrame:
    out = weights.population_weight(served(v), by, v.measures())
    return rounded(
        out.select("tract_geoid", "pwsid", "served_total", "pop_weight_sum", "population_weight"),
        served_total=4, pop_weight_sum=6, population_weight=6,
    )


def population_weight_capped(v: Views) -> DataFrame:
    """Some systems measured twice: their shares add up to more than 1 and are scaled back."""
    m = v.measures().select("pwsid", "dcpa_medpws")
    twice = m.unionByName(m.where(F.col("pwsid").rlike("[13579]$")))
    out = weights.population_weight(served(v), "tract_geoid", twice)
    return rounded(
        out.select("tract_geoid", "pwsid", "served_total", "pop_weight_sum", "population_weight"),
        served_total=4, pop_weight_sum=6, population_weight=6,
    )


def pair_shares(v: Views) -> DataFrame:
    out = weights.pair_shares(served(v), v.tract(), digits=12)
    out = settled(out, pws_ct_total_prop=6, pws_ct_pwsarea_prop=6)
    return settled(out, bg_wgt_pop=4, ct_pop_pws=4, tract_total_pop=2).drop("total_unwgt_pop")


def any_detect_by_system(v: Views, strict: bool) -> DataFrame:
    return v.samples().groupBy("pwsid", "analyte", "review").agg(
        any_detect(F.col("detect"), strict).alias("detect_flag")
    )


def strict_max_by_system(v: Views) -> DataFrame:
    return v.samples().groupBy("pwsid", "analyte", "review").agg(
        strict_max(F.col("detect")).alias("detect_max"), strict_max(F.col("value")).alias("value_max")
    )


def system_exposure_wide(v: Views) -> DataFrame:
    out = exposure.system_exposure(served(v), v.measures(), v.published())
    return rounded(
        out, dcpa_medpws_weighted_sum=6, dcpa_maxpws_weighted_sum=6, pfoa_35_medpws_weighted_sum=6,
        served_pop=3, capture_rate=6,
    )


def capture_rate(v: Views) -> DataFrame:
    return rounded(exposure.capture_rate(served(v), v.published()), served_pop=3, capture_rate=6)


def excess_check(v: Views) -> DataFrame:
    raw = weights.legacy_cap(pairs(v), v.tract())
    return settled(checks.excess(raw), max_diff=3, median_diff=4)


def crosswalk_allocate(v: Views) -> DataFrame:
    """Order totals (source zones) allocated to suppliers by share of quantity."""
    lines = v.table("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_quantity") / 100).alias("weight"))
    counts = v.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("pop"))
    return rounded(weights.allocate(counts, lines, ["pop"], "l_orderkey", "l_suppkey"), pop=2)


QUERIES = {
    "tract_exposure_wide": tract_exposure_wide,
    "areal_weights": areal_weights,
    "weight_audit": weight_audit,
    "written_audit": written_audit,
    "legacy_cap": legacy_cap,
    "eligible_systems": lambda v: weights.eligible_systems(v.measures(), v.bg_pws()),
    "dedupe_pairs": pairs,
    "served_population": lambda v: settled(served(v), bg_wgt_pop=4, total_unwgt_pop=2),
    "pop_by_tract": lambda v: rounded(weights.pop_by_tract(served(v)), ct_pop_pws=4),
    "pop_by_system": lambda v: rounded(weights.pop_by_system(served(v)), pws_total_pop=3),
    "pair_shares": pair_shares,
    "population_weight_tract": lambda v: population_weight(v, "tract_geoid"),
    "population_weight_system": lambda v: population_weight(v, "pwsid"),
    "any_detect": lambda v: any_detect_by_system(v, False),
    "population_weight_capped": population_weight_capped,
    "any_detect_strict": lambda v: any_detect_by_system(v, True),
    "strict_max": strict_max_by_system,
    "system_exposure_wide": system_exposure_wide,
    "capture_rate": capture_rate,
    "excess_check": excess_check,
    "crosswalk_allocate": crosswalk_allocate,
}

LEGACY = """
select tract_geoid, n_pws, ct_pop_pws, tract_total_pop, least(ct_pop_pws, tract_total_pop) as ct_pop_pws_relevel,
       ct_pop_pws - tract_total_pop as diff
from (select tract_geoid, count(*) as n_pws, sum(pop) as ct_pop_pws from (
        select substr(geoid, 1, 11) as tract_geoid, pwsid, sum(value * overlap_area / zone_area) as pop
        from pairs group by 1, 2 having sum(value * overlap_area / zone_area) <> 0) group by 1)
left join (select tract_geoid, tract_total_pop from tract) using (tract_geoid)"""

CAPTURE = """
select pwsid, served_pop, population_served_count, served_pop / population_served_count as capture_rate,
       case when served_pop / population_served_count >= 0.1 then 'yes'
            when population_served_count is not null then 'no' end as inclusion_flag
from (select pwsid, sum(bg_wgt_pop) as served_pop from served group by 1) left join published using (pwsid)"""

FLAG_KEYS = "pwsid, analyte, review"


def _weight_sql(by: str) -> str:
    return with_views(f"""
select tract_geoid, pwsid, round(t, 4) as served_total, round(s, 6) as pop_weight_sum,
       round(case when s > 1 then share / s else share end, 6) as population_weight
from (select *, sum(share) over (partition by {by}) as s
      from (select *, bg_wgt_pop / t as share
            from (select *, sum(bg_wgt_pop) over (partition by {by}) as t from served)))""")


ORACLES = {
    "tract_exposure_wide": with_views(EXPOSURE_SQL),
    "areal_weights": with_views("select geoid, pwsid, " + sql_settled(
        "", wgt=6, wgt_sum=6, wgt_normalized=6, bg_wgt_pop=4) + " from weighted"),
    "weight_audit": with_views("""
select geoid, pwsid, round(value + 1e-7, 4) as value, round(wgt + 1e-7, 4) as wgt, round(wgt_sum + 1e-7, 4) as wgt_sum,
       round(wgt_normalized + 1e-9, 6) as wgt_normalized, round(value * wgt + 1e-7, 4) as bg_wgt_pop,
       round(bg_wgt_pop + 1e-7, 4) as bg_wgt_norm_pop
from weighted where wgt_sum > 1"""),
    "written_audit": with_views("""
select n_written, round(pop_written, 1) as pop_written, n_pairs, n_capped, round(max_wgt_sum, 6) as max_wgt_sum,
       round(pop_uncapped, 1) as pop_uncapped, round(pop_capped, 1) as pop_capped, round(pop_served, 1) as pop_served, n_unweighted
from (select count(*) as n_written, sum(bg_wgt_pop) as pop_written from served),
     (select count(*) as n_pairs, count(*) filter (wgt_sum > 1) as n_capped, max(wgt_sum) as max_wgt_sum,
             sum(value * wgt) filter (wgt_sum > 1) as pop_uncapped, sum(bg_wgt_pop) filter (wgt_sum > 1) as pop_capped,
             sum(bg_wgt_pop) as pop_served, count(*) - count(bg_wgt_pop) as n_unweighted from weighted)"""),
    "legacy_cap": with_views("select " + sql_rounded(
        "tract_geoid, n_pws", ct_pop_pws=4, tract_total_pop=2, ct_pop_pws_relevel=4, diff=4) + " from legacy",
        legacy=LEGACY),
    "eligible_systems": with_views("select pwsid from measures where pwsid in (select pwsid from bg_pws)"),
    "dedupe_pairs": with_views("select * from pairs"),
    "served_population": with_views("select " + sql_settled(
        "tract_geoid, pwsid", bg_wgt_pop=4, total_unwgt_pop=2) + " from served"),
    "pop_by_tract": with_views("select tract_geoid, n_pws, round(ct_pop_pws, 4) as ct_pop_pws from tract_pop"),
    "pop_by_system": with_views(
        "select pwsid, count(*) as n_tracts, round(sum(bg_wgt_pop), 3) as pws_total_pop from served group by 1"),
    "pair_shares": with_views("""
select tract_geoid, pwsid, round(bg_wgt_pop + 1e-7, 4) as bg_wgt_pop, n_pws, round(ct_pop_pws + 1e-7, 4) as ct_pop_pws,
       round(tract_total_pop + 1e-5, 2) as tract_total_pop, round(bg_wgt_pop / tract_total_pop + 1e-9, 6) as pws_ct_total_prop,
       round(bg_wgt_pop / ct_pop_pws + 1e-9, 6) as pws_ct_pwsarea_prop
from served join tract_pop using (tract_geoid)
left join (select tract_geoid, tract_total_pop from tract) using (tract_geoid)"""),
    "population_weight_tract": _weight_sql("tract_geoid"),
    "population_weight_system": _weight_sql("pwsid"),
    "any_detect": with_views(f"""
select {FLAG_KEYS}, case when count(detect) = 0 then null when sum(case when detect = 1 then 1 else 0 end) > 0
       then 1.0::double else 0.0::double end as detect_flag from samples group by all"""),
    "any_detect_strict": with_views(f"""
select {FLAG_KEYS}, case when sum(case when detect = 1 then 1 else 0 end) > 0 then 1.0::double
       when count(detect) < count(*) then null else 0.0::double end as detect_flag from samples group by all"""),
    "strict_max": with_views(f"""
select {FLAG_KEYS}, case when count(detect) = count(*) then max(detect) end as detect_max,
       case when count(value) = count(*) then max(value) end as value_max from samples group by all"""),
    "system_exposure_wide": with_views("""
select pwsid, round(round(coalesce(a, 0), 9), 6) as dcpa_medpws_weighted_sum,
       round(round(coalesce(b, 0), 9), 6) as dcpa_maxpws_weighted_sum,
       round(round(coalesce(c, 0), 9), 6) as pfoa_35_medpws_weighted_sum,
       round(served_pop, 3) as served_pop, population_served_count, round(capture_rate, 6) as capture_rate,
       inclusion_flag, dcpa_detectpws, pfoa_35_detectpws
from capture left join sums using (pwsid) left join measures using (pwsid)""", capture=CAPTURE, sums="""
select pwsid, sum(dcpa_medpws * share) as a, sum(dcpa_maxpws * share) as b, sum(pfoa_35_medpws * share) as c
from (select *, bg_wgt_pop / sum(bg_wgt_pop) over (partition by pwsid) as share from served) left join measures using (pwsid)
group by 1"""),
    "population_weight_capped": with_views("""
select tract_geoid, pwsid, round(t, 4) as served_total, round(f / t, 6) as pop_weight_sum,
       round(bg_wgt_pop / t / greatest(f / t, 1), 6) as population_weight
from (select *, sum(bg_wgt_pop) over (partition by tract_geoid) as t,
             sum(bg_wgt_pop * fan) over (partition by tract_geoid) as f
      from served join (select pwsid, count(*) as fan from twice group by 1) using (pwsid))
join twice using (pwsid)""", twice="""
select pwsid from measures union all select pwsid from measures where regexp_matches(pwsid, '[13579]$')"""),
    "capture_rate": with_views("select " + sql_rounded(
        "pwsid, population_served_count, inclusion_flag", served_pop=3, capture_rate=6) + " from capture",
        capture=CAPTURE),
    "excess_check": with_views("""
select count(*) as n_total, count(*) filter (diff < 1e-6) as n_fp_noise,
       count(*) filter (diff >= 1e-6) as n_real_excess, round(max(diff) + 1e-6, 3) as max_diff,
       round(median(diff) + 1e-7, 4) as median_diff
from legacy where ct_pop_pws > tract_total_pop""", legacy=LEGACY),
    "crosswalk_allocate": """
select l_suppkey, round(sum(o_totalprice * l_quantity / 100), 2) as pop
from lineitem join orders on l_orderkey = o_orderkey group by 1""",
}
