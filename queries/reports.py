"""Long tables, coverage reports, reconciliation and identifier checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.reviews import STITCH, medians
from queries.views import Views, with_views
from queries.weighting import (
    EXPOSURE_DIGITS, rounded, served, settled, sql_rounded, sql_settled, tract_table,
)
from zonewise import lookups
from zonewise.functions import ids
from zonewise.functions.columns import cols, rename_by_pattern, tag_by_stem
from zonewise.functions.numeric import round_numeric, zero_fill
from zonewise.operators import checks, coverage, overlay, reshape
from zonewise.operators.quantiles import exact_medians
from zonewise.plans import exposure, tables
from zonewise.session import cut_lineage

FLAGS = ["dcpa_detectpws", "pfoa_35_detectpws"]
VALUES = ["dcpa_medpws_weighted", "dcpa_maxpws_weighted", "pfoa_35_medpws_weighted"]


# Long tables ---------------------------------------------------------------


def to_long_labelled(v: Views) -> DataFrame:
    return rounded(tables.tract_long(tract_table(v), VALUES), value=6)


def system_long(v: Views) -> DataFrame:
    states = reshape.dominant_state(v.bg_pws())
    values = [c for c in v.measures().columns if c != "pwsid"]
    return rounded(tables.system_long(v.measures(), values, states, missing_as_zero=True), value=6)


def parse_measure(v: Views) -> DataFrame:
    long = reshape.to_long(v.measures(), ["pwsid"])
    return rounded(reshape.parse_measure(long), value=6)


def contaminant_group(v: Views) -> DataFrame:
    parsed = reshape.parse_measure(reshape.to_long(v.measures(), ["pwsid"], drop_null=True))
    return (
        parsed.groupBy(reshape.contaminant_group(F.col("contaminant")).alias("contaminant_group"), "stat_clean")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def to_wide(v: Views) -> DataFrame:
    out = reshape.to_wide(
        v.table("events"), ["user_id"], "event_type", "value", ["click", "view", "purchase", "signup", "error"]
    )
    return out


def state_lookup(v: Views) -> DataFrame:
    placed = reshape.with_state(v.tract().withColumn("st_fips", ids.state_of(F.col("tract_geoid"))))
    return rounded(placed, tract_total_pop=2)


def dominant_state(v: Views) -> DataFrame:
    return reshape.dominant_state(v.bg_pws())


def measurement_round(v: Views) -> DataFrame:
    long = coverage.flags_long(v.measures().select("pwsid", *FLAGS), FLAGS)
    return long.groupBy("flag", "round").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


def pattern_columns(v: Views) -> DataFrame:
    """Select by pattern, rename by pattern, tag with the round, fill and round numbers."""
    chosen = v.measures().select("pwsid", *cols(v.measures(), ends_with="MEDPWS"), *cols(v.measures(), contains="max"))
    renamed = rename_by_pattern(chosen, lookups.FINAL_RENAMES, only=cols(chosen, matches="max"))
    return round_numeric(zero_fill(tag_by_stem(renamed, lookups.ROUND_OF)), 4)


# Coverage ------------------------------------------------------------------


ARM_NAMES = ["syr3", "syr4"]


def _with_arms(v: Views) -> DataFrame:
    """Tract exposure marked with the review rounds its systems have both medians for."""
    parts = medians(v, keep=True)
    known = parts.select(
        "pwsid",
        *(
            (F.col(f"median_arsenic_{r}").isNotNull() & F.col(f"median_tthm_{r}").isNotNull()).alias(r)
            for r in ARM_NAMES
        ),
    )
    once = cut_lineage(served(v))
    return coverage.with_arms(exposure.tract_exposure(once, v.measures(), v.tract()), once, known, ARM_NAMES)


def retention_by_state(v: Views) -> DataFrame:
    out = coverage.retention(tract_table(v), F.col("pws_coverage_proportion") >= 0.5)
    return rounded(out, pct_included=6)


def reference_totals(v: Views) -> DataFrame:
    tract = v.tract()
    routed = overlay.with_region(tract, "tract_geoid")
    parts = [routed.where(F.col("region") == r).drop("region") for r in overlay.REGIONS]
    return rounded(coverage.reference_totals(parts), ref_pop=2)


def coverage_compare(v: Views) -> DataFrame:
    totals = coverage.arm_totals(_with_arms(v), ARM_NAMES)
    out = coverage.compare(coverage.reference_totals([v.tract()]), totals, ARM_NAMES)
    return settled(out, **{c: 2 if "pop" in c else 6 for c in out.columns if c[:3] in ("ref", "pop", "tra", "mai", "cov")})


def round_coverage(v: Views) -> DataFrame:
    rounds = sorted({*lookups.ROUNDS, lookups.OTHER_ROUND})
    totals = coverage.by_round(coverage.filter_covered(_with_arms(v), 0.1), FLAGS, ARM_NAMES)
    out = coverage.round_coverage(coverage.reference_totals([v.tract()]), rounds, totals, ARM_NAMES)
    return settled(out, **{c: 2 if "pop" in c else 6 for c in out.columns if c[:3] in ("ref", "pop", "mai", "cov")})


def _boundaries(v: Views) -> DataFrame:
    return v.published().select("pwsid", F.col("population_served_count").alias("boundary_pop"))


def _sampled(v: Views) -> dict[str, DataFrame]:
    return {
        a: medians(v).where(F.col(f"{a}_fin_median").isNotNull()).select("pwsid") for a in ("arsenic", "tthm")
    }


def coverage_by_type(v: Views) -> DataFrame:
    out = coverage.by_agency_type(v.master(), _boundaries(v), _sampled(v))
    return rounded(out, arsenic_pop_comp=6, tthm_pop_comp=6)


def conditional_median(v: Views) -> DataFrame:
    out = coverage.by_agency_type(v.master(), _boundaries(v), _sampled(v)).where("type_code = 'CWS'")
    medians_of = {"arsenic_median": "arsenic_pop_comp", "tthm_median": "tthm_pop_comp"}
    return rounded(exact_medians(out, [], medians_of), arsenic_median=6, tthm_median=6)


def threshold_filter(v: Views) -> DataFrame:
    return rounded(coverage.filter_covered(tract_table(v), 0.5), **EXPOSURE_DIGITS).select(
        "tract_geoid", "pws_coverage_proportion"
    )


# Checks and reconciliation --------------------------------------------------


def top_k(v: Views) -> DataFrame:
    out = checks.top_k(tract_table(v).select("tract_geoid", "ct_pop_pws"), 25, [F.desc("ct_pop_pws"), F.col("tract_geoid")])
    return rounded(out, ct_pop_pws=4)


def get_dupes(v: Views) -> DataFrame:
    return checks.get_dupes(v.bg_pws(), ["geoid", "pwsid"]).select("geoid", "pwsid", "overlap_area", "dupe_count")


def distinct_keep(v: Views) -> DataFrame:
    lines = v.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber")
    return checks.distinct_keep(lines, ["l_suppkey"], [-F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")])


def unmatched_systems(v: Views) -> DataFrame:
    by_plain = checks.unmatched(v.published(), v.measures(), ["pwsid"]).select("pwsid").withColumn("what", F.lit("plain"))
    codes = checks.unmatched(
        v.master().select("agency", "activity_code").distinct(),
        v.master().where("type_code = 'CWS'").select("agency", "activity_code"),
        ["agency", "activity_code"],
        null_matches=True,
    )
    nulls = codes.select(F.concat_ws("-", "agency", F.coalesce("activity_code", F.lit("none"))).alias("pwsid")).withColumn(
        "what", F.lit("null_matches")
    )
    return by_plain.unionByName(nulls)


def reconcile(v: Views) -> DataFrame:
    tagged = tag_by_stem(v.measures(), lookups.ROUND_OF)
    rounds = {r.lower(): cols(tagged, ends_with=r.lower()) for r in ("ucmr1", "ucmr3or5")}
    bounded = v.published().where(F.col("population_served_count").isNotNull())
    return checks.reconcile(tagged, bounded, v.master(), rounds)


def tribal_agencies(v: Views) -> DataFrame:
    """Agencies written with digits, against those that are not, by size class."""
    m = v.master().withColumn("digits", F.col("agency").rlike("[0-9]"))
    labelled = m.withColumn("size_class", reshape.recode(F.col("pop_cat"), lookups.POPULATION_CLASSES))
    return labelled.groupBy("digits", "size_class", "type_code").agg(F.count(F.lit(1)).alias("n"))


def activity_subset(v: Views) -> DataFrame:
    kept = v.master().where(F.col("activity_code").isin("A", "I") & ~F.col("type_code").isin("TNCWS"))
    return kept.groupBy("activity_code", "type_code").agg(F.sum("population").alias("population"))


def joined_systems(v: Views) -> DataFrame:
    """Inner and left joins of the master list with measurements, on a shared name."""
    m, x = v.master(), v.measures().select("pwsid", "dcpa_medpws")
    inner = m.join(x, "pwsid").select("pwsid", "type_code", "dcpa_medpws", F.lit("inner").alias("how"))
    left = m.join(x, "pwsid", "left").select("pwsid", "type_code", "dcpa_medpws", F.lit("left").alias("how"))
    return rounded(inner.unionByName(left), dcpa_medpws=6)


# Identifiers ---------------------------------------------------------------


def gisjoin(v: Views) -> DataFrame:
    g = F.col("tract_geoid")
    made = v.tract().select(
        "tract_geoid",
        F.concat(F.lit("G"), ids.state_of(g), F.lit("0"), F.substring(g, 3, 3), F.lit("0"), F.substring(g, 6, 6)).alias("gisjoin"),
    )
    return made.withColumn("geoid", ids.gisjoin_to_geoid(F.col("gisjoin")))


def pad_geoid(v: Views) -> DataFrame:
    return v.table("orders").select(
        "o_orderkey",
        ids.pad_geoid(F.col("o_custkey"), 11).alias("padded"),
        ids.pad_geoid(F.concat(F.lit("999999999"), F.col("o_custkey").cast("string")), 11).alias("long_kept"),
    )


def geoid_prefix(v: Views) -> DataFrame:
    g = F.col("geoid")
    return v.bg_pws().select(
        ids.tract_of(g).alias("tract"), ids.county_of(g).alias("county"), ids.state_of(g).alias("state")
    ).groupBy("tract", "county", "state").agg(F.count(F.lit(1)).alias("n"))


def tract_type(v: Views) -> DataFrame:
    return v.tract().select("tract_geoid", ids.tract_type(F.col("tract_geoid")).alias("tract_type"))


def state_subset(v: Views) -> DataFrame:
    return v.bg_pws().where(ids.in_state(F.col("geoid"), "02")).groupBy("pwsid").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("overlap_area"), 4).alias("overlap_area")
    )


QUERIES = {
    "to_long_labelled": to_long_labelled,
    "system_long": system_long,
    "parse_measure": parse_measure,
    "contaminant_group": contaminant_group,
    "to_wide": to_wide,
    "state_lookup": state_lookup,
    "dominant_state": dominant_state,
    "measurement_round": measurement_round,
    "pattern_columns": pattern_columns,
    "retention_by_state": retention_by_state,
    "reference_totals": reference_totals,
    "coverage_compare": coverage_compare,
    "round_coverage": round_coverage,
    "coverage_by_type": coverage_by_type,
    "conditional_median": conditional_median,
    "threshold_filter": threshold_filter,
    "top_k": top_k,
    "get_dupes": get_dupes,
    "distinct_keep": distinct_keep,
    "tabyl": lambda v: rounded(checks.tabyl(v.master(), "activity_code"), percent=6, valid_percent=6),
    "distinct_counts": lambda v: checks.distinct_counts(v.bg_pws(), ["geoid", "pwsid"]),
    "distinct_counts_with_null": lambda v: checks.distinct_counts(v.master(), ["activity_code", "pwsid"], count_null=True),
    "unmatched_systems": unmatched_systems,
    "any_not_null": lambda v: checks.any_not_null(v.measures(), cols(v.measures(), ends_with="medPWS")).select("pwsid"),
    "share_with_data": lambda v: rounded(checks.share_with_data(v.published(), v.measures()), prop_with_data=6),
    "reconcile": reconcile,
    "tribal_agencies": tribal_agencies,
    "activity_subset": activity_subset,
    "joined_systems": joined_systems,
    "gisjoin_to_geoid": gisjoin,
    "pad_geoid": pad_geoid,
    "geoid_prefix": geoid_prefix,
    "tract_type": tract_type,
    "state_subset": state_subset,
}

STATES_SQL = "select * from (values " + ", ".join(
    f"('{a}', '{b}', '{c}')" for a, b, c in lookups.STATES
) + ") as t(st_fips, state_abbr, state_name)"

GROUP_SQL = "case when contaminant = 'pfoa35' then 'PFAS (Simplified)' else 'Pesticides, Perchlorate, Other' end"
LONG_MEASURES = """
select pwsid, measures, value, case when measures like 'pfoa%' then 'pfoa35' else 'dcpa' end as contaminant,
       case when measures like '%detect%' then 'detect_level' when measures like '%max%' then 'max'
            else 'median' end as stat_clean
from (select pwsid, {cols} from measures) unpivot include nulls (value for measures in
      (dcpa_medpws, dcpa_maxpws, dcpa_detectpws, pfoa_35_medpws, pfoa_35_detectpws))"""
MEASURE_COLS = "dcpa_medpws, dcpa_maxpws, dcpa_detectpws, pfoa_35_medpws, pfoa_35_detectpws"
PLAIN_LONG = LONG_MEASURES.format(cols=MEASURE_COLS)
ZERO_LONG = LONG_MEASURES.format(
    cols=", ".join(f"coalesce({c.strip()}, 0) as {c.strip()}" for c in MEASURE_COLS.split(","))
)
DOMINANT = """
select pwsid, st_fips, n_states from (
  select pwsid, st_fips, count(*) over (partition by pwsid) as n_states,
         row_number() over (partition by pwsid order by area desc, st_fips desc) as k
  from (select pwsid, substr(geoid, 1, 2) as st_fips, sum(overlap_area) as area from bg_pws group by 1, 2))
where k = 1"""

ARMS = {
    **STITCH,
    "covered": "select *, substr(tract_geoid, 1, 2) as st_fips from exposure where pws_coverage_proportion >= 0.1",
    **{
        r: f"""select * from covered where tract_geoid in (
  select tract_geoid from served where pwsid in (
    select pwsid from wide where median_arsenic_{r} is not null and median_tthm_{r} is not null))"""
        for r in ("syr3", "syr4")
    },
    "reference": """select substr(tract_geoid, 1, 2) as st_fips, sum(tract_total_pop) as ref_pop, count(*) as n_actual
from tract group by 1""",
}


def _arm_sql(table: str, suffix: str) -> str:
    return f"""(select st_fips, sum(ct_pop_pws) as pop_in_pws{suffix}, sum(tract_total_pop) as tract_int_tot_pop{suffix},
  count(*) as n_tracts_joined{suffix} from {table} group by 1)"""


def _round_sql(table: str, suffix: str) -> str:
    return f"""(select st_fips, round, sum(ct_pop_pws) as pop_in_pws{suffix} from (
  select st_fips, 'UCMR1' as round, ct_pop_pws from {table} where dcpa_detectpws is not null
  union all select st_fips, 'UCMR3or5', ct_pop_pws from {table} where pfoa_35_detectpws is not null) group by 1, 2)"""


BY_TYPE = """
select agency, type_code, ref_pop, arsenic_pop_coverage,
       coalesce(arsenic_pop_coverage / ref_pop, 0) as arsenic_pop_comp,
       tthm_pop_coverage, coalesce(tthm_pop_coverage / ref_pop, 0) as tthm_pop_comp
from (select agency, type_code, sum(population)::bigint as ref_pop from master group by 1, 2)
left join (select agency, type_code, sum(population_served_count) as arsenic_pop_coverage
           from published join final using (pwsid) left join master using (pwsid)
           where arsenic_fin_median is not null group by 1, 2) using (agency, type_code)
left join (select agency, type_code, sum(population_served_count) as tthm_pop_coverage
           from published join final using (pwsid) left join master using (pwsid)
           where tthm_fin_median is not null group by 1, 2) using (agency, type_code)"""

RATIO_6 = ["main_cov", "cov_syr3", "cov_of_main_syr3", "cov_syr4", "cov_of_main_syr4"]

ORACLES = {
    "to_long_labelled": with_views(f"""
select tract_geoid, round(value, 6) as value, contaminant, stat_clean, {GROUP_SQL} as contaminant_group,
       substr(tract_geoid, 1, 2) as st_fips, state_abbr, state_name
from (select *, case when measures like 'pfoa%' then 'pfoa35' else 'dcpa' end as contaminant,
             case when measures like '%max%' then 'max' else 'median' end as stat_clean
      from (select tract_geoid, {', '.join(VALUES)} from exposure)
           unpivot include nulls (value for measures in ({', '.join(VALUES)}))) x
left join states s on s.st_fips = substr(tract_geoid, 1, 2)""", states=STATES_SQL),
    "system_long": with_views(f"""
select pwsid, st_fips, n_states, round(value, 6) as value, contaminant, stat_clean,
       {GROUP_SQL} as contaminant_group, state_abbr, state_name
from long left join dominant using (pwsid) left join states using (st_fips)""",
        long=ZERO_LONG, dominant=DOMINANT, states=STATES_SQL),
    "parse_measure": with_views(
        "select pwsid, measures, round(value, 6) as value, contaminant, stat_clean from long", long=PLAIN_LONG),
    "contaminant_group": with_views(f"""
select {GROUP_SQL} as contaminant_group, stat_clean, count(*) as n from long where value is not null group by 1, 2""",
        long=PLAIN_LONG),
    "to_wide": "select user_id, " + ", ".join(
        f"max(case when event_type = '{t}' then value end) as {t}"
        for t in ("click", "view", "purchase", "signup", "error")) + " from events group by 1",
    "state_lookup": with_views("""
select tract_geoid, round(tract_total_pop, 2) as tract_total_pop, substr(tract_geoid, 1, 2) as st_fips,
       state_abbr, state_name
from tract left join states on st_fips = substr(tract_geoid, 1, 2)""", states=STATES_SQL),
    "dominant_state": with_views(DOMINANT),
    "measurement_round": with_views("""
select 'dcpa_detectpws' as flag, 'UCMR1' as round, count(dcpa_detectpws) as n, sum(dcpa_detectpws) as hits from measures
union all select 'pfoa_35_detectpws', 'UCMR3or5', count(pfoa_35_detectpws), sum(pfoa_35_detectpws) from measures"""),
    "pattern_columns": with_views("""
select pwsid, round(coalesce(dcpa_medpws, 0), 4) as "dcpa_medpws_UCMR1",
       round(coalesce(pfoa_35_medpws, 0), 4) as "pfoa_35_medpws_UCMR3or5",
       round(coalesce(dcpa_maxpws, 0), 4) as "dcpa_maxcws_UCMR1" from measures"""),
    "retention_by_state": with_views("""
select substr(tract_geoid, 1, 2) as st_fips, count(*) as n_og,
       count(*) filter (pws_coverage_proportion >= 0.5) as n_post_filter,
       round(count(*) filter (pws_coverage_proportion >= 0.5) / count(*), 6) as pct_included
from exposure group by 1"""),
    "reference_totals": with_views(
        "select st_fips, round(ref_pop, 2) as ref_pop, n_actual from reference", **ARMS),
    "coverage_compare": with_views("select " + sql_settled(
        "st_fips, n_actual, n_tracts_joined, n_tracts_joined_syr3, n_tracts_joined_syr4", ref_pop=2,
        **{f"{c}{s}": 2 for c in ("pop_in_pws", "tract_int_tot_pop") for s in ("", "_syr3", "_syr4")},
        **{c: 6 for c in RATIO_6}) + f""" from (
select *, pop_in_pws / ref_pop as main_cov, pop_in_pws_syr3 / ref_pop as cov_syr3,
       pop_in_pws_syr3 / pop_in_pws as cov_of_main_syr3, pop_in_pws_syr4 / ref_pop as cov_syr4,
       pop_in_pws_syr4 / pop_in_pws as cov_of_main_syr4
from reference left join {_arm_sql('covered', '')} using (st_fips)
left join {_arm_sql('syr3', '_syr3')} using (st_fips) left join {_arm_sql('syr4', '_syr4')} using (st_fips))""", **ARMS),
    "round_coverage": with_views("select " + sql_settled(
        "st_fips, round", ref_pop=2, pop_in_pws=2, pop_in_pws_syr3=2, pop_in_pws_syr4=2,
        **{c: 6 for c in RATIO_6}) + f""" from (
select *, pop_in_pws / ref_pop as main_cov, pop_in_pws_syr3 / ref_pop as cov_syr3,
       pop_in_pws_syr4 / ref_pop as cov_syr4,
       case when pop_in_pws > 0 then pop_in_pws_syr3 / pop_in_pws end as cov_of_main_syr3,
       case when pop_in_pws > 0 then pop_in_pws_syr4 / pop_in_pws end as cov_of_main_syr4
from (
  select st_fips, round, ref_pop, coalesce(pop_in_pws, 0) as pop_in_pws,
         coalesce(pop_in_pws_syr3, 0) as pop_in_pws_syr3, coalesce(pop_in_pws_syr4, 0) as pop_in_pws_syr4
  from reference
  cross join (select unnest(['UCMR1', 'UCMR3', 'UCMR3or5', 'UCMR4', 'UCMR5', 'Other']) as round)
  left join {_round_sql('covered', '')} using (st_fips, round)
  left join {_round_sql('syr3', '_syr3')} using (st_fips, round)
  left join {_round_sql('syr4', '_syr4')} using (st_fips, round)))""", **ARMS),
    "coverage_by_type": with_views("select " + sql_rounded(
        "agency, type_code, ref_pop, arsenic_pop_coverage, tthm_pop_coverage", arsenic_pop_comp=6, tthm_pop_comp=6)
        + " from by_type", **STITCH, by_type=BY_TYPE),
    "conditional_median": with_views("""
select round(median(arsenic_pop_comp), 6) as arsenic_median, round(median(tthm_pop_comp), 6) as tthm_median
from by_type where type_code = 'CWS'""", **STITCH, by_type=BY_TYPE),
    "threshold_filter": with_views("""
select tract_geoid, round(pws_coverage_proportion, 3) as pws_coverage_proportion
from exposure where pws_coverage_proportion >= 0.5"""),
    "top_k": with_views("""
select tract_geoid, round(ct_pop_pws, 4) as ct_pop_pws from tract_pop order by ct_pop_pws desc, tract_geoid limit 25"""),
    "get_dupes": with_views("""
select * from (select geoid, pwsid, overlap_area, count(*) over (partition by geoid, pwsid) as dupe_count from bg_pws)
where dupe_count > 1"""),
    "distinct_keep": """
select l_orderkey, l_suppkey, l_quantity, l_linenumber from (
  select *, row_number() over (partition by l_suppkey order by l_quantity desc, l_orderkey, l_linenumber) as k
  from lineitem) where k = 1""",
    "tabyl": with_views("""
select activity_code, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as percent,
       case when activity_code is not null then round(count(*) / sum(count(activity_code)) over (), 6) end as valid_percent
from master group by 1"""),
    "distinct_counts": with_views(
        "select count(distinct geoid) as n_geoid, count(distinct pwsid) as n_pwsid from bg_pws"),
    "distinct_counts_with_null": with_views("""
select count(distinct coalesce(activity_code, 'none')) as n_activity_code, count(distinct pwsid) as n_pwsid from master"""),
    "unmatched_systems": with_views("""
select pwsid, 'plain' as what from published where pwsid not in (select pwsid from measures)
union all
select concat(agency, '-', coalesce(activity_code, 'none')), 'null_matches' from (
  select distinct agency, activity_code from master
  except select agency, activity_code from master where type_code = 'CWS')"""),
    "any_not_null": with_views(
        "select pwsid from measures where dcpa_medpws is not null or pfoa_35_medpws is not null"),
    "share_with_data": with_views("""
select count(distinct pwsid) filter (pwsid in (select pwsid from measures)) as systems_with_data, count(*) as systems,
       round(count(distinct pwsid) filter (pwsid in (select pwsid from measures)) / count(*), 6) as prop_with_data
from published"""),
    "reconcile": with_views("""
select round, activity_code, count(*) as n_systems, count(*) filter (population_served_count is null) as n_no_boundary
from (select pwsid, 'ucmr1' as round from measures
      where dcpa_medpws is not null or dcpa_maxpws is not null or dcpa_detectpws is not null
      union all select pwsid, 'ucmr3or5' from measures
      where pfoa_35_medpws is not null or pfoa_35_detectpws is not null)
left join master using (pwsid) left join published using (pwsid) group by 1, 2"""),
    "tribal_agencies": with_views("""
select regexp_matches(agency, '[0-9]') as digits, case pop_cat when 1 then '≤500' when 2 then '501–3,300' when 3 then '3,301–10,000'
       when 4 then '10,001–100,000' when 5 then '>100,000' end as size_class, type_code, count(*) as n
from master group by 1, 2, 3"""),
    "activity_subset": with_views("""
select activity_code, type_code, sum(population)::bigint as population from master
where activity_code in ('A', 'I') and type_code not in ('TNCWS') group by 1, 2"""),
    "joined_systems": with_views("""
select pwsid, type_code, round(dcpa_medpws, 6) as dcpa_medpws, 'inner' as how from master join measures using (pwsid)
union all
select pwsid, type_code, round(dcpa_medpws, 6), 'left' from master left join measures using (pwsid)"""),
    "gisjoin_to_geoid": with_views("""
select tract_geoid, concat('G', substr(tract_geoid, 1, 2), '0', substr(tract_geoid, 3, 3), '0', substr(tract_geoid, 6))
       as gisjoin, tract_geoid as geoid from tract"""),
    "pad_geoid": """
select o_orderkey, lpad(cast(o_custkey as string), 11, '0') as padded,
       case when length(cast(o_custkey as string)) < 2
            then lpad(concat('999999999', cast(o_custkey as string)), 11, '0')
            else concat('999999999', cast(o_custkey as string)) end as long_kept from orders""",
    "geoid_prefix": with_views("""
select substr(geoid, 1, 11) as tract, substr(geoid, 1, 5) as county, substr(geoid, 1, 2) as state, count(*) as n
from bg_pws group by 1, 2, 3"""),
    "tract_type": with_views("""
select tract_geoid, case when code between 990000 and 999800 then 'water'
       when code between 980000 and 989999 then 'special_land_use'
       when code between 940000 and 949999 then 'american_indian_area' else 'standard' end as tract_type
from (select tract_geoid, cast(substr(tract_geoid, 6) as integer) as code from tract)"""),
    "state_subset": with_views("""
select pwsid, count(*) as n, round(sum(overlap_area), 4) as overlap_area from bg_pws
where substr(geoid, 1, 2) = '02' group by 1"""),
}
