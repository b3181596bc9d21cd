"""Covariate preparation and the final analytic table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queries.views import Views, with_views
from queries.weighting import rounded, settled, sql_rounded, tract_table
from zonewise import contract
from zonewise.functions import ids, text
from zonewise.operators import covariates
from zonewise.plans import tables

LEVELS = covariates.SCHOOLING


def _tract_orders(v: Views) -> DataFrame:
    return v.table("orders").join(v._tract_ids(), F.col("o_custkey") == F.col("c_custkey"))


def acs(v: Views) -> DataFrame:
    """Census-like counts per tract, counted from orders by priority, status and month."""

    def n(condition: Column) -> Column:
        return F.count_if(condition).cast("double")

    priority, status, month = F.col("o_orderpriority"), F.col("o_orderstatus"), F.month("o_orderdate")
    races = {
        "whitenh": priority.startswith("1"), "blacknh": priority.startswith("2"),
        "asiannh": priority.startswith("3"), "hisp": priority.startswith("4"), "multinh": priority.startswith("5"),
        "aiannh": status == "F", "nhpinh": status == "O", "othernh": status == "P",
    }
    schooling = {f"edu_m_{lv}E": month == i + 1 for i, lv in enumerate(LEVELS)}
    schooling |= {f"edu_f_{lv}E": F.dayofmonth("o_orderdate") == i + 1 for i, lv in enumerate(LEVELS)}
    return _tract_orders(v).groupBy(F.col("tract_geoid").alias("GEOID")).agg(
        F.count(F.lit(1)).cast("double").alias("race_totalE"),
        *(n(c).alias(f"race_{k}E") for k, c in races.items()),
        n(status == "F").alias("pov_belowE"),
        n(status != "P").alias("pov_totalE"),
        F.max("o_totalprice").alias("medhhincE"),
        (F.count(F.lit(1)) * 2).cast("double").alias("edu_totalE"),
        *(n(c).alias(k) for k, c in schooling.items()),
    )


def areas(v: Views) -> DataFrame:
    ids_ = v._tract_ids()
    return ids_.select(
        F.col("tract_geoid").alias("GEOID10"), ((F.col("c_custkey") % 50 + 1) * 1e6).alias("ALAND10")
    )


def demographics(v: Views) -> DataFrame:
    return covariates.demographics(acs(v), areas(v))


DEMO_DIGITS = {c: 6 for c in (*covariates.RACE_SHARES, "POV_ALLAGE", "PCT_HSPLUS", "POP_DENSITY_SQKM")}


def density(v: Views) -> DataFrame:
    return rounded(demographics(v).select("GEOID", "race_totalE", "ALAND10", "POP_DENSITY_SQKM"), POP_DENSITY_SQKM=6)


def parse_interval(v: Views) -> DataFrame:
    out = covariates.parse_interval(v.interval_text(), "est", "smoking_prev")
    return out.withColumn("state_abb", text.trailing_state(F.col("county")))


def split_entities(v: Views) -> DataFrame:
    out = covariates.parse_interval(v.interval_text(), "est", "smoking_prev")
    return covariates.split_entities(out, "county").drop("est", "county")


def repair_keys(v: Views) -> DataFrame:
    """First-occurrence repairs of place names."""
    name = F.col("n_name")
    return v.table("nation").select(
        "n_nationkey",
        text.repair_key(name, [("A", "a"), ("NI", "Ni")]).alias("repaired"),
        text.remove_first(name, F.lit("A")).alias("without_first"),
        text.place_name(F.concat(name, F.lit(", DE")), F.lit("DE")).alias("place"),
    )


def fill_down(v: Views) -> DataFrame:
    gaps = v.table("events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value")
    )
    return covariates.fill_down(gaps, "value", "event_id", ["user_id"])


def period_mean(v: Views) -> DataFrame:
    daily = v.table("events").select(
        F.lpad(F.col("user_id").cast("string"), 11, "0").alias("FIPS"),
        F.col("value").cast("string").alias("daily(ug/m3)"),
        (F.col("value") / 10).cast("string").alias("daily_stderr(ug/m3)"),
    )
    out = covariates.period_mean(
        daily, "FIPS", {"mean_pm25_value": "daily(ug/m3)", "mean_pm25_sd": "daily_stderr(ug/m3)"}
    )
    return rounded(out, mean_pm25_value=6, mean_pm25_sd=6)


def county_smoking(v: Views) -> DataFrame:
    key = F.col("n_nationkey")
    county = v.table("nation").select(
        F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad(key.cast("string"), 3, "0")).alias("GEOID10"),
        F.concat((15 + key).cast("string"), F.lit(".5 ("), (10 + key).cast("string"), F.lit(".25,"),
                 (20 + key).cast("string"), F.lit(".75)")).alias("est"),
    )
    return covariates.parse_interval(county, "est", "smoking_prev").drop("est")


def _tract_tables(v: Views) -> tuple[dict[str, DataFrame], dict[str, str]]:
    g = F.col("tract_geoid")
    ndvi = _tract_orders(v).groupBy("tract_geoid").agg(
        F.avg("o_totalprice").alias("NDVI_mean"), F.max("o_totalprice").alias("NDVI_max")
    ).select(
        F.concat(F.lit("G"), ids.state_of(g), F.lit("0"), F.substring(g, 3, 3), F.lit("0"), F.substring(g, 6, 6)).alias("GISJOIN"),
        "NDVI_mean", "NDVI_max", F.lit(2008).alias("year"),
    ).withColumn("GEOID", ids.gisjoin_to_geoid(F.col("GISJOIN"))).drop("GISJOIN")
    canopy = v._tract_ids().select(
        F.col("tract_geoid").alias("GEOID10"), (F.col("c_custkey") % 100 / 2.0).alias("tree_can"),
        F.lit(2008).alias("year"),
    )
    parts = {"acs": demographics(v), "canopy": canopy, "ndvi": ndvi}
    return parts, {"acs": "GEOID", "canopy": "GEOID10", "ndvi": "GEOID"}


def covariate_reduce(v: Views) -> DataFrame:
    parts, keys = _tract_tables(v)
    out = covariates.left_reduce(parts, keys, drop=["year"])
    return settled(rounded(out, **DEMO_DIGITS), NDVI_mean=3)


def covariate_table(v: Views) -> DataFrame:
    parts, keys = _tract_tables(v)
    return tables.covariate_table(parts, keys, county_smoking(v), drop=["year"])


def final_analytic(v: Views) -> DataFrame:
    out = tables.final_analytic(tract_table(v), covariate_table(v))
    digits = {c.lower(): d for c, d in DEMO_DIGITS.items()} | {
        "dcpa_medcws_weighted": 6, "dcpa_maxcws_weighted": 6, "pfoa_35_medcws_weighted": 6, "ct_pop_cws": 4,
        "tract_total_pop": 2, "cws_coverage_proportion": 3, "prop_no_cws": 3,
    }
    return settled(rounded(out, **digits), ndvi_mean=3)


def final_violations(v: Views) -> DataFrame:
    """What the final table breaks of its column contract."""
    return contract.violations(tables.final_analytic(tract_table(v), covariate_table(v)), contract.final_fields(), partial=True)


QUERIES = {
    "ratio_measures": lambda v: rounded(demographics(v), **DEMO_DIGITS),
    "density": density,
    "parse_interval": parse_interval,
    "split_entities": split_entities,
    "repair_keys": repair_keys,
    "fill_down": fill_down,
    "period_mean": period_mean,
    "covariate_reduce": covariate_reduce,
    "covariate_table": lambda v: settled(rounded(covariate_table(v), **DEMO_DIGITS), NDVI_mean=3),
    "final_analytic": final_analytic,
    "final_violations": final_violations,
}

# "order_tract" gives each order its tract; tracts without orders have no demographics.
ORDER_TRACT = "select t.tract_geoid, t.c_custkey, o.* from orders o join tract t on t.c_custkey = o.o_custkey"
_COUNT = "count(*) filter ({})::double"
_EDU = " + ".join(
    [_COUNT.format(f"month(o_orderdate) = {i + 1}") for i in range(len(LEVELS))]
    + [_COUNT.format(f"day(o_orderdate) = {i + 1}") for i in range(len(LEVELS))]
)
_RACES = {
    "RACE_WHITENH": "o_orderpriority like '1%'", "RACE_BLACKNH": "o_orderpriority like '2%'",
    "RACE_ASIANNH": "o_orderpriority like '3%'", "RACE_HISP": "o_orderpriority like '4%'",
    "RACE_MULTIPLENH": "o_orderpriority like '5%'", "RACE_OTHERNH": "o_orderstatus in ('F', 'O', 'P')",
}
DEMO = f"""
select tract_geoid as "GEOID", count(*)::double as "race_totalE",
       {', '.join(f'{_COUNT.format(c)} / count(*) as "{k}"' for k, c in _RACES.items())},
       case when count(*) filter (o_orderstatus <> 'P') > 0 then count(*) filter (o_orderstatus = 'F')::double
            / count(*) filter (o_orderstatus <> 'P') end as "POV_ALLAGE",
       max(o_totalprice) as "MEDHHINC", ({_EDU}) / (2 * count(*)) as "PCT_HSPLUS",
       (max(c_custkey) % 50 + 1) * 1000000.0::double as "ALAND10",
       count(*)::double / (max(c_custkey) % 50 + 1) as "POP_DENSITY_SQKM"
from order_tract group by 1"""
REDUCED = """
select "GEOID" as tract_geoid, demo.* exclude ("GEOID"), c_custkey % 100 / 2.0::double as tree_can, "NDVI_mean",
       "NDVI_max"
from demo join tract on tract_geoid = "GEOID"
join (select tract_geoid as g, avg(o_totalprice) as "NDVI_mean", max(o_totalprice) as "NDVI_max"
      from order_tract group by 1) on g = "GEOID" """
COVARS = """
select r.*, substr(tract_geoid, 1, 5) as co_geoid, (15 + n_nationkey + 0.5)::double as smoking_prev,
       (10 + n_nationkey + 0.25)::double as smoking_prev_lower, (20 + n_nationkey + 0.75)::double as smoking_prev_upper
from reduced r left join nation on n_nationkey = cast(substr(tract_geoid, 3, 3) as integer)
where not cast(substr(tract_geoid, 6) as integer) between 990000 and 999800
  and not cast(substr(tract_geoid, 6) as integer) between 980000 and 989999"""
COVAR_CTES = {"order_tract": ORDER_TRACT, "demo": DEMO, "reduced": REDUCED, "covars": COVARS}
_ROUNDED_DEMO = ", ".join(f'round("{c}", 6) as "{c}"' for c in DEMO_DIGITS)
_REPLACED = f"* replace ({_ROUNDED_DEMO}"
INTERVAL = """
select *, try_cast(regexp_extract(est, '([0-9]+[.]?[0-9]*)[ ]*[(]', 1) as double) as smoking_prev,
       try_cast(regexp_extract(est, '[(]([0-9]+[.]?[0-9]*),', 1) as double) as smoking_prev_lower,
       try_cast(regexp_extract(est, ',([0-9]+[.]?[0-9]*)[)]', 1) as double) as smoking_prev_upper,
       right(county, 2) as state_abb
from interval_text"""

_SHARES = {
    "cws_coverage_proportion": "pws_coverage_proportion", "prop_no_cws": "prop_no_pws",
    **{c.lower(): f'"{c}"' for c in ("RACE_WHITENH", "RACE_BLACKNH", "RACE_ASIANNH", "RACE_HISP", "RACE_MULTIPLENH", "RACE_OTHERNH", "POV_ALLAGE", "PCT_HSPLUS")},
}
_BROKEN = {
    **{(c, "malformed"): f"count(*) filter ({e} < 0 or {e} > 1)" for c, e in _SHARES.items()},
    **{(f"{c}_detectcws", "malformed"): f"count(*) filter ({c}_detectpws not in (0, 1))" for c in ("dcpa", "pfoa_35")},
    ("n_cws_ucmr", "malformed"): "count(*) filter (n_pws_ucmr <> floor(n_pws_ucmr))",
    ("race_total_e", "malformed"): """count(*) filter ("race_totalE" <> floor("race_totalE"))""",
    ("tract_geoid", "malformed"): "count(*) filter (not regexp_full_match(tract_geoid, '[0-9]{11}'))",
    ("co_geoid", "malformed"): "count(*) filter (not regexp_full_match(co_geoid, '[0-9]{5}'))",
    ("tract_geoid", "null"): "count(*) - count(tract_geoid)",
}
FINAL_ROWS = """
select * from exposure left join covars using (tract_geoid)
where pws_coverage_proportion >= 0.5 and not cast(substr(tract_geoid, 6) as integer) between 980000 and 989999"""

ORACLES = {
    "ratio_measures": with_views(f"select {_REPLACED}) from demo", **COVAR_CTES),
    "density": with_views("""
select "GEOID", "race_totalE", "ALAND10", round("POP_DENSITY_SQKM", 6) as "POP_DENSITY_SQKM" from demo""", **COVAR_CTES),
    "parse_interval": with_views("select * from parsed", parsed=INTERVAL),
    "split_entities": with_views("""
select s_suppkey, smoking_prev, smoking_prev_lower, smoking_prev_upper, state_abb, i - 1 as part_no,
       parts[i] as county_part, trim(regexp_replace(replace(parts[i], ',', ''), '(DE|PA)$', '')) as name_clean
from (select *, string_split(county, '/') as parts,
             unnest(range(1, len(string_split(county, '/')) + 1)) as i from parsed)""", parsed=INTERVAL),
    "repair_keys": """
select n_nationkey, regexp_replace(regexp_replace(n_name, 'A', 'a'), 'NI', 'Ni') as repaired,
       regexp_replace(n_name, 'A', '') as without_first,
       trim(regexp_replace(concat(n_name, ' DE'), 'DE', '')) as place from nation""",
    "fill_down": """
select user_id, event_id, last_value(case when event_type = 'purchase' then value end ignore nulls)
       over (partition by user_id order by event_id) as value from events""",
    "period_mean": """
select lpad(cast(user_id as string), 11, '0') as "FIPS", round(avg(value), 6) as mean_pm25_value,
       round(avg(value / 10), 6) as mean_pm25_sd from events group by 1""",
    "covariate_reduce": with_views(
        f'select {_REPLACED}, round("NDVI_mean" + 1e-6, 3) as "NDVI_mean") from reduced', **COVAR_CTES),
    "covariate_table": with_views(
        f'select {_REPLACED}, round("NDVI_mean" + 1e-6, 3) as "NDVI_mean") from covars', **COVAR_CTES),
    "final_analytic": with_views("select " + sql_rounded(
        "tract_geoid, n_pws_ucmr as n_cws_ucmr, dcpa_detectpws as dcpa_detectcws, "
        'pfoa_35_detectpws as pfoa_35_detectcws, "race_totalE" as race_total_e, "MEDHHINC" as medhhinc, '
        '"ALAND10" as aland10, "NDVI_max" as ndvi_max, tree_can, co_geoid, smoking_prev, smoking_prev_lower, '
        "smoking_prev_upper, round(dcpa_medpws_weighted, 6) as dcpa_medcws_weighted, "
        "round(dcpa_maxpws_weighted, 6) as dcpa_maxcws_weighted, "
        "round(pfoa_35_medpws_weighted, 6) as pfoa_35_medcws_weighted, round(ct_pop_pws, 4) as ct_pop_cws, "
        "round(pws_coverage_proportion, 3) as cws_coverage_proportion, round(prop_no_pws, 3) as prop_no_cws, "
        'round("NDVI_mean" + 1e-6, 3) as ndvi_mean, '
        + ", ".join(f'round("{c}", 6) as {c.lower()}' for c in DEMO_DIGITS), tract_total_pop=2)
        + """ from exposure left join covars using (tract_geoid)
where pws_coverage_proportion >= 0.5
  and not cast(substr(tract_geoid, 6) as integer) between 980000 and 989999""", **COVAR_CTES),
    "final_violations": with_views("".join(
        f"""select '{column}' as "column", '{rule}' as rule, {count}::bigint as n from final_rows union all """
        for (column, rule), count in _BROKEN.items()) + """
select 'tract_geoid', 'repeated', coalesce(sum(n), 0)::bigint
from (select count(*) as n from final_rows group by tract_geoid having count(*) > 1)""", **COVAR_CTES, final_rows=FINAL_ROWS),
}
