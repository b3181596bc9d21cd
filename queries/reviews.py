"""Sample rounds and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.views import Views, with_views
from queries.weighting import rounded, sql_rounded
from zonewise.functions.columns import suffix_cols
from zonewise.functions.numeric import row_max, row_median
from zonewise.operators import checks, samples, weights
from zonewise.operators.covariates import full_reduce
from zonewise.plans import exposure

SOURCES = [samples.Source(a, r) for a in ("arsenic", "tthm") for r in ("syr3", "syr4")]


def medians(v: Views, keep: bool = False) -> DataFrame:
    return samples.review_medians(v.samples(), SOURCES, keep_components=keep)


def nondetect_summary(v: Views) -> DataFrame:
    out = samples.summarise(v.samples(), ["pwsid", "analyte", "review"])
    return rounded(out, min=6, median=6, detect_level_med=6, mean=6, max=6, sd=6)


def plain_summary(v: Views) -> DataFrame:
    """Statistics without substitution, as for the round that has no detection limits."""
    out = samples.summarise(v.samples(), ["pwsid"], limit=None)
    return rounded(out, min=6, median=6, mean=6, max=6, sd=6)


def summary_null_keys(v: Views) -> DataFrame:
    """One analyte's name is missing: its samples form a group of their own."""
    unnamed = v.samples().withColumn("analyte", F.nullif(F.col("analyte"), F.lit("tthm")))
    out = samples.summarise(unnamed, ["analyte", "review"])
    return rounded(out, min=6, median=6, detect_level_med=6, mean=6, max=6, sd=6)


ROUND_TWO = [samples.Source("arsenic", "syr2", substitute=False, strict_flag=True, unit_scale=1000.0)]


def review_round_two(v: Views) -> DataFrame:
    """The earliest round: no substitution, a flag that knows missing codes, and another unit."""
    early = v.samples().where("analyte = 'arsenic' and review = 'syr3'").withColumn("review", F.lit("syr2"))
    return rounded(samples.review_medians(early, ROUND_TWO), arsenic_fin_median=6)


def stitch_by_full_join(v: Views) -> DataFrame:
    """The rounds as separate tables, suffixed and full-joined; systems differ by round."""
    frames = []
    for source in SOURCES:
        own = v.samples().where((F.col("analyte") == source.analyte) & (F.col("review") == source.review))
        stats = own.groupBy("pwsid").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
        frames.append(suffix_cols(stats, source.label, ["pwsid"]))
    return full_reduce(frames, "pwsid")


def row_statistics(v: Views) -> DataFrame:
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        *(F.when(F.col("l_linenumber") % k != 0, F.col(c)).alias(n)
          for n, c, k in (("a", "l_quantity", 2), ("b", "l_discount", 3), ("c", "l_tax", 1000))),
        F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).alias("d"),
    )


def row_median_query(v: Views) -> DataFrame:
    return row_statistics(v).select(
        "l_orderkey", "l_linenumber", F.round(row_median(*(F.col(c) for c in ("a", "b", "d"))), 6).alias("mid")
    )


def row_max_query(v: Views) -> DataFrame:
    rows = row_statistics(v)
    return rows.select(
        "l_orderkey", "l_linenumber",
        row_max(rows, ["a", "b", "d", "absent"]).alias("largest"),
        row_max(rows, ["d", "absent"]).alias("single"),
    )


def tract_review_exposure(v: Views) -> DataFrame:
    served = weights.served_population(v.bg_pws(), v.measures())
    return rounded(
        exposure.review_exposure(served, medians(v)),
        arsenic_fin_median_weighted=6, tthm_fin_median_weighted=6, ct_pop_pws_syr=4,
    )


def distribution_summary(v: Views) -> DataFrame:
    """Spread of median prices per order; an order with a returned line has none."""
    lines = v.table("lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price")
    )
    return rounded(checks.distribution(lines, "l_orderkey", "price"), min=6, q1=6, median=6, mean=4, q3=6, max=6)


QUERIES = {
    "nondetect_summary": nondetect_summary,
    "plain_summary": plain_summary,
    "summary_null_keys": summary_null_keys,
    "review_round_two": review_round_two,
    "row_median": row_median_query,
    "row_max": row_max_query,
    "sample_stitch": lambda v: rounded(medians(v), arsenic_fin_median=6, tthm_fin_median=6),
    "sample_stitch_components": lambda v: rounded(
        medians(v, keep=True), arsenic_fin_median=6, tthm_fin_median=6,
        **{f"median_{s.label}": 6 for s in SOURCES},
    ),
    "full_reduce": stitch_by_full_join,
    "tract_review_exposure": tract_review_exposure,
    "distribution_summary": distribution_summary,
}

READY = """
select *, coalesce(value, coalesce(detection_limit_value, 0) / sqrt(2)) as reading,
       coalesce(detection_limit_value, 0) as dl from samples"""
PER_ROUND = """
select pwsid, concat(analyte, '_', review) as source, median(reading) as med,
       case when sum(case when detect = 1 then 1 else 0 end) > 0 then 1.0::double
            when count(detect) < count(*) then null else 0.0::double end as flag
from ready group by all"""


def _mid(a: str, b: str) -> str:
    return f"case when {a} is null then {b} when {b} is null then {a} else ({a} + {b}) / 2 end"


WIDE = "select pwsid, " + ", ".join(
    f"max(case when source = '{s.label}' then med end) as median_{s.label}, "
    f"max(case when source = '{s.label}' then flag end) as detect_{s.label}"
    for s in SOURCES
) + " from per_round group by 1"
FINAL = f"""
select *, {_mid('median_arsenic_syr3', 'median_arsenic_syr4')} as arsenic_fin_median,
       {_mid('median_tthm_syr3', 'median_tthm_syr4')} as tthm_fin_median,
       greatest(detect_arsenic_syr3, detect_arsenic_syr4) as arsenic_detect_flag,
       greatest(detect_tthm_syr3, detect_tthm_syr4) as tthm_detect_flag
from wide"""
STITCH = {"ready": READY, "per_round": PER_ROUND, "wide": WIDE, "final": FINAL}

ROWS = """
select l_orderkey, l_linenumber, case when l_linenumber % 2 <> 0 then l_quantity end as a,
       case when l_linenumber % 3 <> 0 then l_discount end as b,
       case when l_quantity > 25 then l_extendedprice end as d
from lineitem"""


ORACLES = {
    "nondetect_summary": with_views("""
select pwsid, analyte, review, round(min(reading), 6) as min, round(median(reading), 6) as median,
       round(median(dl), 6) as detect_level_med, round(avg(reading), 6) as mean, round(max(reading), 6) as max,
       round(stddev_samp(reading), 6) as sd from ready group by all""", ready=READY),
    "plain_summary": with_views("""
select pwsid, round(min(value), 6) as min, round(median(value), 6) as median, round(avg(value), 6) as mean,
       round(max(value), 6) as max, round(stddev_samp(value), 6) as sd from samples group by 1"""),
    "summary_null_keys": with_views("""
select nullif(analyte, 'tthm') as analyte, review, round(min(reading), 6) as min, round(median(reading), 6) as median,
       round(median(dl), 6) as detect_level_med, round(avg(reading), 6) as mean, round(max(reading), 6) as max,
       round(stddev_samp(reading), 6) as sd from ready group by 1, 2""", ready=READY),
    "review_round_two": with_views("""
select pwsid, round(median(value) * 1000, 6) as arsenic_fin_median,
       case when count(detect) = count(*) then max(detect) end as arsenic_detect_flag
from samples where analyte = 'arsenic' and review = 'syr3' group by 1"""),
    "row_median": with_views(
        "select l_orderkey, l_linenumber, round(list_median([a, b, d]), 6) as mid from r", r=ROWS
    ).replace("list_median([a, b, d])", "list_aggregate([a, b, d], 'median')"),
    "row_max": with_views(
        "select l_orderkey, l_linenumber, greatest(a, b, d) as largest, d as single from r", r=ROWS),
    "sample_stitch": with_views("select " + sql_rounded(
        "pwsid, arsenic_detect_flag, tthm_detect_flag", arsenic_fin_median=6, tthm_fin_median=6) + " from final",
        **STITCH),
    "sample_stitch_components": with_views("select " + sql_rounded(
        "pwsid, arsenic_detect_flag, tthm_detect_flag, " + ", ".join(f"detect_{s.label}" for s in SOURCES),
        arsenic_fin_median=6, tthm_fin_median=6, **{f"median_{s.label}": 6 for s in SOURCES}) + " from final",
        **STITCH),
    "full_reduce": with_views("select pwsid, " + ", ".join(
        f"max(case when analyte = '{s.analyte}' and review = '{s.review}' then value end) as peak_{s.label}, "
        f"nullif(count(*) filter (analyte = '{s.analyte}' and review = '{s.review}'), 0) as n_{s.label}"
        for s in SOURCES) + " from samples group by 1"),
    "tract_review_exposure": with_views("""
select tract_geoid, round(round(sum(arsenic_fin_median * bg_wgt_pop) / sum(bg_wgt_pop), 9), 6) as arsenic_fin_median_weighted,
       round(round(sum(tthm_fin_median * bg_wgt_pop) / sum(bg_wgt_pop), 9), 6) as tthm_fin_median_weighted,
       count(*) as n_pws_syr, round(sum(bg_wgt_pop), 4) as ct_pop_pws_syr,
       max(arsenic_detect_flag) as arsenic_detect_flag, max(tthm_detect_flag) as tthm_detect_flag
from served left join final using (pwsid) group by 1""", **STITCH),
    "distribution_summary": """
select round(min(m), 6) as min, round(quantile_cont(m, 0.25), 6) as q1, round(median(m), 6) as median,
       round(avg(m), 4) as mean, round(quantile_cont(m, 0.75), 6) as q3, round(max(m), 6) as max,
       count(*) filter (m is null) as n_missing
from (select l_orderkey, case when count(*) filter (l_returnflag = 'R') = 0 then median(l_extendedprice) end as m
      from lineitem group by 1)""",
}
