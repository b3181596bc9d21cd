import math
import gzip
import os
import statistics

import pytest
from pyspark.sql import functions as F

from zonewise import lookups
from zonewise.functions import columns, ids, numeric, text
from zonewise.operators import aggregate, checks, coverage, covariates, quantiles, reshape, samples
from zonewise.plans import tables
from zonewise.sources import files


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_detect_flags(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", 0.0), ("b", None), ("c", None), ("d", 0.0)], "g string, d double"
    )
    out = df.groupBy("g").agg(
        aggregate.any_detect(F.col("d")).alias("loose"),
        aggregate.any_detect(F.col("d"), strict=True).alias("strict"),
        aggregate.strict_max(F.col("d")).alias("top"),
        aggregate.weighted_sum(F.col("d")).alias("total"),
        aggregate.weighted_sum(F.col("d"), zero_fill=True).alias("filled"),
    )
    got = {r.g: tuple(r)[1:] for r in out.collect()}
    assert got == {
        "a": (1.0, 1.0, None, 1.0, 1.0),
        "b": (0.0, None, None, 0.0, 0.0),
        "c": (None, None, None, None, 0.0),
        "d": (0.0, 0.0, 0.0, 0.0, 0.0),
    }


def test_row_statistics(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (None, None, None), (5.0, None, None), (1.0, 9.0, 2.0)], "a double, b double, c double")
    assert column(df, numeric.row_median(F.col("a"), F.col("b"), F.col("c"))) == [2.0, None, 5.0, 2.0]
    assert column(df, numeric.row_max(df, ["a", "b", "gone"])) == [3.0, None, 5.0, 9.0]
    assert column(df, numeric.row_max(df, ["gone"])) == [None] * 4


def test_nondetects_and_single_row_sd(spark):
    df = spark.createDataFrame(
        [("a", None, 2.0), ("a", 4.0, None), ("b", None, None)], "pwsid string, value double, detection_limit_value double"
    )
    got = {r.pwsid: r for r in samples.summarise(df, ["pwsid"]).collect()}
    assert got["a"].min == pytest.approx(math.sqrt(2)) and got["a"].detect_level_med == 1.0
    assert (got["b"].median, got["b"].sd) == (0.0, None)


def test_review_medians_units_and_strict_flags(spark):
    rows = [
        ("s1", "arsenic", "syr2", 0.001, None, 1.0), ("s1", "arsenic", "syr2", 0.003, None, None),
        ("s1", "arsenic", "syr3", 4.0, 1.0, 0.0), ("s2", "arsenic", "syr3", None, None, 0.0),
    ]
    df = spark.createDataFrame(
        rows, "pwsid string, analyte string, review string, value double, detection_limit_value double, detect double"
    )
    sources = [
        samples.Source("arsenic", "syr2", substitute=False, strict_flag=True, unit_scale=1000.0),
        samples.Source("arsenic", "syr3"),
    ]
    got = {r.pwsid: r for r in samples.review_medians(df, sources).collect()}
    assert (got["s1"].arsenic_fin_median, got["s1"].arsenic_detect_flag) == (3.0, 0.0)
    assert (got["s2"].arsenic_fin_median, got["s2"].arsenic_detect_flag) == (0.0, 0.0)


def test_exact_quantiles(spark):
    values = [0.0, -1.5, -1.5, 1e-310, 2.0, 2.0000001, 3e7, -4e300, 999.9999999999, 1000.0, 1000.0000001, 7.0, None]
    rows = [("odd", v) for v in values] + [("one", 5.0), ("gone", None), ("even", 1.0), ("even", 2.0)]
    rows += [("tight", 300 + i * 1e-9) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = quantiles.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75})
    got = {r.g: r for r in out.collect()}
    assert "gone" not in got
    known = sorted(v for v in values if v is not None)
    q1, m, q3 = statistics.quantiles(known, n=4, method="inclusive")
    assert (got["odd"].q1, got["odd"].m, got["odd"].q3) == pytest.approx((q1, m, q3), rel=1e-12)
    assert (got["one"].m, got["even"].m) == (5.0, 1.5)
    assert got["tight"].m == 300 + 50 * 1e-9


def test_medians_keep_null_keys_and_groups_without_values(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 4.0), ("a", None), ("b", 1.0)], "g string, v double")
    got = {r.g: r.m for r in quantiles.exact_medians(df, ["g"], {"m": "v"}).collect()}
    assert got == {None: 3.0, "a": None, "b": 1.0}
    full = {r.g: (r.min, r.median, r.mean) for r in samples.summarise(df, ["g"], "v", None).collect()}
    assert full == {None: (2.0, 3.0, 3.0), "a": (None, None, None), "b": (1.0, 1.0, 1.0)}


def test_ids(spark):
    df = spark.createDataFrame([("1001000100",), ("01001990001",), ("123456789012",), (None,)], "g string")
    assert column(df, ids.pad_geoid(F.col("g"))) == ["01001000100", "01001990001", "123456789012", None]
    tracts = spark.createDataFrame(
        [("01001990000",), ("01001980000",), ("01001945000",), ("01001000100",), ("01001XXXXXX",)], "g string"
    )
    assert column(tracts, ids.tract_type(F.col("g"))) == ["water", "special_land_use", "american_indian_area", "standard", "standard"]
    one = spark.createDataFrame([("G0100010000100",)], "g string")
    assert column(one, ids.gisjoin_to_geoid(F.col("g"))) == ["01001000100"]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["HCFC22_medpws", "pm25_daily_average(ug/m3)", "pfba_detectpws", "GEOID10"])
    assert columns.clean_names(df).columns == ["hcfc22_medpws", "pm25_daily_average_ug_m3", "pfba_detectpws", "geoid10"]
    assert columns.cols(df, ends_with="MEDPWS") == ["HCFC22_medpws"]
    assert columns.cols(df, ends_with="MEDPWS", ignore_case=False) == []
    assert columns.rename_by_pattern(df, lookups.FINAL_RENAMES).columns == [
        "HCFC22_medcws", "pm25_daily_average(ug/m3)", "pfba_5_detectcws", "GEOID10",
    ]
    assert columns.tag_by_stem(df, lookups.ROUND_OF).columns[:1] == ["HCFC22_medpws_UCMR3"]
    with pytest.raises(ValueError):
        columns.all_of(df, ["missing"])
    assert columns.any_of(df, ["missing", "GEOID10"]) == ["GEOID10"]


def test_text(spark):
    df = spark.createDataFrame([("Kent County, DE", "DE"), ("A, B, DE", "DE"), ("none", None)], "t string, s string")
    assert column(df, text.place_name(F.col("t"), F.col("s"))) == ["Kent County", "A B,", None]
    assert column(df, text.trailing_state(F.col("t"))) == ["DE", "DE", None]
    cells = spark.createDataFrame([("23.1 (22.0,24.2)",), ("n/a",), (None,)], "e string")
    got = covariates.parse_interval(cells, "e", "p").select("p", "p_lower", "p_upper").collect()
    assert [tuple(r) for r in got] == [(23.1, 22.0, 24.2), (None, None, None), (None, None, None)]


def test_split_entities_shares_the_state(spark):
    df = spark.createDataFrame([("A/B/C/D/E, PA", 1.0), ("F, DE", 2.0)], "county string, v double")
    got = covariates.split_entities(df, "county").collect()
    assert [(r.name_clean, r.state_abb, r.v) for r in got] == [
        ("A", "PA", 1.0), ("B", "PA", 1.0), ("C", "PA", 1.0), ("D", "PA", 1.0), ("E", "PA", 1.0), ("F", "DE", 2.0),
    ]


@pytest.mark.parametrize("bits", [21, 1])
def test_fill_down(spark, monkeypatch, bits):
    monkeypatch.setattr(covariates, "FILL_BITS", bits)
    rows = [("g", i, f"v{i}" if i in (2, 9) else None) for i in range(14)] + [("h", 5, None), ("h", 6, "x")]
    out = covariates.fill_down(spark.createDataFrame(rows, "g string, i int, v string"), "v", "i", ["g"])
    got = {(r.g, r.i): r.v for r in out.collect()}
    assert [got[("g", i)] for i in range(14)] == [None] * 2 + ["v2"] * 7 + ["v9"] * 5
    assert (got[("h", 5)], got[("h", 6)]) == (None, "x")


def test_fill_down_with_null_groups_ties_and_sparse_ordinals(spark):
    rows = [(None, 0, "a"), (None, 10**12, None), ("g", 5, None), ("g", 5, "b"), ("g", 7 * 10**13, None)]
    out = covariates.fill_down(spark.createDataFrame(rows, "g string, i long, v string"), "v", "i", ["g"])
    assert sorted((r.i, r.v) for r in out.collect()) == [(0, "a"), (5, "b"), (5, "b"), (10**12, "a"), (7 * 10**13, "b")]


def test_measure_labels(spark):
    wide = spark.createDataFrame([("t", 1.0, 2.0, 0.0)], ["id", "pfoa_35_medpws_weighted", "HCFC22_maxpws", "weird_detectpws"])
    long = reshape.parse_measure(reshape.to_long(wide, ["id"]))
    rows = long.select("contaminant", "stat_clean", reshape.contaminant_group(F.col("contaminant"))).collect()
    assert {tuple(r) for r in rows} == {
        ("pfoa35", "median", "PFAS (Simplified)"),
        ("HCFC22", "max", "VOCs / Solvents"),
        ("weird", "detect_level", "Uncategorized"),
    }
    flags = spark.createDataFrame(
        [(f"{s}_detectpws",) for s in ("dcpa", "pfoa_35", "pfos_3", "chromium6", "haa9", "pfba", "pfasany_5t", "x")], "f string"
    )
    assert column(flags, reshape.round_of(F.col("f"))) == [
        "UCMR1", "UCMR3or5", "UCMR3", "UCMR3", "UCMR4", "UCMR5", "UCMR5", "Other",
    ]


def test_states(spark):
    table = lookups.states(spark)
    assert table.count() == 51 and table.select("state_fips").distinct().count() == 51
    df = spark.createDataFrame([("10",), ("03",), (None,)], "st_fips string")
    assert {(r.st_fips, r.state_abbr) for r in reshape.with_state(df).collect()} == {("10", "DE"), ("03", None), (None, None)}


def test_grid_and_rounds(spark):
    exposure = spark.createDataFrame(
        [
            ("01001000100", 10.0, 1.0, None, 0.9, True), ("01001000200", 5.0, 0.0, 0.0, 0.05, None),
            ("02001000100", 7.0, None, None, 0.5, True),
        ],
        "tract_geoid string, ct_pop_pws double, dcpa_detectpws double, pfba_detectpws double,"
        " pws_coverage_proportion double, b boolean",
    )
    totals = coverage.by_round(exposure, ["dcpa_detectpws", "pfba_detectpws"], ["b"])
    assert {tuple(r) for r in totals.collect()} == {("01", "UCMR1", 15.0, 10.0), ("01", "UCMR5", 5.0, None)}
    reference = spark.createDataFrame([("01", 30.0), ("02", 0.0)], "st_fips string, ref_pop double")
    rows = coverage.round_coverage(reference, ["UCMR1", "UCMR5"], totals, ["b"]).collect()
    table = {(r.st_fips, r.round): r for r in rows}
    assert len(table) == 4
    assert table[("01", "UCMR1")].main_cov == 0.5 and table[("01", "UCMR5")].cov_of_main_b == 0.0
    assert table[("02", "UCMR1")].main_cov is None and table[("02", "UCMR1")].cov_of_main_b is None


def test_arms(spark):
    exposure = spark.createDataFrame(
        [("01001000100", 10.0, 20.0, 0.5), ("01001000200", 5.0, 100.0, 0.05), ("02001000100", 7.0, 7.0, 1.0)],
        "tract_geoid string, ct_pop_pws double, tract_total_pop double, pws_coverage_proportion double",
    )
    served = spark.createDataFrame(
        [("01001000100", "S1"), ("01001000100", "S2"), ("02001000100", "S2")], "tract_geoid string, pwsid string"
    )
    systems = spark.createDataFrame([("S1", True), ("S2", False)], "pwsid string, a boolean")
    totals = coverage.arm_totals(coverage.with_arms(exposure, served, systems, ["a"]), ["a"])
    assert {tuple(r) for r in totals.collect()} == {
        ("01", 10.0, 20.0, 1, 10.0, 20.0, 1), ("02", 7.0, 7.0, 1, None, None, None),
    }


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v int")
    assert {(r.k, r.v, r.dupe_count) for r in checks.get_dupes(df, ["k"]).collect()} == {("a", 1, 2), ("a", 2, 2), (None, 3, 2), (None, 4, 2)}
    tab = {r.k: (r.n, r.percent, r.valid_percent) for r in checks.tabyl(df, "k").collect()}
    assert tab == {"a": (2, 0.4, pytest.approx(2 / 3)), "b": (1, 0.2, pytest.approx(1 / 3)), None: (2, 0.4, None)}
    assert tuple(checks.distinct_counts(df, ["k"]).first()) == (2,)
    assert tuple(checks.distinct_counts(df, ["k"], count_null=True).first()) == (3,)
    kept = checks.distinct_keep(df, ["k"], [-F.col("v")])
    assert {(r.k, r.v) for r in kept.collect()} == {("a", 2), (None, 4), ("b", 5)}
    other = spark.createDataFrame([(None,), ("b",)], "k string")
    assert checks.unmatched(df, other, ["k"]).count() == 4
    assert {r.v for r in checks.unmatched(df, other, ["k"], null_matches=True).collect()} == {1, 2}
    assert checks.any_not_null(df, ["k"]).count() == 3
    share = checks.share_with_data(df.withColumnRenamed("k", "pwsid"), spark.createDataFrame([("a",)], "pwsid string")).first()
    assert (share.systems_with_data, share.systems, share.prop_with_data) == (1, 5, 0.2)


def test_empty_excess(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "ct_pop_pws double, tract_total_pop double")
    assert tuple(checks.excess(df).first()) == (0, 0, 0, None, None)


def test_final_table_names_and_filters(spark):
    exposure = spark.createDataFrame(
        [("01001000100", 1.0, 0.5), ("01001980000", 2.0, 0.9), ("01001000200", 3.0, 0.4)],
        "tract_geoid string, pfba_medpws_weighted double, pws_coverage_proportion double",
    )
    covars = spark.createDataFrame([("01001000100", 0.3)], "tract_geoid string, `RACE_WHITENH` double")
    out = tables.final_analytic(exposure, covars)
    assert out.columns == ["tract_geoid", "pfba_5_medcws_weighted", "cws_coverage_proportion", "race_whitenh"]
    assert [tuple(r) for r in out.collect()] == [("01001000100", 1.0, 0.5, 0.3)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("01001", None), ("02", 1.5)], "geoid string, v double")
    files.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = files.read_csv_ids(spark, str(tmp_path / "out"), casts={"v": "double"})
    assert {tuple(r) for r in back.collect()} == {("01001", None), ("02", 1.5)}
    for folder, name in (("a", "x.csv"), ("b", "x.csv"), ("b", "y.csv"), ("b", "skip_me.csv")):
        os.makedirs(tmp_path / "many" / folder, exist_ok=True)
        (tmp_path / "many" / folder / name).write_text("id,n\n007,1\n")
    found = files.read_csv_collection(spark, str(tmp_path / "many"), exclude="skip|other")
    assert sorted(found) == ["a/x.csv", "b/x.csv", "b/y.csv"] and found["b/x.csv"].first().id == "007"
    with gzip.open(tmp_path / "zipped.csv.gz", "wt") as out:
        out.write('"STATE","pm25 daily average(ug/m3)"\n"01","7.5"\n')
    zipped = files.read_csv_ids(spark, str(tmp_path / "zipped.csv.gz"), casts={"pm25 daily average(ug/m3)": "double"})
    assert tuple(zipped.first()) == ("01", 7.5)
    (tmp_path / "t.txt").write_text("PWS ID\tResult (ug/L)\n001\tn/a\n")
    tab = files.read_delim(spark, str(tmp_path / "t.txt"), casts={"result_ug_l": "double"}).first()
    assert (tab.pws_id, tab.result_ug_l) == ("001", None)
    first = files.materialize_once(df, str(tmp_path / "once"))
    second = files.materialize_once(df.limit(0), str(tmp_path / "once"))
    assert first.count() == second.count() == 2
    files.write_parquet(df.withColumn("year", F.lit(2008)).unionByName(df.withColumn("year", F.lit(2009))), str(tmp_path / "p"), ["year"])
    one = files.read_dataset(spark, str(tmp_path / "p"), "year = 2008", ["geoid"])
    assert one.count() == 2 and "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
