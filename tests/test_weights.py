import pytest
from pyspark.sql import functions as F

from zonewise.operators import checks, weights
from zonewise.operators.scale import attach_totals, join_groups
from zonewise.plans import exposure


def pairs(spark, rows):
    return spark.createDataFrame(rows, "geoid string, pwsid string, overlap_area double, zone_area double, value double")


@pytest.fixture
def overlay(spark):
    return pairs(
        spark,
        [
            # weights add up to over 1: 0.722 and 0.885 of 796 people
            ("01001000100A", "S1", 72.2, 100.0, 796.0),
            ("01001000100A", "S2", 88.5, 100.0, 796.0),
            # below 1, and a repeated pair
            ("01001000100B", "S1", 10.0, 100.0, 50.0),
            ("01001000100B", "S1", 15.0, 100.0, 50.0),
            # nobody lives here
            ("01001000200A", "S2", 50.0, 100.0, 0.0),
            # a system without measurements
            ("01001000200B", "S9", 50.0, 100.0, 40.0),
            ("01001000200B", "S3", 50.0, 100.0, 40.0),
            # a zone of no size
            ("01001000300A", "S3", 1.0, 0.0, 10.0),
        ],
    )


@pytest.fixture
def measures(spark):
    return spark.createDataFrame(
        [("S1", 1.0, 0.0), ("S2", None, None), ("S3", 4.0, 1.0), ("S7", 9.0, 1.0)],
        "pwsid string, dcpa_medpws double, dcpa_detectpws double",
    )


def totals(spark):
    return spark.createDataFrame(
        [("01001000100", 846.0), ("01001000200", 40.0)], "tract_geoid string, tract_total_pop double"
    )


def test_capping_keeps_the_population(spark, overlay):
    rows = weights.areal_weights(weights.dedupe_pairs(overlay)).where("geoid = '01001000100A'")
    got = {r.pwsid: r.bg_wgt_pop for r in rows.collect()}
    assert got["S1"] == pytest.approx(357.63, abs=0.01)
    assert got["S2"] == pytest.approx(438.37, abs=0.01)
    assert sum(got.values()) == pytest.approx(796.0)


def test_uncapped_audit_example(spark, overlay):
    audit = checks.weight_audit(weights.dedupe_pairs(overlay))
    assert audit.agg(F.sum("bg_wgt_pop")).first()[0] == pytest.approx(1279.17, abs=0.01)


def test_published_overlap_example(spark):
    one = pairs(
        spark,
        [("100010001001", "S1", 1724054.0, 49674152.68, 2637.0), ("100010001002", "S1", 2.53, 100.0, 100.0)],
    )
    weighted = weights.areal_weights(one)
    assert weighted.where("geoid = '100010001001'").first().bg_wgt_pop == pytest.approx(91.52, abs=0.01)
    assert weights.rollup(weighted).first().bg_wgt_pop == pytest.approx(94.05, abs=0.01)


def test_eligible_systems(spark, overlay, measures):
    assert {r.pwsid for r in weights.eligible_systems(measures, overlay).collect()} == {"S1", "S2", "S3"}


def test_repeated_pair_is_added_and_attributes_do_not_fan_out(spark, overlay, measures):
    attributes = spark.createDataFrame(
        [("01001000100", "S1", "a", 1.0), ("01001000100", "S1", "a", 2.0)],
        "tract_geoid string, pwsid string, name string, area double",
    )
    served = weights.served_population(overlay, measures, attributes)
    assert served.groupBy("tract_geoid", "pwsid").count().where("count > 1").count() == 0
    s1 = served.where("pwsid = 'S1'").first()
    assert s1.bg_wgt_pop == pytest.approx(796 * 0.722 / 1.607 + 12.5)
    assert s1.area == 2.0


def test_tract_exposure(spark, overlay, measures):
    served = weights.served_population(overlay, measures)
    got = {r.tract_geoid: r for r in exposure.tract_exposure(served, measures, totals(spark)).collect()}
    one, two = got["01001000100"], got["01001000200"]
    share = (796 * 0.722 / 1.607 + 12.5) / (796 + 12.5)
    assert one.dcpa_medpws_weighted == pytest.approx(share, abs=1e-8)  # the unmeasured keeps its share
    assert (one.dcpa_detectpws, one.n_pws_ucmr) == (0.0, 2)
    assert one.pws_coverage_proportion == pytest.approx(round(808.5 / 846, 3))
    assert (two.dcpa_medpws_weighted, two.dcpa_detectpws, two.pws_coverage_proportion) == (4.0, 1.0, 0.5)
    assert "01001000300" not in got


def test_renormalized_exposure_ignores_the_unmeasured(spark, overlay, measures):
    served = weights.served_population(overlay, measures)
    out = exposure.tract_exposure(served, measures, totals(spark), renormalize=True)
    assert out.where("tract_geoid = '01001000100'").first().dcpa_medpws_weighted == pytest.approx(1.0)


def test_repeated_measurements_scale_back(spark, overlay, measures):
    served = weights.served_population(overlay, measures)
    doubled = measures.unionByName(measures)
    once = exposure.tract_exposure(served, measures, totals(spark)).orderBy("tract_geoid").collect()
    twice = exposure.tract_exposure(served, doubled, totals(spark)).orderBy("tract_geoid").collect()
    for a, b in zip(once, twice, strict=True):
        assert a.n_pws_ucmr == b.n_pws_ucmr and a.ct_pop_pws == pytest.approx(b.ct_pop_pws)
        assert a.dcpa_medpws_weighted == pytest.approx(b.dcpa_medpws_weighted)
    shares = weights.population_weight(served, "tract_geoid", doubled)
    per_tract = shares.groupBy("tract_geoid").agg(F.sum("population_weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in per_tract)


def test_system_exposure_gives_the_value_back(spark, overlay, measures):
    published = spark.createDataFrame(
        [("S1", 3000.0), ("S2", None), ("S3", 0.0)], "pwsid string, population_served_count double"
    )
    served = weights.served_population(overlay, measures)
    got = {r.pwsid: r for r in exposure.system_exposure(served, measures, published).collect()}
    assert got["S1"].dcpa_medpws_weighted_sum == pytest.approx(1.0)
    assert got["S2"].dcpa_medpws_weighted_sum == 0.0 and got["S2"].dcpa_detectpws is None
    assert got["S1"].inclusion_flag == "yes"
    assert got["S2"].inclusion_flag is None and got["S3"].capture_rate is None


def test_served_never_exceeds_total(spark, overlay, measures):
    served = weights.served_population(overlay, measures)
    out = exposure.tract_exposure(served, measures, totals(spark))
    assert out.where("ct_pop_pws > tract_total_pop + 1e-6").count() == 0


def test_allocate(spark):
    counts = spark.createDataFrame([("a", 10.0), ("b", 4.0)], "src string, pop double")
    cross = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.75), ("b", "y", 1.0)], "src string, dst string, weight double")
    got = {r.dst: r.pop for r in weights.allocate(counts, cross, ["pop"], "src", "dst").collect()}
    assert got == {"x": 2.5, "y": 11.5}


def hot(spark):
    """One key, and NULL, with most of the rows."""
    return spark.range(300).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k")
    )


def test_attach_totals_with_hot_and_null_keys(spark):
    rows = attach_totals(hot(spark), ["k"], n=F.count(F.lit(1)), top=F.max("id")).collect()
    assert len(rows) == 300
    assert {(r.n, r.top) for r in rows if r.k == "hot"} == {(100, 297)}
    assert {(r.n, r.top) for r in rows if r.k is None} == {(100, 299)}
    assert all(r.n == 1 and r.top == r.id for r in rows if r.k not in ("hot", None))


def test_join_groups_matches_null_keys_and_keeps_column_order(spark):
    right = spark.createDataFrame([("hot", 1), ("4", 2), (None, 3)], "k string, v int")
    got = join_groups(hot(spark), right, ["k"])
    assert got.columns == ["id", "k", "v"]
    values = {r.id: r.v for r in got.collect()}
    assert len(values) == 300 and values[0] == 1 and values[2] == 3 and values[4] == 2 and values[7] is None


def test_repeated_measurements_give_a_system_one_row(spark, overlay, measures):
    served = weights.served_population(overlay, measures)
    published = spark.createDataFrame([("S1", 100.0)], "pwsid string, population_served_count double")
    twice = measures.unionByName(spark.createDataFrame([("S1", 1.0, 1.0)], measures.schema))
    rows = exposure.system_exposure(served, twice, published).where("pwsid = 'S1'").collect()
    assert [r.dcpa_detectpws for r in rows] == [1.0]
