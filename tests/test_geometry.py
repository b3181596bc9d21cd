import math
import random

import pytest
from pyspark.sql import functions as F

from zonewise.operators import geometry as g
from zonewise.operators import overlay as o

VERTEX = "id string, part int, ring int, seq int, x double, y double"


def polygon(name, points, ring=0, part=0):
    return [(name, part, ring, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def edges(spark, rows):
    return g.normalize(g.edges_from_vertices(spark.createDataFrame(rows, VERTEX)))


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def star(rng, snap):
    cx, cy, size, n = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 30), rng.choice([3, 5, 9])
    ring = []
    for i in range(n):
        r = size * rng.uniform(0.4, 1)
        ring.append((cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)))
    return [(round(x / 5) * 5, round(y / 5) * 5) for x, y in ring] if snap else ring


def area_of(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def common_area(p, q):
    """Direct double sum over edges; no grid."""
    def signed(ring):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ax != bx:
                yield (-1, ax, ay, bx, by) if ax < bx else (1, bx, by, ax, ay)

    total = 0.0
    for s, a, b, c, d in signed(p):
        for t, e, f, h, i in signed(q):
            left, right = max(a, e), min(c, h)
            if left >= right:
                continue
            pl, pr = (b + (d - b) * (x - a) / (c - a) for x in (left, right))
            ql, qr = (f + (i - f) * (x - e) / (h - e) for x in (left, right))
            u, v = pl - ql, pr - qr
            apart = (abs(u) + abs(v)) / 2 if u * v >= 0 else (u * u + v * v) / (2 * (abs(u) + abs(v)))
            total += s * t * ((pl + ql + pr + qr) / 2 - apart) / 2 * (right - left)
    return total


@pytest.mark.parametrize("snap", [False, True], ids=["free", "on-grid"])
@pytest.mark.parametrize("cell, crowded", [(10.0, o.CROWDED_PAIRS), (30.0, 60)], ids=["plain", "cut-again"])
def test_overlap_of_stars(spark, snap, cell, crowded):
    rng = random.Random(3)
    a = {f"Z{i}": star(rng, snap) for i in range(14)}
    b = {f"S{i}": star(rng, snap) for i in range(14)}
    a, b = ({k: r for k, r in s.items() if abs(area_of(r)) > 1} for s in (a, b))
    left = edges(spark, [row for k, r in a.items() for row in polygon(k, r)])
    right = edges(spark, [row for k, r in b.items() for row in polygon(k, r)])
    sign = {k: math.copysign(1, area_of(r)) for k, r in {**a, **b}.items()}
    want = {
        (i, j): sign[i] * sign[j] * common_area(p, q) for i, p in a.items() for j, q in b.items()
    }
    want = {k: v for k, v in want.items() if v > 1e-6}
    found = o.overlap_area(left, right, cell, crowded_pairs=crowded)
    got = {(r.zone_id, r.pwsid): r.overlap_area for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_touching_and_contained_boxes(spark):
    z = edges(spark, polygon("in", box(2, 2, 1, 1)) + polygon("touch", box(10, 0, 5, 10)) + polygon("same", box(0, 0, 10, 10)))
    s = edges(spark, polygon("big", box(0, 0, 10, 10)))
    for cell in (5.0, 100.0):
        got = {r.zone_id: r.overlap_area for r in o.overlap_area(z, s, cell).collect()}
        assert got == pytest.approx({"in": 1.0, "same": 100.0})


def test_slivers_do_not_depend_on_the_cell(spark):
    z, s = edges(spark, polygon("z", box(0, 0, 1, 1))), edges(spark, polygon("s", box(0.9996, 0, 1, 1)))
    for cell in (1.0, 100.0, 1000.0):
        assert o.overlap_area(z, s, cell).first().overlap_area == pytest.approx(0.0004, rel=1e-6)


@pytest.mark.parametrize("numbers", [(0, 1, 2, 3), (1, 2, 3, 4), (0, 10, 20, 30), (0, 70_000, 140_000, 10**9)])
@pytest.mark.parametrize("ring", [0, None])
def test_rings_are_closed_whatever_their_numbers(spark, numbers, ring):
    rows = [("a", 0, ring, n, x, y) for n, (x, y) in zip(numbers, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    made = g.edges_from_vertices(spark.createDataFrame(rows, "id string, part int, ring int, seq long, x double, y double"))
    assert made.count() == 4 and g.area(made).first().area == 4.0


def test_hole_and_parts(spark):
    ring = polygon("ring", box(0, 0, 9, 9)) + polygon("ring", box(3, 3, 3, 3), ring=1) + polygon("ring", box(20, 0, 1, 1), part=1)
    s = edges(spark, polygon("s", box(2, 2, 30, 5)))
    z = edges(spark, ring)
    assert g.area(z).first().area == pytest.approx(81 - 9 + 1)
    assert o.overlap_area(z, s, 4.0).first().overlap_area == pytest.approx(35 - 9)


def test_normalize_turns_and_drops(spark):
    rows = polygon("a", box(0, 0, 2, 2)[::-1]) + polygon("a", [(5, 5), (6, 5)], part=1) + polygon("a", [(7, 7), (8, 8), (9, 9)], part=2)
    got = g.area(edges(spark, rows), ["id", "part"]).collect()
    assert [(r.part, r.area) for r in got] == [(0, 4.0)]


def test_repeated_closing_vertex(spark):
    points = box(0, 0, 2, 3)
    assert g.area(edges(spark, polygon("a", points + points[:1]))).first().area == 6.0


def test_invalid_polygons_are_found(spark):
    rows = (
        polygon("sound", box(0, 0, 4, 4))
        + polygon("bow", [(10, 0), (14, 4), (14, 0), (10, 5)])
        + polygon("twice", box(20, 0, 4, 4))
        + polygon("twice", box(22, 0, 4, 4), part=1)
    )
    got = {r.id: r.excess for r in o.invalid_polygons(edges(spark, rows), 3.0).collect()}
    assert got.keys() == {"bow", "twice"}
    assert got["twice"] == pytest.approx(16.0)


@pytest.mark.parametrize("limit", [None, 6], ids=["plain", "cut-again"])
def test_what_an_outline_covers_twice_counts_once(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(o, "UNITED_PAIRS", limit)
        monkeypatch.setattr(o, "CROWDED_PAIRS", limit)
    frame, hole = box(40, 0, 9, 9), box(43, 3, 3, 3)
    rows = (
        polygon("sound", box(0, 0, 4, 4))
        + polygon("twice", box(0, 0, 4, 4)) + polygon("twice", box(2, 1, 4, 4), part=1)
        + polygon("same", box(20, 0, 4, 4)) + polygon("same", box(20, 0, 4, 4), part=1)
        + polygon("bow", [(10, 0), (14, 4), (14, 0), (10, 4)]) + polygon("bow", box(10, 0, 2, 4), part=1)
        + polygon("frame", frame) + polygon("frame", hole, ring=1)
        + polygon("frame", frame, part=1) + polygon("frame", hole, ring=1, part=1)
        + polygon("sliver", [(30, 0), (34, 0), (34, 4), (30, 4), (30, 3), (30.001, 3), (30.001, 2.999), (30, 3.001)])
    )
    zone = edges(spark, polygon("z", box(1, 0.5, 70, 3)))
    systems = edges(spark, rows)
    open_one = systems.where("id = 'sound' and x1 = x2").withColumn("id", F.lit("open"))
    ids = spark.createDataFrame([("z",)], "zone_id string"), systems.select(F.col("id").alias("pwsid")).distinct()
    pairs, aside = o.overlay_and_quarantine(zone, systems.unionByName(open_one), 3.0, *ids)
    got = {r.pwsid: (r.overlap_area, r.system_area) for r in pairs.collect()}
    assert {(r.side, r.id, r.reason) for r in aside.collect()} == {("pwsid", "open", "not closed")}
    assert got.keys() == {"sound", "twice", "same", "bow", "frame", "sliver"}
    assert got["sound"] == pytest.approx((9.0, 16.0))
    assert got["twice"] == pytest.approx((9 + 2 * 2.5, 32 - 6))
    assert got["same"] == pytest.approx((12.0, 16.0))
    # A box over the left lobe, and the right lobe, whose tips the zone cuts off.
    assert got["bow"] == pytest.approx((6 + 4 - 0.25, 8 + 4))
    assert got["frame"] == pytest.approx((27 - 1.5, 72.0))
    assert got["sliver"] == pytest.approx((12.0, 16.0), abs=1e-4)


def test_zonal_mean(spark):
    zone = edges(spark, polygon("z", box(0.5, 0, 1, 1)) + polygon("none", box(50, 50, 1, 1)))
    pixels = spark.createDataFrame([(0, 0, 10.0), (1, 0, 30.0), (2, 0, 99.0), (0, 1, None)], "px int, py int, value double")
    rows = o.zonal_mean(zone, pixels, 1.0).collect()
    assert [(r.zone_id, r.mean, r.n_pixels) for r in rows] == [("z", 20.0, 2)]


def test_albers_keeps_the_origin_and_areas(spark):
    df = spark.createDataFrame([(-96.0, 23.0), (-96.0, 40.0), (-97.0, 40.0)], "lon double, lat double")
    a, b, c = g.project_albers(df, g.CONTIGUOUS).collect()
    assert (a.x, a.y) == pytest.approx((0.0, 0.0), abs=1e-6)
    assert b.x == pytest.approx(0.0, abs=1e-6) and b.y > 1.8e6
    assert c.x == pytest.approx(-85000, abs=1500)


def test_within_keeps_regions_apart(spark):
    z = edges(spark, polygon("z", box(0, 0, 2, 2))).withColumn("region", F.lit("AK"))
    s = edges(spark, polygon("s", box(0, 0, 2, 2)))
    assert o.overlap_area(z, s.withColumn("region", F.lit("HI")), 1.0, within=["region"]).count() == 0
    same = o.overlap_area(z, s.withColumn("region", F.lit("AK")), 1.0, within=["region"]).first()
    assert (same.region, same.overlap_area) == ("AK", 4.0)


def test_pieces_that_crowd_one_corner_are_cut_level_by_level(spark):
    rng = random.Random(8)
    z, s = [], []
    for i in range(30):
        z += polygon(f"z{i}", box(rng.uniform(0, 0.9), rng.uniform(0, 0.9), 0.05, 0.05))
        s += polygon(f"s{i}", box(rng.uniform(0, 0.9), rng.uniform(0, 0.9), 0.07, 0.07))
    z, s = edges(spark, z), edges(spark, s)
    sides = [o.tile(e, 100.0) for e in (z, s)]
    limit = 300
    (a, b), place = o._levelled(sides, [["id"], ["id"]], ["c", "r"], 100.0, limit)
    pairs = a.groupBy(*place).agg(F.count(F.lit(1)).alias("na")).join(b.groupBy(*place).agg(F.count(F.lit(1)).alias("nb")), place)
    # All of them lie in one cell, on a ten-thousandth of it.
    assert sides[0].count() * sides[1].count() > 10 * limit
    assert pairs.agg(F.max(F.col("na") * F.col("nb"))).first()[0] <= limit
    plain = {(r.zone_id, r.pwsid): r.overlap_area for r in o.overlap_area(z, s, 100.0).collect()}
    cut = {(r.zone_id, r.pwsid): r.overlap_area for r in o.overlap_area(z, s, 100.0, crowded_pairs=limit).collect()}
    assert cut == {k: pytest.approx(v, abs=1e-12) for k, v in plain.items()} and len(cut) > 2


def test_inner_pixels_are_runs(spark):
    rows = polygon("big", box(0.5, 0.25, 300, 200)) + polygon("tri", [(10, 10), (90, 15), (30, 80)])
    rows += polygon("ring", box(400, 0, 60, 60)) + polygon("ring", box(420, 20, 20, 20), ring=1)
    given = edges(spark, rows)
    edge, runs = o.pixel_cover(given, 1.0)
    assert edge.where("id = 'big'").count() + runs.where("id = 'big'").count() < 1500
    pixels = spark.range(470 * 210).selectExpr("cast(id % 470 as int) as px", "cast(id div 470 as int) as py", "(id * 37 % 101) * 1.0d as value")
    pixels = pixels.where("px % 7 <> 3 or py % 5 <> 2")
    want = o.cell_areas(o.tile(given, 1.0)).join(pixels.selectExpr("cast(px as bigint) as c", "cast(py as bigint) as r", "value"), ["c", "r"])
    want = want.groupBy("id").agg((F.sum(F.col("value") * F.col("area")) / F.sum("area")).alias("mean"), F.count(F.lit(1)).alias("n"))
    want = {r.id: (pytest.approx(r["mean"], rel=1e-9), r.n) for r in want.collect()}
    got = {r.zone_id: (r["mean"], r.n_pixels) for r in o.zonal_mean(given, pixels, 1.0).collect()}
    assert got == want and got["big"][1] > 50_000


@pytest.mark.parametrize("limit", [o.CROWDED_PAIRS, 40], ids=["calm", "crowded"])
def test_stored_tiles_meet_where_they_lie(spark, tmp_path, limit):
    rng = random.Random(4)
    z = edges(spark, [r for i in range(12) for r in polygon(f"z{i}", box(rng.uniform(0, 40), rng.uniform(0, 40), 9, 7))])
    s = edges(spark, [r for i in range(12) for r in polygon(f"s{i}", box(rng.uniform(0, 40), rng.uniform(0, 40), 8, 12))])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, side in (("stored_z", z), ("stored_s", s)):
            o.store_tiles(side, 20.0, name, f"{tmp_path}/{name}", buckets=3)
        found = o.overlap_of_stored(spark, "stored_z", "stored_s", 20.0, crowded_pairs=limit)
        got = {(r.zone_id, r.pwsid): r.overlap_area for r in found.collect()}
        plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
        if limit == o.CROWDED_PAIRS:
            assert "Exchange hashpartitioning(zone_id" in plan and "Exchange hashpartitioning(c" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists stored_z")
        spark.sql("drop table if exists stored_s")
    want = {(r.zone_id, r.pwsid): r.overlap_area for r in o.overlap_area(z, s, 20.0).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(got) > 5


def test_only_what_is_within_reach_is_cut(spark, monkeypatch):
    cut, tile = [], o.tile
    monkeypatch.setattr(o, "tile", lambda e, *a: cut.extend(r.id for r in e.select("id").distinct().collect()) or tile(e, *a))
    far = [row for i in range(5) for row in polygon(f"far{i}", box(0, 1000 * (i + 1), 4, 4))]
    z = edges(spark, polygon("z", box(0, 0, 4, 4)) + polygon("open", box(2, 2, 4, 4)) + far).where("id <> 'open' or x1 <> x2")
    s = edges(spark, polygon("s", box(3, 1, 4, 2)) + polygon("away", box(-50, 0, 4, 4)))
    ids = z.select(F.col("id").alias("zone_id")).distinct(), s.select(F.col("id").alias("pwsid")).distinct()
    pairs, aside = o.overlay_and_quarantine(z, s, 3.0, *ids)
    assert [(r.zone_id, r.pwsid, r.overlap_area, r.zone_area) for r in pairs.collect()] == [("z", "s", pytest.approx(2.0), 16.0)]
    assert {(r.side, r.id) for r in aside.collect()} == {("zone_id", "open")}
    assert sorted(cut) == ["s", "z"]
    # By region, and with one that only one side has.
    there = [e.withColumn("region", F.when(F.col("id").startswith("far"), "HI").otherwise("AK")) for e in (z, s)]
    pairs, _ = o.overlay_and_quarantine(*there, 3.0, *ids, within=["region"])
    assert [(r.region, r.zone_id, r.pwsid) for r in pairs.select("region", "zone_id", "pwsid").collect()] == [("AK", "z", "s")]
