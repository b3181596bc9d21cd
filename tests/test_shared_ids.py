"""The views cut ids to six digits: from key 1,000,000 on boxes far apart share an id. Each stays a ring of its own."""

import time

import pytest
from pyspark.sql import functions as F

from queries import spatial
from queries.views import Views
from zonewise.operators import geometry as g
from zonewise.operators import overlay as o

# Three zones named Z100000, and two systems named S100000, over the zones of the middle rows.
ZONES = [*range(1200, 1440), 100000, 1000000, 1000001]
SYSTEMS = [100000, 1000000]


def zone_box(key):
    return f"Z{str(key)[:6].zfill(6)}", key % 40 * 10, key // 40 * 10, 10, 10


def system_box(key):
    return f"S{str(key)[:6].zfill(6)}", key * 37 % 380 + 3.5, key * 53 % 480 + 2.5, 5 + key % 60, 5 + key % 45


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    spark.createDataFrame([(k, 1.0) for k in ZONES], "p_partkey long, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k,) for k in SYSTEMS], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    return Views(spark, folder)


def expected(widen=1.0):
    out = {}
    for zone, zx, zy, zw, zh in map(zone_box, ZONES):
        for system, sx, sy, sw, sh in map(system_box, SYSTEMS):
            w = min(zx + zw, sx + sw * widen) - max(zx, sx)
            h = min(zy + zh, sy + sh) - max(zy, sy)
            if w > 0 and h > 0:
                out[zone, system] = out.get((zone, system), 0) + w * h
    return out


def test_boxes_of_one_id_are_not_strung_together(views):
    zones = spatial.zones(views)
    assert zones.agg(F.max(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))).first()[0] == 10
    assert {r.id: r.area for r in g.area(zones).collect()}["Z100000"] == 300
    # Grows with the boxes, not with the way from one to the other.
    assert o.tile(zones, spatial.CELL).count() < 20 * len(ZONES)


def areas(df):
    return {(r.zone_id, r.pwsid): r.overlap_area for r in df.collect()}


def test_overlap_of_boxes_that_share_an_id(views):
    assert areas(spatial.pairs_of_boxes(views)) == pytest.approx(expected())


def test_stored_overlap_of_boxes_that_share_an_id(views):
    assert areas(spatial.stored_overlap(views)) == pytest.approx(expected())


def test_diamonds_that_share_an_id(views):
    got = areas(spatial.QUERIES["overlay_polygons"](views))
    # The zones cover both diamonds; each is half its box, less a hole of an eighth.
    assert sum(got.values()) == pytest.approx(sum(0.375 * w * h for _, _, _, w, h in map(system_box, SYSTEMS)), abs=1e-2)
    assert got.keys() <= expected().keys()


def test_dissolve_of_boxes_that_share_an_id(views):
    assert areas(spatial.dissolve(views)) == pytest.approx(expected())


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}


@pytest.mark.parametrize("query", [spatial.stored_overlap, spatial.dissolve])
def test_steps_that_are_kept_leave_no_shuffle_files(spark, views, query):
    before = shuffle_files(spark)
    query(views)
    for _ in range(50):  # they go shortly after
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left


def test_zones_beyond_the_systems_are_not_kept(views):
    zones, systems = o.tile(spatial.zones(views), spatial.CELL), o.tile(spatial.systems(views), spatial.CELL)
    low, high = systems.agg(F.min("r"), F.max("r")).first()
    kept = o._in_range(zones, systems, []).select("id", "c", "r").distinct()
    assert kept.where(~F.col("r").between(low, high)).isEmpty()
    cells = systems.select("c", "r").distinct()
    met = zones.select("id", "c", "r").distinct().join(cells, ["c", "r"])
    assert met.join(kept, ["id", "c", "r"], "left_anti").isEmpty()
    assert kept.count() < zones.select("id", "c", "r").distinct().count()
