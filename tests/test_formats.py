"""Projections against published points, hexadecimal outlines against struct."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from zonewise.operators import geometry as g
from zonewise.sources import wkb

# Worked examples of Snyder, Map Projections (1987), on the ellipsoid of Clarke 1866.
CLARKE = g.Ellipsoid(6378206.4, 1 - math.sqrt(1 - 0.00676866))
PUBLISHED = [
    (g.TransverseMercator(0.0, -75.0, 0.9996, 0.0), -73.5, 40.5, 127106.5, 4484124.4),
    (g.Albers(23.0, -96.0, 29.5, 45.5), -75.0, 35.0, 1885472.7, 1535925.0),
]


@pytest.mark.parametrize("projection, lon, lat, x, y", PUBLISHED)
def test_published_points(spark, projection, lon, lat, x, y):
    at = spark.range(1).select(g.projected(projection, F.lit(lon), F.lit(lat), CLARKE).alias("p")).first().p
    assert (at.x, at.y) == pytest.approx((x, y), abs=0.06)


def test_regions_choose_their_projection(spark):
    rows = [("AK", -154.0, 50.0), ("HI", -158.0, 21 + 1 / 6), ("contiguous", -96.0, 23.0), ("PR", -96.0, 23.0), (None, -96.0, 23.0)]
    got = g.project_by_region(spark.createDataFrame(rows, "region string, lon double, lat double"))
    at = {r.region: (r.x, r.y) for r in got.collect()}
    assert at["HI"] == pytest.approx((500000 / g.US_FOOT, 0.0), abs=1e-5)
    assert all(at[k] == pytest.approx((0.0, 0.0), abs=1e-6) for k in ("AK", "contiguous", "PR", None))


def polygon(rings, code, order, dims, reference=False):
    out = struct.pack(f"{order}I", len(rings))
    for ring in rings:
        out += struct.pack(f"{order}I", len(ring)) + b"".join(struct.pack(f"{order}{dims}d", *p[:dims]) for p in ring)
    head = struct.pack("B", order == "<") + struct.pack(f"{order}I", code)
    return head + (struct.pack(f"{order}I", 5070) if reference else b"") + out


OUTER = [(0.0, 0.0, 7.0, 1.0), (-4.25, 1e-9, 7.0, 2.0), (1e300, -3.0, 7.0, 3.0), (0.0, 0.0, 7.0, 1.0)]
HOLE = [(0.1, 0.2, 7.0, 1.0), (1 / 3, 2 / 3, 7.0, 2.0), (5e-324, 12345678.9, 7.0, 3.0)]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize(
    "code, dims, reference",
    [(3, 2, False), (1003, 3, False), (2003, 3, False), (3003, 4, False), (3 + wkb.HAS_Z, 3, False),
     (3 + wkb.HAS_Z + wkb.HAS_M, 4, False), (3 + wkb.HAS_REFERENCE, 2, True)],
)
def test_hex_is_read(spark, order, code, dims, reference):
    one = polygon([OUTER, HOLE], code, order, dims, reference)
    parts = [polygon([OUTER], 3, "<", 2), polygon([HOLE, OUTER], 1003, ">", 3), polygon([], 3, ">", 2)]
    many = struct.pack("B", order == "<") + struct.pack(f"{order}II", 6, len(parts)) + b"".join(parts)
    rows = [("one", one.hex()), ("many", many.hex().upper()), ("none", None), ("no bytes", "zz"), ("short", "01"), ("point", "0101000000" + "00" * 16)]
    got = wkb.vertices_from_hex_wkb(spark.createDataFrame(rows, "id string, geom_wkb string"), "geom_wkb").collect()
    want = {("one", 0, k, i, *p[:2]) for k, ring in enumerate((OUTER, HOLE)) for i, p in enumerate(ring)}
    want |= {("many", 0, 0, i, *p[:2]) for i, p in enumerate(OUTER)}
    want |= {("many", 1, k, i, *p[:2]) for k, ring in enumerate((HOLE, OUTER)) for i, p in enumerate(ring)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_hex_round_trip(spark):
    rows = [("a", 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, -1.5), (1e10, 3), (0.1, 1 / 3)])]
    rows += [("a", 0, 1, i, 1.0 + i, 2.0 ** -i) for i in range(4)] + [("a", 1, 0, i, -0.7 * i, 1e-300) for i in range(3)]
    given = spark.createDataFrame(rows, "id string, part int, ring int, seq int, x double, y double")
    told = wkb.hex_wkb_from_vertices(given)
    back = {tuple(r) for r in wkb.vertices_from_hex_wkb(told, "geom_wkb").collect()}
    assert set(rows) <= back and len(back) == len(rows) + 3
    assert told.first().geom_wkb.startswith("0000000006" + "00000002" + "0000000003" + "00000002" + "00000004")
