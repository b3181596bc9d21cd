"""Repaired and dissolved outlines against figures worked out by hand and against coverage counted point by point."""

import random

import pytest
from test_geometry import box, edges, polygon

from zonewise.operators import outlines
from zonewise.operators import overlay as o

SHAPES = {
    # id: (rings, area, perimeter, parts, holes)
    "sound": (polygon("sound", box(0, 0, 4, 4)), 16, 16, 1, 0),
    "turned": (polygon("turned", box(0, 0, 4, 4)[::-1]), 16, 16, 1, 0),
    "twice": (polygon("twice", box(0, 0, 4, 4)) + polygon("twice", box(2, 1, 4, 4), part=1), 26, 22, 1, 0),
    "same": (polygon("same", box(20, 0, 4, 4)) + polygon("same", box(20, 0, 4, 4), part=1), 16, 16, 1, 0),
    "halves": (polygon("halves", box(20, 0, 4, 4)) + polygon("halves", box(24, 0, 4, 4), part=1), 32, 24, 1, 0),
    "bow": (polygon("bow", [(10, 0), (14, 4), (14, 0), (10, 4)]), 8, 8 + 2 * 32**0.5, 2, 0),
    "corner": (polygon("corner", box(0, 0, 2, 2)) + polygon("corner", box(2, 2, 2, 2), part=1), 8, 16, 2, 0),
    "spike": (polygon("spike", [(0, 0), (4, 0), (4, 4), (4, 8), (4, 4), (0, 4)]), 16, 16, 1, 0),
    "hole": (polygon("hole", box(40, 0, 9, 9)) + polygon("hole", box(43, 3, 3, 3), ring=1), 72, 48, 1, 1),
    "at the edge": (polygon("at the edge", box(0, 0, 6, 6)) + polygon("at the edge", box(0, 2, 2, 2), ring=1), 32, 28, 1, 0),
    "island": (
        polygon("island", box(40, 0, 9, 9)) + polygon("island", box(42, 2, 5, 5), ring=1)
        + polygon("island", box(43, 3, 3, 3), part=1) + polygon("island", box(44, 4, 1, 1), part=1, ring=1), 64, 72, 2, 2,
    ),
    "frame": (
        polygon("frame", box(40, 0, 9, 3)) + polygon("frame", box(40, 6, 9, 3), part=1)
        + polygon("frame", box(40, 0, 3, 9), part=2) + polygon("frame", box(46, 0, 3, 9), part=3), 72, 48, 1, 1,
    ),
}


@pytest.mark.parametrize("cell", [3.0, 50.0])
def test_shapes(spark, cell):
    given = edges(spark, [row for rows, *_ in SHAPES.values() for row in rows])
    fixed, aside = outlines.repair_and_quarantine(given, cell)
    got = {r.id: (r.area, r.perimeter, r.n_parts, r.n_holes) for r in outlines.summary(fixed).collect()}
    assert aside.count() == 0
    assert got == {k: pytest.approx(v[1:], abs=1e-6) for k, v in SHAPES.items()}
    assert o.invalid_polygons(fixed, cell).count() == 0


def test_random_rings_cover_the_same_points(spark):
    rng = random.Random(11)
    rows, rings = [], {}
    for k in range(12):
        parts = [[(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(7)] for _ in range(2)]
        rings[f"r{k}"] = parts
        rows += [row for p, ring in enumerate(parts) for row in polygon(f"r{k}", ring, part=p)]
    fixed = outlines.repair(edges(spark, rows), 6.0).collect()

    def winds(segments, x, y):
        return sum(
            (1 if x1 > x2 else -1)
            for x1, y1, x2, y2 in segments
            if min(x1, x2) <= x < max(x1, x2) and y1 + (y2 - y1) * (x - x1) / (x2 - x1) > y
        )

    for k, parts in rings.items():
        given = [[(*p, *q) for p, q in zip(r, r[1:] + r[:1])] for r in parts]
        own = [(r.x1, r.y1, r.x2, r.y2) for r in fixed if r.id == k]
        for _ in range(300):
            x, y = rng.uniform(-1, 21), rng.uniform(-1, 21)
            assert winds(own, x, y) == int(any(winds(s, x, y) for s in given))


def test_regions_and_unclosed_outlines(spark):
    rows = polygon("a", box(0, 0, 4, 4)) + polygon("b", box(0, 0, 4, 4)) + polygon("b", box(2, 0, 4, 4), part=1)
    given = edges(spark, rows)
    torn = given.where("id = 'a' and not (x1 = 4 and x2 = 4)").selectExpr("'torn' as id", "part", "ring", "x1", "y1", "x2", "y2")
    fixed, aside = outlines.repair_and_quarantine(given.unionByName(torn).selectExpr("*", "1 as region"), 3.0, ["region", "id"])
    got = {r.id: r.area for r in outlines.summary(fixed, ["region", "id"]).collect()}
    assert got["a"] == 16 and got["b"] == 24
    assert {r.id for r in aside.collect()} <= {"torn"}
    assert outlines.repair(given.where("false"), 3.0).count() == 0
