"""Polygons as tables of edges.

A polygon is the set of rows ``(id, part, ring, x1, y1, x2, y2)`` that share an id.
Outer rings run counter-clockwise, holes clockwise, in planar units. Edges rather
than ring arrays keep every step a plain aggregation or equi-join: a coastline of
a billion vertices is spread like any other rows, and no polygon has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewise.operators.scale import attach_totals

ENDS = ["x1", "y1", "x2", "y2"]


# Vertices of a ring are linked within blocks of this many sequence numbers.
RING_BLOCK = 65_536


def edges_from_vertices(vertices: DataFrame, ring_keys: Sequence[str] = ("id", "part", "ring")) -> DataFrame:
    """Vertex rows (ring keys, seq, x, y) -> edge rows, each ring closed.

    ``seq`` orders the vertices of a ring; it may start anywhere and leave gaps. A repeated first vertex at
    the end is allowed, NULL ring keys too. Further coordinates (z, m) are dropped. A vertex finds the next one within
    its block of sequence numbers; the last of a block finds the first of the next block, one row per block.
    """
    keys = list(ring_keys)
    plain = vertices.select(*keys, F.col("seq").cast("bigint").alias("seq"), "x", "y").withColumn(
        "__block", F.floor(F.col("seq") / RING_BLOCK)
    )
    point = F.struct("x", "y")
    block = Window.partitionBy(*keys, "__block")
    inside = block.orderBy("seq")
    whole_block = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Only the last vertex of a block is dealt anew, with the first one of its block: no vertex is joined with anything.
    led = plain.withColumns({"__next": F.lead(point).over(inside), "__first": F.min_by(point, F.col("seq")).over(whole_block)})
    onwards = Window.partitionBy(*keys).orderBy("__block")
    whole = onwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = led.where(F.col("__next").isNull()).withColumn(
        "__next", F.coalesce(F.lead("__first").over(onwards), F.first("__first").over(whole))
    )
    linked = led.where(F.col("__next").isNotNull()).unionByName(lasts).select(
        *keys,
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.col("__next.x").alias("x2"),
        F.col("__next.y").alias("y2"),
    )
    return linked.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def box_vertices(
    df: DataFrame, id: str, x0: Column, y0: Column, width: Column, height: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """Axis-aligned rectangles as vertex rows; ``keep`` names further columns of ``df`` to carry."""
    corners = [(x0, y0), (x0 + width, y0), (x0 + width, y0 + height), (x0, y0 + height)]
    points = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))
    return df.select(F.col(id).alias("id"), *keep, F.posexplode(points).alias("seq", "p")).select(
        "id", *keep, F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def _signed_area() -> Column:
    return F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")) / 2)


def area(edges: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Area per polygon: outer rings count positive, holes negative."""
    return edges.groupBy(*by).agg(_signed_area().alias("area"))


def bbox(edges: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    return edges.groupBy(*by).agg(
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
    )


def normalize(edges: DataFrame, ring_keys: Sequence[str] = ("id", "part", "ring")) -> DataFrame:
    """Drop degenerate rings and turn the others the right way round.

    Degenerate rings have fewer than three edges or all vertices on a line. The last ring key numbers
    the rings of a part: 0 is the outer one, the rest are holes. Rings that cross themselves, those without signed
    area too, are left to ``overlay.invalid_polygons``.
    """
    keys = list(ring_keys)
    spread = F.var_pop("x1") * F.var_pop("y1")
    measured = attach_totals(
        edges,
        keys,
        __area=_signed_area(),
        __edges=F.count(F.lit(1)),
        __flat=spread - F.pow(F.covar_pop("x1", "y1"), F.lit(2)) <= spread * 1e-12,
    )
    sound = measured.where((F.col("__edges") >= 3) & ~F.col("__flat"))
    turn = (F.col("__area") > 0) != (F.col(keys[-1]) == 0)
    swapped = {"x1": "x2", "y1": "y2", "x2": "x1", "y2": "y1"}
    return sound.withColumns(
        {a: F.when(turn, F.col(b)).otherwise(F.col(a)) for a, b in swapped.items()}
    ).drop("__area", "__edges", "__flat")


def dissolve(edges: DataFrame, id: str, row: str) -> DataFrame:
    """Edges of several features with one id become one multi-part polygon.

    ``row`` tells the features apart; it is folded into ``part``, and nothing is
    moved. Where features overlap, ``overlay.overlay`` counts them once.
    """
    return edges.withColumn("part", F.concat_ws("/", F.col(row).cast("string"), F.col("part").cast("string"))).drop(row)


@dataclass(frozen=True)
class Albers:
    """Parameters of an equal-area conic projection (degrees)."""

    latitude: float
    longitude: float
    parallel1: float
    parallel2: float


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of a transverse Mercator zone (degrees; the false origin in metres; metres in a unit of the result)."""

    latitude: float
    longitude: float
    scale: float
    false_easting: float
    false_northing: float = 0.0
    unit: float = 1.0


@dataclass(frozen=True)
class Ellipsoid:
    semi_major: float
    flattening: float


US_FOOT = 1200 / 3937
# Published projection parameters per region.
CONTIGUOUS = Albers(23.0, -96.0, 29.5, 45.5)  # EPSG:5070
ALASKA = Albers(50.0, -154.0, 55.0, 65.0)  # EPSG:3338
HAWAII = Albers(13.0, -157.0, 8.0, 18.0)  # any equal-area choice gives the same weights
HAWAII_ZONE_3 = TransverseMercator(21 + 1 / 6, -158.0, 0.99999, 500000.0, unit=US_FOOT)  # EPSG:3759
# The GRS 80 ellipsoid.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257222101
GRS_80 = Ellipsoid(SEMI_MAJOR_M, FLATTENING)


def project_albers(df: DataFrame, projection: Albers, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add planar ``x``, ``y`` in metres from degrees (ellipsoidal forward formula)."""
    x, y = _albers(projection, F.col(lon), F.col(lat), GRS_80)
    return df.withColumn("x", x).withColumn("y", y)


def _albers(projection: Albers, lon: Column, lat: Column, shape: Ellipsoid) -> tuple[Column, Column]:
    e2 = shape.flattening * (2 - shape.flattening)
    e = math.sqrt(e2)

    def q_of(sine, log):
        return (1 - e2) * (sine / (1 - e2 * sine * sine) - log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    def m_squared(sine: float) -> float:
        return (1 - sine * sine) / (1 - e2 * sine * sine)

    s0, s1, s2 = (
        math.sin(math.radians(d)) for d in (projection.latitude, projection.parallel1, projection.parallel2)
    )
    n = (m_squared(s1) - m_squared(s2)) / (q_of(s2, math.log) - q_of(s1, math.log))
    c = m_squared(s1) + n * q_of(s1, math.log)
    rho0 = shape.semi_major * math.sqrt(c - n * q_of(s0, math.log)) / n
    rho = F.sqrt(F.lit(c) - n * q_of(F.sin(F.radians(lat)), F.log)) * (shape.semi_major / n)
    theta = F.radians(lon - projection.longitude) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def _transverse_mercator(p: TransverseMercator, lon: Column, lat: Column, shape: Ellipsoid) -> tuple[Column, Column]:
    """Krueger's series in the third flattening to its fourth power: below a millimetre within 30 degrees of the meridian."""
    n = shape.flattening / (2 - shape.flattening)
    e = math.sqrt(shape.flattening * (2 - shape.flattening))
    radius = shape.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * p.scale
    series = (
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    )
    start = math.atan(math.sinh(math.atanh(math.sin(math.radians(p.latitude))) - e * math.atanh(e * math.sin(math.radians(p.latitude)))))
    start += sum(a * math.sin(2 * j * start) for j, a in enumerate(series, 1))
    sine, east = F.sin(F.radians(lat)), F.radians(lon - p.longitude)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(east)), F.asinh(F.sin(east) / F.sqrt(t * t + F.cos(east) ** 2))
    north, along = xi, eta
    for j, a in enumerate(series, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        along = along + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    x = (F.lit(p.false_easting) + radius * along) / p.unit
    return x, (F.lit(p.false_northing) + radius * (north - start)) / p.unit


Projection = Albers | TransverseMercator
# Regions not named here use the first.
REGIONAL: dict[str, Projection] = {"contiguous": CONTIGUOUS, "AK": ALASKA, "HI": HAWAII_ZONE_3}


def projected(projection: Projection, lon: Column, lat: Column, shape: Ellipsoid = GRS_80) -> Column:
    """Struct of planar ``x`` and ``y``."""
    form = _albers if isinstance(projection, Albers) else _transverse_mercator
    x, y = form(projection, lon, lat, shape)
    return F.struct(x.alias("x"), y.alias("y"))


def project_by_region(
    df: DataFrame, region: str = "region", lon: str = "lon", lat: str = "lat", projections: dict[str, Projection] = REGIONAL
) -> DataFrame:
    """Add planar ``x``, ``y``, each row in its region's projection; the first one serves all other regions."""
    names = list(projections)
    at = projected(projections[names[0]], F.col(lon), F.col(lat))
    for name in names[1:]:
        at = F.when(F.col(region) == name, projected(projections[name], F.col(lon), F.col(lat))).otherwise(at)
    return df.withColumn("__at", at).withColumns({"x": F.col("__at.x"), "y": F.col("__at.y")}).drop("__at")
