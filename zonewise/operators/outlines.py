"""Repaired and dissolved outlines: the boundary of what polygons cover, as edges again.

``repair`` takes polygons whose parts may overlap or share edges and whose rings may cross themselves, run the wrong way
round or retrace themselves, and returns the outline of the covered points: outer rings counter-clockwise, holes clockwise,
no edge twice, no crossing. ``dissolve`` does so for features that share an id.

1. Noding. Edges of one polygon meet within the cells of a grid; each is cut where it crosses another one and where
   another one's vertex lies on it. Vertices are put on a fine lattice, so a point is the same number for all who meet there.
2. Sides. A cut edge keeps the same points on either side all along. How often each ring winds around the points just above
   its middle is the sum of the signs of the pieces above, in its cell alone (see ``overlay``); just below, the rings that
   run along the edge come on top. Edges with inside on both sides, or on none, go.
3. Rings. What is left has the inside on its left. At a vertex an edge is followed by the first outgoing one clockwise from
   where it came, which never crosses over. Edges learn their ring by pointer doubling, in as many joins as the logarithm of
   the longest ring; a hole belongs to the smallest outer ring around it.

No step gathers a polygon, a ring or an edge's cuts in one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewise.operators import geometry
from zonewise.operators.overlay import LABELS, PIECE, _is_hole, _slot, tile
from zonewise.session import cut_lineage

LINE = ["px", "py", "qx", "qy"]
# The lattice is this many halvings finer than a cell, and a vertex this many of its steps away lies on an edge.
LATTICE_HALVINGS, NEAR_STEPS = 32, 4
# Doublings after which a ring would have more edges than numbers can tell apart.
MAX_DOUBLINGS = 62


def lattice_step(cell: float) -> float:
    """A power of two, so that multiples of it are exact numbers."""
    return 2.0 ** (math.floor(math.log2(cell)) - LATTICE_HALVINGS)


def _snap(value: Column, step: float) -> Column:
    return F.rint(value / step) * step


def _before() -> Column:
    """Whether (px, py) is left of (qx, qy), or below it on one upright."""
    return (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")))


def _lines(edges: DataFrame, keep: Sequence[str], direction: Column) -> DataFrame:
    """Edges (px, py, qx, qy) with the lower end first, and ``direction`` turned where that swaps the ends."""
    first = _before()
    swap = dict(zip(LINE, ("qx", "qy", "px", "py"), strict=True))
    return edges.where((F.col("px") != F.col("qx")) | (F.col("py") != F.col("qy"))).select(
        *keep,
        *(F.when(first, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in swap.items()),
        F.when(first, direction).otherwise(-direction).alias("run"),
    )


def _in_cells(lines: DataFrame, size: float, margin: float) -> DataFrame:
    """Lines in every cell (c, r) that they come nearer to than the margin."""
    px, py, qx, qy = (F.col(n) for n in LINE)
    columns = lines.withColumn(
        "c", F.explode(F.sequence(F.floor((px - margin) / size), F.floor((qx + margin) / size)))
    )
    left, right = F.greatest(px, F.col("c") * size - margin), F.least(qx, (F.col("c") + 1) * size + margin)

    def y_at(x: Column) -> Column:
        y = F.when(px == qx, py).otherwise(py + (qy - py) * ((x - px) / (qx - px)))
        return F.least(F.greatest(y, F.least(py, qy)), F.greatest(py, qy))

    low = F.when(px == qx, py).otherwise(F.least(y_at(left), y_at(right)))
    high = F.when(px == qx, qy).otherwise(F.greatest(y_at(left), y_at(right)))
    rows = F.sequence(F.floor((low - margin) / size), F.floor((high + margin) / size))
    return columns.withColumn("r", F.explode(rows))


def _cuts(lines: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """Points (x, y) inside lines at which others of the same polygon cross or touch them."""
    step = lattice_step(cell)
    near = NEAR_STEPS * step
    a = _in_cells(lines.select(*by, *LINE), cell, near)
    b = a.withColumnsRenamed({n: f"o_{n}" for n in LINE})
    px, py, qx, qy, ox, oy, sx, sy = (F.col(n) for n in (*LINE, *(f"o_{n}" for n in LINE)))
    other = F.struct(px, py, qx, qy) < F.struct(ox, oy, sx, sy)
    boxes = (px <= sx + near) & (ox <= qx + near) & (F.least(py, qy) <= F.greatest(oy, sy) + near)
    boxes &= F.least(oy, sy) <= F.greatest(py, qy) + near
    met = a.join(b, [*by, "c", "r"]).where(other & boxes).drop("c", "r").distinct()

    ux, uy, vx, vy = qx - px, qy - py, sx - ox, sy - oy
    den = ux * vy - uy * vx
    along = ((ox - px) * vy - (oy - py) * vx) / den
    across = ((ox - px) * uy - (oy - py) * ux) / den
    at = F.struct(_snap(px + along * ux, step).alias("x"), _snap(py + along * uy, step).alias("y"))
    met = met.withColumn(
        "__at", F.when((den != 0) & along.between(0, 1) & across.between(0, 1), at)
    )

    def away(x: Column, y: Column) -> Column:
        return (F.abs(F.col("__at.x") - x) > near) | (F.abs(F.col("__at.y") - y) > near)

    inner = away(px, py) & away(qx, qy) & away(ox, oy) & away(sx, sy)
    crossing = F.when(inner, F.col("__at"))

    def touching(x: Column, y: Column, lx: Column, ly: Column, dx: Column, dy: Column) -> Column:
        """The vertex (x, y) where it lies on the inner part of the line from (lx, ly) by (dx, dy)."""
        square = dx * dx + dy * dy
        share = ((x - lx) * dx + (y - ly) * dy) / square
        off = F.abs((x - lx) * dy - (y - ly) * dx)
        end = ((x == lx) & (y == ly)) | ((x == lx + dx) & (y == ly + dy))
        return F.when((off <= near * F.sqrt(square)) & (share > 0) & (share < 1) & ~end, F.struct(x.alias("x"), y.alias("y")))

    ours = F.array(crossing, touching(ox, oy, px, py, ux, uy), touching(sx, sy, px, py, ux, uy))
    theirs = F.array(crossing, touching(px, py, ox, oy, vx, vy), touching(qx, qy, ox, oy, vx, vy))
    sides = F.array(
        F.struct(*(c.alias(n) for c, n in zip((px, py, qx, qy), LINE, strict=True)), ours.alias("points")),
        F.struct(*(c.alias(n) for c, n in zip((ox, oy, sx, sy), LINE, strict=True)), theirs.alias("points")),
    )
    each = met.select(*by, F.explode(sides).alias("s"))
    points = each.select(*by, *(F.col(f"s.{n}").alias(n) for n in LINE), F.explode("s.points").alias("p"))
    return points.where("p is not null").select(*by, *LINE, "p.x", "p.y").distinct()


def noded(edges: DataFrame, cell: float, by: Sequence[str] = ("id",)) -> DataFrame:
    """Edges cut so that two of one polygon are equal, meet at ends, or do not meet.

    Rows are (by..., part, ring, px, py, qx, qy, run): an edge from its lower end, how many more times the ring runs along it
    forwards than backwards (never 0), each once per ring.
    """
    by = list(by)
    step = lattice_step(cell)
    labelled = edges.withColumns({n: F.lit(0) for n in LABELS if n not in edges.columns})
    snapped = labelled.select(
        *by, *LABELS, *(_snap(F.col(a), step).alias(b) for a, b in zip(geometry.ENDS, LINE, strict=True))
    )
    lines = _lines(snapped, [*by, *LABELS], F.lit(1)).groupBy(*by, *LABELS, *LINE).agg(F.sum("run").alias("run"))
    lines = cut_lineage(lines.where("run <> 0"))
    distinct = lines.select(*by, *LINE).distinct()
    ends = [distinct.select(*by, *LINE, F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (LINE[:2], LINE[2:])]
    px, py, qx, qy = (F.col(n) for n in LINE)
    along = (F.col("x") - px) * (qx - px) + (F.col("y") - py) * (qy - py)
    onwards = Window.partitionBy(*by, *LINE).orderBy("along")
    points = ends[0].unionByName(ends[1]).unionByName(_cuts(distinct, by, cell)).withColumn("along", along)
    parts = points.withColumn("to", F.lead(F.struct("x", "y")).over(onwards)).where("to is not null")
    parts = parts.select(*by, *LINE, F.struct("x", "y", F.col("to.x").alias("tx"), F.col("to.y").alias("ty")).alias("part_of"))
    cut = lines.join(parts, [*by, *LINE]).select(
        *by, *LABELS, *(F.col(f"part_of.{a}").alias(b) for a, b in zip(("x", "y", "tx", "ty"), LINE, strict=True)), "run"
    )
    turned = _lines(cut, [*by, *LABELS], F.col("run"))
    return turned.groupBy(*by, *LABELS, *LINE).agg(F.sum("run").alias("run")).where("run <> 0")


def _directed(lines: DataFrame, keep: Sequence[str], forwards: Column) -> DataFrame:
    back = dict(zip(geometry.ENDS, ("qx", "qy", "px", "py"), strict=True))
    return lines.select(
        *keep, *(F.when(forwards, F.col(a)).otherwise(F.col(back[e])).alias(e) for e, a in zip(geometry.ENDS, LINE, strict=True))
    )


def _above(probes: DataFrame, tiles: DataFrame, place: Sequence[str], cell: float) -> DataFrame:
    """Pieces above the middle of each probe (a line), with their sign; for upright probes, those above and to the right."""
    size = F.lit(float(cell))
    middle = probes.withColumns({"__x": (F.col("px") + F.col("qx")) / 2, "__y": (F.col("py") + F.col("qy")) / 2})
    middle = middle.withColumns({"c": _slot(F.col("__x"), size), "r": _slot(F.col("__y"), size)})
    middle = middle.withColumns({"__x": F.col("__x") - F.col("c") * size, "__y": F.col("__y") - F.col("r") * size})
    xl, yl, xr, yr = (F.col(n) for n in PIECE[1:])
    rise = yl + (yr - yl) * ((F.col("__x") - xl) / (xr - xl)) - F.col("__y")
    # What is nearer than a part of a lattice step is the probe's own line.
    off = rise * (xr - xl) / F.sqrt((xr - xl) * (xr - xl) + (yr - yl) * (yr - yl))
    met = middle.join(tiles.where(xl < xr), [*place, "c", "r"])
    return met.where((xl <= F.col("__x")) & (F.col("__x") < xr) & (off > lattice_step(cell) / 16))


def _boundary(lines: DataFrame, cell: float, by: Sequence[str]) -> DataFrame:
    """The cut edges between inside and outside, directed with the inside on their left."""
    repeated = F.explode(F.array_repeat(F.lit(0), F.abs("run").cast("int")))
    running = lines.withColumn("__n", repeated)
    tiles = tile(_directed(running, [*by, *LABELS], F.col("run") > 0), cell, [*by, *LABELS])
    tiles = tiles.withColumnsRenamed({n: f"o_{n}" for n in LABELS})
    probes = lines.select(*by, *LINE).distinct()
    above = _above(probes, tiles, by, cell).select(
        *by, *LINE, *(F.col(f"o_{n}").alias(n) for n in LABELS), F.col("s").alias("above"), F.lit(0).alias("run")
    )
    # A ring that runs left to right winds less below an edge than above it, one that runs upwards more on the left.
    own = F.when(F.col("px") == F.col("qx"), F.col("run")).otherwise(-F.col("run"))
    along = lines.select(*by, *LINE, *LABELS, F.lit(0).alias("above"), own.alias("run"))
    rings = above.unionByName(along).groupBy(*by, *LINE, *LABELS).agg(
        (F.sum("above") != 0).alias("up"), (F.sum("above") + F.sum("run") != 0).alias("down")
    )
    hole = _is_hole()
    parts = rings.groupBy(*by, *LINE, "part").agg(
        *((F.max(F.col(d) & ~hole) & ~F.max(F.col(d) & hole)).alias(d) for d in ("up", "down"))
    )
    sides = parts.groupBy(*by, *LINE).agg(F.max("up").alias("up"), F.max("down").alias("down"))
    upright = F.col("px") == F.col("qx")
    return _directed(sides.where("up <> down"), by, F.col("up") != upright)


def _followers(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(e, to): each edge and the one its ring goes on with; NULL where there is none."""
    x1, y1, x2, y2 = (F.col(n) for n in geometry.ENDS)
    out = edges.select(*by, x1.alias("x"), y1.alias("y"), F.atan2(y2 - y1, x2 - x1).alias("angle"), "e", F.lit(True).alias("out"))
    into = edges.select(*by, x2.alias("x"), y2.alias("y"), F.atan2(y1 - y2, x1 - x2).alias("angle"), "e", F.lit(False).alias("out"))
    clockwise = Window.partitionBy(*by, "x", "y").orderBy(F.desc("angle"), "out")
    leaving = F.when(F.col("out"), F.col("e"))
    onwards = F.first(leaving, ignorenulls=True).over(clockwise.rowsBetween(1, Window.unboundedFollowing))
    around = F.first(leaving, ignorenulls=True).over(
        clockwise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return out.unionByName(into).withColumn("to", F.coalesce(onwards, around)).where("not out").select("e", "to")


def _ring_of(followers: DataFrame) -> DataFrame:
    """(e, m, open): the smallest edge of its ring for each edge; ``open`` where the way leads to an end."""
    now = cut_lineage(followers.select("e", "to", F.col("e").alias("m"), F.col("to").isNull().alias("open")))
    for _ in range(MAX_DOUBLINGS):
        ahead = now.select(F.col("e").alias("to"), F.col("to").alias("o_to"), F.col("m").alias("o_m"), F.col("open").alias("o_open"))
        met = now.join(ahead, "to", "left")
        lower = F.least("m", "o_m")
        ends = F.col("open") | F.coalesce("o_open", F.lit(False))
        moved = (lower != F.col("m")) | (ends != F.col("open"))
        then = cut_lineage(
            met.select("e", F.col("o_to").alias("to"), lower.alias("m"), ends.alias("open"), moved.alias("moved"))
        )
        settled = then.where("moved").isEmpty()
        now = then.drop("moved")
        if settled:
            break
    return now.select("e", "m", "open")


def _hole_owners(edges: DataFrame, rings: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """(m, owner): each hole and the smallest outer ring around it."""
    holes = rings.where("area < 0")
    ids = holes.select(*by).distinct()
    outer = edges.join(rings.where("area > 0").select("m", "area"), "m").join(ids, list(by), "left_semi")
    tiles = tile(outer, cell, [*by, "m", "area"]).withColumnsRenamed({"m": "owner", "area": "owner_area"})
    ends = dict(zip(geometry.ENDS, LINE, strict=True))
    probe = holes.select(*by, "m", *(F.col(f"edge.{a}").alias(b) for a, b in ends.items()))
    met = _above(probe, tiles, by, cell).groupBy("m", "owner").agg(F.sum("s").alias("winds"), F.max("owner_area").alias("owner_area"))
    return met.where("winds <> 0").groupBy("m").agg(F.min_by("owner", F.struct("owner_area", "owner")).alias("owner"))


def repair_and_quarantine(edges: DataFrame, cell: float, by: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """``repair``, and beside it the edges (by..., x1, y1, x2, y2) of outlines that do not close: none where rings are closed."""
    by = list(by)
    lines = cut_lineage(noded(edges, cell, by))
    numbered = cut_lineage(_boundary(lines, cell, by).withColumn("e", F.monotonically_increasing_id()))
    told = cut_lineage(numbered.join(_ring_of(_followers(numbered, by)), "e"))
    closed = told.where("not open")
    area = F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")) / 2)
    rings = closed.groupBy(*by, "m").agg(area.alias("area"), F.min_by(F.struct(*geometry.ENDS), "e").alias("edge"))
    rings = cut_lineage(rings)
    owners = _hole_owners(closed.select(*by, "m", *geometry.ENDS), rings, by, cell)
    owned = rings.join(owners, "m", "left").select(
        *by, "m", (F.col("area") < 0).alias("hole"), F.coalesce("owner", "m").alias("owner")
    )
    numbers = owned.select(
        "m",
        (F.dense_rank().over(Window.partitionBy(*by).orderBy("owner")) - 1).alias("part"),
        (F.row_number().over(Window.partitionBy(*by, "owner").orderBy("hole", "m")) - 1).alias("ring"),
    )
    repaired = closed.join(numbers, "m").select(*by, "part", "ring", *geometry.ENDS)
    return repaired, told.where("open").select(*by, *geometry.ENDS)


def repair(edges: DataFrame, cell: float, by: Sequence[str] = ("id",)) -> DataFrame:
    """The outline of what each polygon covers: (by..., part, ring, x1, y1, x2, y2), sound.

    A point is covered if any part covers it; a part covers what its outer ring (0) winds around, in either direction, and no
    hole of it does. Coordinates lie on a lattice of about ``cell`` / 2**32. Polygons that cover nothing have no rows.
    """
    return repair_and_quarantine(edges, cell, by)[0]


def dissolve(edges: DataFrame, id: str, row: str, cell: float) -> DataFrame:
    """Features of one id, told apart by ``row``, as one polygon without the edges that they share or cover."""
    return repair(geometry.dissolve(edges, id, row), cell, [id])


def summary(edges: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Area, perimeter and the numbers of parts and holes of each polygon."""
    length = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    rings = edges.groupBy(*by, "part", "ring").agg(
        F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")) / 2).alias("area"), F.sum(length).alias("perimeter")
    )
    first = F.col("ring") == 0
    return rings.groupBy(*by).agg(
        F.sum("area").alias("area"),
        F.sum("perimeter").alias("perimeter"),
        F.sum(first.cast("bigint")).alias("n_parts"),
        F.sum((~first).cast("bigint")).alias("n_holes"),
    )
