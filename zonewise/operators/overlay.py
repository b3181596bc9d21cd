"""Overlap areas of two sets of polygons, by cutting both on one grid.

Cutting. Every edge is cut at the grid lines it crosses. Inside a cell the polygon
is then described by signed pieces such that a point is inside exactly when the
signs of the pieces above it add up to 1:

* the edge parts inside the cell (+1 where the inside lies below, -1 above);
* for edges crossing the cell's top, a lid along the top from there to the right;
* one lid over the whole top, if the top left corner is inside.

Overlap. Within a cell, the area common to polygons A and B is the sum over pairs
of their pieces of ``sign * sign * integral of min(piece a, piece b)``. So the whole
overlay is one equi-join on the cell and one sum: no candidate pairs by bounding
box, no duplicate removal, and edges far apart never meet. Work grows with the
number of edges and cells, not with the product of two outlines. Crowded cells are
cut again, level by level, until none is crowded.

Whether an end lies above a grid line is decided once, from its integer row, so
rounding moves areas by no more than rounding does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonewise.functions.ids import state_of
from zonewise.lookups import NON_CONTIGUOUS_FIPS
from zonewise.operators.geometry import ENDS
from zonewise.operators.geometry import area as polygon_area
from zonewise.operators.geometry import bbox
from zonewise.session import cut_lineage, shuffles_dropped

PIECE = ["s", "xl", "yl", "xr", "yr"]
# A cell is cut again where the pieces of both sides would meet in more pairs.
CROWDED_PAIRS = 1_000_000
# The same for the pieces of one polygon where they are united.
UNITED_PAIRS = 10_000
TARGET_PIECES = 64
# What names a part of a cell: how many times the cell is cut a side, and the part's column and row.
PARTS = ["cuts", "fc", "fr"]
# Cutting does not thin out cells of so few pieces: what one edge leaves in a cell, or a few that meet in a point.
FEW_PIECES = 16
# A level halves a side so often; no part is finer than a cell by more than FINEST_CUTS, where only pieces that meet in one point
# are still together.
LEAST_HALVINGS, MOST_HALVINGS, FINEST_CUTS = 2, 6, 1 << 12
# Overlaps below this share of the absolute terms that make them up are rounding.
ROUNDING = 1e-12


def _slot(value: Column, size: Column) -> Column:
    """The k with k*size <= value < (k+1)*size, exact with respect to the products."""
    k = F.floor(value / size)
    return F.when(k * size > value, k - 1).when((k + 1) * size <= value, k + 1).otherwise(k)


def _pieces(edges: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Directed edges -> left-to-right pieces with the sign of their direction.

    Upright pieces (no width) keep their sign as the change of the inside from
    left to right, lower end first.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    forward, upright = x1 < x2, x1 == x2
    first = forward | (upright & (y1 <= y2))
    return edges.select(
        *keep,
        F.when(first, -1).otherwise(1).alias("s"),
        F.when(first, x1).otherwise(x2).alias("xl"),
        F.when(first, y1).otherwise(y2).alias("yl"),
        F.when(first, x2).otherwise(x1).alias("xr"),
        F.when(first, y2).otherwise(y1).alias("yr"),
    )


def _cut_columns(pieces: DataFrame, keep: Sequence[str], size: Column) -> DataFrame:
    xl, yl, xr, yr = (F.col(c) for c in PIECE[1:])
    last = _slot(xr, size)
    upright = xl == xr
    spans = pieces.withColumn("__c0", _slot(xl, size)).withColumn(
        "__c1", F.when(~upright & (last * size == xr), last - 1).otherwise(last)
    )
    # An upright piece on a left border is already counted by what starts there.
    spans = spans.where(~upright | (F.col("__c0") * size < xl))
    cut = spans.withColumn("c", F.explode(F.sequence(F.col("__c0"), F.greatest("__c0", "__c1"))))
    left, right = F.col("c") * size, (F.col("c") + 1) * size

    def y_at(x: Column) -> Column:
        y = yl + (yr - yl) * ((x - xl) / (xr - xl))
        return F.least(F.greatest(y, F.least(yl, yr)), F.greatest(yl, yr))

    return cut.select(
        *keep,
        "c",
        "s",
        (xl <= left).alias("from_left"),
        F.when(xl <= left, F.lit(0.0)).otherwise(xl - left).alias("xl"),
        F.when(xl < left, y_at(left)).otherwise(yl).alias("yl"),
        F.when(xr >= right, size.cast("double")).otherwise(xr - left).alias("xr"),
        F.when(xr > right, y_at(right)).otherwise(yr).alias("yr"),
    ).withColumns({"__ra": _slot(F.col("yl"), size), "__rb": _slot(F.col("yr"), size)})


def _cut_rows(columns: DataFrame, keep: Sequence[str], size: Column) -> DataFrame:
    """Parts inside each cell, and a lid wherever a cell's top is crossed."""
    xl, yl, xr, yr, ra, rb = (F.col(c) for c in ("xl", "yl", "xr", "yr", "__ra", "__rb"))
    rows = columns.withColumn("r", F.explode(F.sequence(F.least(ra, rb), F.greatest(ra, rb))))
    r, rising = F.col("r"), (ra < rb) | ((ra == rb) & (yl <= yr))
    top = size.cast("double")

    def x_at(y: Column) -> Column:
        x = F.when(xl == xr, xl).otherwise(xl + (xr - xl) * ((y - yl) / (yr - yl)))
        return F.least(F.greatest(x, xl), xr)

    at_floor, at_top = x_at(r * size), x_at((r + 1) * size)
    own = yl - r * size, yr - r * size
    part = F.struct(
        r.alias("r"),
        F.col("s").alias("s"),
        F.when(rising & (r > ra), at_floor).when(~rising & (r < ra), at_top).otherwise(xl).alias("xl"),
        F.when(rising & (r > ra), 0.0).when(~rising & (r < ra), top).otherwise(own[0]).alias("yl"),
        F.when(rising & (r < rb), at_top).when(~rising & (r > rb), at_floor).otherwise(xr).alias("xr"),
        F.when(rising & (r < rb), top).when(~rising & (r > rb), 0.0).otherwise(own[1]).alias("yr"),
    )
    crossed = r > F.least(ra, rb)
    lid = F.when(
        crossed,
        F.struct(
            (r - 1).alias("r"),
            F.when(rising, F.col("s")).otherwise(-F.col("s")).alias("s"),
            at_floor.alias("xl"),
            top.alias("yl"),
            top.alias("xr"),
            top.alias("yr"),
        ),
    )
    parts = rows.select(*keep, "c", F.explode(F.array(part, lid)).alias("p"))
    flat = parts.select(*keep, "c", *(F.col(f"p.{n}").alias(n) for n in ("r", *PIECE)))
    # A steep falling part may be left without width: turn it lower end first.
    turned = (F.col("xl") == F.col("xr")) & (F.col("yl") > F.col("yr"))
    return flat.where((F.col("xl") < F.col("xr")) | (F.col("yl") != F.col("yr"))).select(
        *keep,
        "c",
        "r",
        F.when(turned, -F.col("s")).otherwise(F.col("s")).alias("s"),
        "xl",
        F.least("yl", F.when(turned, F.col("yr"))).alias("yl"),
        "xr",
        F.greatest("yr", F.when(turned, F.col("yl"))).alias("yr"),
    )


def _left_crossings(columns: DataFrame, keep: Sequence[str], size: Column) -> DataFrame:
    """(keep..., c, __row, __s, __size): how the winding changes at a column's left border in each row crossed there."""
    return (
        columns.where(F.col("from_left") & (F.col("xl") < F.col("xr")))
        .groupBy(*keep, "c", F.col("__ra").alias("__row"))
        .agg(F.sum("s").alias("__s"), F.max(size).alias("__size"))
        .where(F.col("__s") != 0)
    )


def _corner_lids(columns: DataFrame, keep: Sequence[str], size: Column, bounded: bool) -> DataFrame:
    """Whole-top lids of the cells whose top left corner is inside.

    The outline of a whole polygon closes below its lowest crossing; what was cut
    to a cell before (``bounded``) may reach down to the cell's own floor. A grid column of one polygon has at most as many rows here as the grid has in
    its height, after aggregation.
    """
    starts = _left_crossings(columns, keep, size)
    downwards = Window.partitionBy(*keep, "c").orderBy(F.desc("__row"))
    runs = starts.select(
        *keep,
        "c",
        "__row",
        "__size",
        F.sum("__s").over(downwards.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("s"),
        (F.lead("__row", 1, 0) if bounded else F.lead("__row")).over(downwards).alias("__below"),
    ).where((F.col("s") != 0) & (F.col("__below") < F.col("__row")))
    return runs.select(
        *keep,
        "c",
        F.explode(F.sequence(F.col("__below"), F.col("__row") - 1)).alias("r"),
        "s",
        F.lit(0.0).alias("xl"),
        F.col("__size").cast("double").alias("yl"),
        F.col("__size").cast("double").alias("xr"),
        F.col("__size").cast("double").alias("yr"),
    )


def _cut(pieces: DataFrame, keep: Sequence[str], size: Column, bounded: bool = False) -> DataFrame:
    columns = _cut_columns(pieces, keep, size)
    return _cut_rows(columns, keep, size).unionByName(_corner_lids(columns, keep, size, bounded))


def tile(edges: DataFrame, cell: float, by: Sequence[str] = ("id",)) -> DataFrame:
    """Polygons cut on a grid of squares of side ``cell``.

    Returns rows (by..., c, r, s, xl, yl, xr, yr) in coordinates of the cell (c, r).
    """
    return _cut(_pieces(edges, list(by)), list(by), F.lit(float(cell)))


def cell_areas(tiles: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Area of each polygon within each cell it shares more with than rounding."""
    piece = F.col("s") * (F.col("xr") - F.col("xl")) * (F.col("yl") + F.col("yr")) / 2
    sums = tiles.groupBy(*by, "c", "r").agg(F.sum(piece).alias("area"), F.sum(F.abs(piece)).alias("__terms"))
    return sums.where(F.col("area") > ROUNDING * F.col("__terms")).drop("__terms")


def _whole(tiles: DataFrame) -> DataFrame:
    """Tiles as cells that have not been cut: one cut, of which this is column and row 0."""
    return tiles.withColumns(
        {"cuts": F.lit(1), "fc": F.lit(0).cast("bigint"), "fr": F.lit(0).cast("bigint")}
    )


def _refine(tiles: DataFrame, crowded: DataFrame, keep: Sequence[str], place: Sequence[str], cell: float) -> DataFrame:
    """Cut the pieces of crowded cells, each ``more`` times a side; the others pass as they are."""
    marked = tiles.join(crowded, list(place), "left")
    calm = marked.where(F.col("more").isNull()).drop("more")
    names = {n: f"__{n}" for n in ("c", "r", *PARTS)}
    carried = [*dict.fromkeys([*(n for n in keep if n not in names), *names.values(), "more"])]
    again = marked.where(F.col("more").isNotNull()).withColumnsRenamed(names)
    size = F.lit(float(cell)) / (F.col("__cuts") * F.col("more"))
    fine = _cut(again.select(*carried, *PIECE), carried, size, bounded=True)
    inner = {"fc": F.col("__fc") * F.col("more") + F.col("c"), "fr": F.col("__fr") * F.col("more") + F.col("r")}
    fine = fine.withColumns({**inner, "cuts": F.col("__cuts") * F.col("more"), "c": F.col("__c"), "r": F.col("__r")})
    return calm.unionByName(fine.select(calm.columns))


def _crowded(sides: Sequence[DataFrame], place: Sequence[str], limit: int) -> DataFrame:
    """The crowded cells, all of them, with the cuts they deserve; one side stands for both."""
    met = sides[0].select(*place, F.lit(1).alias("na"), F.lit(0).alias("nb"))
    if len(sides) > 1:
        met = met.unionByName(sides[1].select(*place, F.lit(0).alias("na"), F.lit(1).alias("nb")))
    second = F.sum("nb") if len(sides) > 1 else F.sum("na")
    met = met.groupBy(*place).agg(F.sum("na").alias("na"), second.alias("nb"))
    pairs = F.col("na").cast("double") * F.col("nb")
    # A power of two, so that the finer grid lines add up to the cell exactly.
    halvings = F.ceil(F.log2(F.sqrt(F.greatest("na", "nb") / F.lit(TARGET_PIECES))))
    more = F.pow(F.lit(2.0), F.least(F.greatest(halvings, F.lit(LEAST_HALVINGS)), F.lit(MOST_HALVINGS)))
    crowded = met.where((pairs > limit) & (F.greatest("na", "nb") > FEW_PIECES) & (F.col("cuts") < FINEST_CUTS))
    return crowded.select(*place, more.cast("int").alias("more"))


def _levelled(
    sides: Sequence[DataFrame], keep: Sequence[Sequence[str]], place: Sequence[str], cell: float, limit: int
) -> tuple[list[DataFrame], list[str]]:
    """The sides with their crowded cells cut again and again, and what names a cell from then on.

    Level by level: whatever still meets in more than ``limit`` pairs is cut once more, so pieces that crowd one corner end
    in cells that fit them. All sides are cut alike; one side stands for both.
    """
    place = [*place, *PARTS]
    sides = [_whole(side) for side in sides]
    while True:
        crowded = cut_lineage(_crowded(sides, place, limit))
        if crowded.isEmpty():
            return sides, place
        sides = [
            cut_lineage(_refine(side, crowded, names, place, cell)) for side, names in zip(sides, keep, strict=True)
        ]


def _common(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Integral of the lower of two pieces over the x range they share."""
    left, right = F.greatest(a["xl"], b["xl"]), F.least(a["xr"], b["xr"])
    width = right - left

    def at(p: dict[str, Column], x: Column) -> Column:
        return p["yl"] + (p["yr"] - p["yl"]) * ((x - p["xl"]) / (p["xr"] - p["xl"]))

    al, ar, bl, br = at(a, left), at(a, right), at(b, left), at(b, right)
    dl, dr = al - bl, ar - br
    both = (al + ar + bl + br) / 2
    steady = (F.abs(dl) + F.abs(dr)) / 2
    crossing = (dl * dl + dr * dr) / (2 * (F.abs(dl) + F.abs(dr)))
    apart = F.when(dl * dr >= 0, steady).otherwise(crossing)
    return (both - apart) / 2 * width


def _met(a: DataFrame, b: DataFrame, place: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """Pairs of pieces over a common x range, with what they add to the common area; labels as a_... and b_..."""
    names = [*PIECE, *labels]
    ours = a.where(F.col("xl") < F.col("xr")).withColumnsRenamed({n: f"a_{n}" for n in names})
    theirs = b.where(F.col("xl") < F.col("xr")).withColumnsRenamed({n: f"b_{n}" for n in names})
    met = ours.join(theirs, list(place)).where(
        (F.col("a_xl") < F.col("b_xr")) & (F.col("b_xl") < F.col("a_xr"))
    )
    common = _common(
        {n: F.col(f"a_{n}") for n in PIECE}, {n: F.col(f"b_{n}") for n in PIECE}
    )
    return met.withColumn("__common", common).withColumn("__signed", F.col("a_s") * F.col("b_s") * F.col("__common"))


def _sum_common(a: DataFrame, b: DataFrame, place: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return _summed(_met(a, b, place), keys)


def _summed(met: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = met.groupBy(*keys).agg(
        F.sum("__signed").alias("overlap_area"), F.sum(F.abs("__common")).alias("__terms")
    )
    return sums.where(F.abs("overlap_area") > ROUNDING * F.col("__terms")).drop("__terms")


def _overlap_of_tiles(
    a: DataFrame, b: DataFrame, cell: float, zone: str, system: str, within: list[str], crowded_pairs: int
) -> DataFrame:
    a, b = a.withColumnRenamed("id", zone), b.withColumnRenamed("id", system)
    (a, b), place = _levelled([a, b], [[*within, zone], [*within, system]], [*within, "c", "r"], cell, crowded_pairs)
    shared = _sum_common(a, b, place, [*within, zone, system])
    return shared.where(F.col("overlap_area") > 0)


def _in_range(tiles: DataFrame, other: DataFrame, within: Sequence[str]) -> DataFrame:
    """The tiles whose column and row lie between the least and greatest of ``other``; the rest meets nothing there."""
    ends = {f"__{f.__name__}_{n}": f(n) for n in ("c", "r") for f in (F.min, F.max)}
    extent = F.broadcast(other.groupBy(*within).agg(*(end.alias(name) for name, end in ends.items())))
    met = tiles.join(extent, list(within)) if within else tiles.crossJoin(extent)
    for n in ("c", "r"):
        met = met.where(F.col(n).between(F.col(f"__min_{n}"), F.col(f"__max_{n}")))
    return met.select(*tiles.columns)


def overlap_area(
    zones: DataFrame,
    systems: DataFrame,
    cell: float,
    zone: str = "zone_id",
    system: str = "pwsid",
    within: Sequence[str] = (),
    crowded_pairs: int = CROWDED_PAIRS,
) -> DataFrame:
    """Area shared by each zone and system that overlap: (within..., zone, system, overlap_area).

    Both inputs are edge tables keyed by ``id``. ``within`` names columns, such as
    the region, that must agree. ``cell`` is best near the usual width of a zone.
    Pairs that only touch are left out. Of the zones, only what lies in the systems' range of cells is kept.
    """
    within = list(within)
    by = [*within, "id"]
    b = cut_lineage(tile(systems, cell, by))
    a = cut_lineage(_in_range(tile(zones, cell, by), b, within))
    return _overlap_of_tiles(a, b, cell, zone, system, within, crowded_pairs)


def store_tiles(
    edges: DataFrame, cell: float, table: str, path: str, by: Sequence[str] = ("id",), buckets: int = 200
) -> None:
    """Cut polygons once and keep the pieces as a table in buckets of cells, for any number of overlays.

    Each bucket is one file, sorted by cell. Tables that are to meet need one ``cell`` and one number of buckets. Edges and lids
    are kept first, so that what their making shuffled is gone from the disk before all pieces are dealt to the buckets.
    """
    keep, size = list(by), F.lit(float(cell))
    columns = _cut_columns(_pieces(cut_lineage(edges.select(*keep, *ENDS)), keep), keep, size)
    lids = cut_lineage(_corner_lids(columns, keep, size, bounded=False))
    dealt = _cut_rows(columns, keep, size).unionByName(lids).repartition(buckets, "c", "r")
    stored = dealt.write.mode("overwrite").format("parquet").option("path", path)
    with shuffles_dropped(edges.sparkSession):
        stored.bucketBy(buckets, "c", "r").sortBy("c", "r").saveAsTable(table)


def overlap_of_stored(
    spark: SparkSession,
    zones: str,
    systems: str,
    cell: float,
    zone: str = "zone_id",
    system: str = "pwsid",
    crowded_pairs: int = CROWDED_PAIRS,
) -> DataFrame:
    """``overlap_area`` of two stored sets of tiles. Both are joined where they lie: no exchange below the join.

    Where cells are crowded, those alone are cut again, which deals their pieces anew; the calm ones stay where they are.
    """
    a, b = spark.table(zones).withColumnRenamed("id", zone), spark.table(systems).withColumnRenamed("id", system)
    cells = ["c", "r"]
    crowded = _crowded([_whole(a), _whole(b)], [*cells, *PARTS], crowded_pairs)
    crowded = cut_lineage(crowded.select(*cells))
    labels = [zone, system]
    if crowded.isEmpty():
        met = _met(a, b, cells)
    else:
        calm = [side.join(crowded, cells, "left_anti") for side in (a, b)]
        dense = [cut_lineage(side.join(crowded, cells, "left_semi")) for side in (a, b)]
        fine, place = _levelled(dense, [[zone], [system]], cells, cell, crowded_pairs)
        added = [*labels, "__signed", "__common"]
        met = _met(*calm, cells).select(*added).unionByName(_met(*fine, place).select(*added))
    return _summed(met, labels).where(F.col("overlap_area") > 0)


def self_overlap(edges: DataFrame, cell: float, crowded_pairs: int = CROWDED_PAIRS) -> DataFrame:
    """Per polygon: its area, and the area that is covered more than once.

    Sound polygons have an excess of 0. Parts that overlap, and rings that cross
    themselves, show a positive one.
    """
    pieces = cut_lineage(tile(edges, cell))
    (pieces,), place = _levelled([pieces], [["id"]], ["id", "c", "r"], cell, crowded_pairs)
    squared = _sum_common(pieces, pieces, place, ["id"])
    return polygon_area(edges).join(squared, "id", "left").select(
        "id", "area", (F.coalesce("overlap_area", F.lit(0.0)) - F.col("area")).alias("excess")
    )


def invalid_polygons(edges: DataFrame, cell: float, tolerance: float = 1e-9) -> DataFrame:
    """Polygons to be set aside: not every point inside is counted exactly once."""
    return self_overlap(edges, cell).where(
        F.abs("excess") > tolerance * F.greatest(F.abs("area"), F.lit(float(cell) ** 2))
    )


def sound_only(edges: DataFrame, cell: float) -> DataFrame:
    """The polygons that ``invalid_polygons`` does not set aside."""
    return edges.join(invalid_polygons(edges, cell).select("id"), "id", "left_anti")


LABELS = ["part", "ring"]


def _is_hole() -> Column:
    return F.coalesce(F.col("ring") != 0, F.lit(False))


def _piece_area() -> Column:
    return F.col("s") * (F.col("xr") - F.col("xl")) * (F.col("yl") + F.col("yr")) / 2


def _suspect_cells(pieces: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Cells in which a point may count other than once, told by one aggregation.

    A cell with one piece of width, +1 and of an outer ring, is sound; so is one in which a piece of -1, of the same ring or of
    a hole in it, lies below that piece over all its width. These are nearly all cells of a sound polygon.
    """
    wide, plus = F.col("xl") < F.col("xr"), F.col("s") > 0
    piece = F.struct("part", "ring", _is_hole().alias("hole"), *PIECE[1:])
    found = pieces.where(wide).groupBy(*cells).agg(
        F.sum(plus.cast("int")).alias("n_plus"),
        F.sum((~plus).cast("int")).alias("n_minus"),
        F.max(F.when(plus, piece)).alias("p"),
        F.max(F.when(~plus, piece)).alias("m"),
    )

    def upper(x: Column) -> Column:
        p = {n: F.col(f"p.{n}") for n in PIECE[1:]}
        return p["yl"] + (p["yr"] - p["yl"]) * ((x - p["xl"]) / (p["xr"] - p["xl"]))

    same_part = F.col("p.part").eqNullSafe(F.col("m.part"))
    of_it = same_part & (F.col("m.hole") | F.col("p.ring").eqNullSafe(F.col("m.ring")))
    under = (F.col("p.xl") <= F.col("m.xl")) & (F.col("m.xr") <= F.col("p.xr"))
    under &= (upper(F.col("m.xl")) >= F.col("m.yl")) & (upper(F.col("m.xr")) >= F.col("m.yr"))
    sound = (F.col("n_plus") == 1) & ~F.col("p.hole")
    sound &= (F.col("n_minus") == 0) | ((F.col("n_minus") == 1) & of_it & under)
    return found.where(~sound).select(*cells)


def _doubled_cells(pieces: DataFrame, cell: float, by: Sequence[str]) -> DataFrame:
    """The cells (by..., c, r) in which a ring, a part or the whole does not count its points exactly once.

    The square of a count differs from the count unless it is 0 or 1. Rings and parts are looked at too, because a
    lobe that counts as -1 in one part can hide under another part.
    """
    cells = [*by, "c", "r"]
    pieces = cut_lineage(pieces.join(_suspect_cells(pieces, cells), cells, "left_semi"))
    (fine,), place = _levelled([pieces], [[*by, *LABELS]], cells, cell, CROWDED_PAIRS)
    met = _met(fine, fine, place, LABELS)
    same_part = F.col("a_part").eqNullSafe(F.col("b_part"))
    same_ring = same_part & F.col("a_ring").eqNullSafe(F.col("b_ring"))
    times = 1 + same_part.cast("int") + same_ring.cast("int")
    squares = met.groupBy(*cells).agg(
        F.sum(F.col("__signed") * times).alias("squares"), F.sum(F.abs("__common")).alias("terms")
    )
    counts = pieces.groupBy(*cells).agg(
        F.sum(_piece_area()).alias("area"),
        F.sum(_piece_area() * F.when(_is_hole(), 1).otherwise(3)).alias("counts"),
    )
    excess = F.abs(F.col("squares") - F.col("counts"))
    return squares.join(counts, cells).where(excess > ROUNDING * F.col("terms")).select(*cells, "area")


def _strips(pieces: DataFrame, place: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Pieces cut at all ends and crossings of their cell, so that within a strip none crosses another."""
    wide = pieces.where(F.col("xl") < F.col("xr")).select(*place, *keep, *PIECE)
    xl, yl, xr, yr = (F.col(n) for n in PIECE[1:])
    line = wide.select(*place, *PIECE[1:]).distinct()
    other = line.withColumnsRenamed({n: f"o_{n}" for n in PIECE[1:]})
    left, right = F.greatest("xl", "o_xl"), F.least("xr", "o_xr")
    met = line.join(other, list(place)).where(left < right)

    def gap(x: Column) -> Column:
        other_y = F.col("o_yl") + (F.col("o_yr") - F.col("o_yl")) * ((x - F.col("o_xl")) / (F.col("o_xr") - F.col("o_xl")))
        return yl + (yr - yl) * ((x - xl) / (xr - xl)) - other_y

    gaps = met.select(*place, left.alias("lo"), right.alias("hi"), gap(left).alias("dl"), gap(right).alias("dr"))
    crossed = gaps.where(F.col("dl") * F.col("dr") < 0).select(
        *place, (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("dl") / (F.col("dl") - F.col("dr")))).alias("lo")
    )
    ends = line.select(*place, F.explode(F.array("xl", "xr")).alias("lo"))
    onwards = Window.partitionBy(*place).orderBy("lo")
    strips = ends.unionByName(crossed).distinct().withColumn("hi", F.lead("lo").over(onwards))

    def y_at(x: Column) -> Column:
        return F.when(x == xl, yl).when(x == xr, yr).otherwise(yl + (yr - yl) * ((x - xl) / (xr - xl)))

    return (
        wide.join(strips.where(F.col("hi").isNotNull()), list(place))
        .where((xl <= F.col("lo")) & (F.col("hi") <= xr))
        .select(*place, *keep, "s", "lo", "hi", y_at(F.col("lo")).alias("yl"), y_at(F.col("hi")).alias("yr"))
    )


def _borders(strips: DataFrame, keys: Sequence[str], counts: Sequence[Column], inside) -> DataFrame:
    """The pieces of strips at which ``inside(counts)`` changes, from the top down, with the sign of the change."""
    down = Window.partitionBy(*keys, "lo").orderBy((-(F.col("yl") + F.col("yr"))), "s")
    down = down.rowsBetween(Window.unboundedPreceding, 0)
    now = strips.withColumns({f"__n{k}": F.sum(own).over(down) for k, own in enumerate(counts)})
    after = inside(*(F.col(f"__n{k}") for k in range(len(counts))))
    before = inside(*(F.col(f"__n{k}") - own for k, own in enumerate(counts)))
    changed = now.withColumn("__change", after.cast("int") - before.cast("int")).where("__change <> 0")
    return changed.withColumn("s", F.col("__change")).select(strips.columns)


def _united(pieces: DataFrame, doubled: DataFrame, cell: float, by: Sequence[str]) -> DataFrame:
    """The pieces of the doubled cells with every point counted once.

    A point is inside a ring if the ring winds around it, inside a part if it is in the outer ring and in no hole, and
    inside the polygon if it is in any part. Every piece comes with the upright ends of the strip below it, so that the
    result can be cut again.
    """
    cells = [*by, "c", "r"]
    ours = pieces.join(doubled.select(*cells), cells, "left_semi")
    (fine,), place = _levelled([cut_lineage(ours)], [[*by, *LABELS]], cells, cell, UNITED_PAIRS)
    strips = _strips(fine, place, LABELS)
    s = F.col("s")
    rings = _borders(strips, [*place, *LABELS], [s], lambda n: n != 0)
    outer_and_holes = [F.when(_is_hole(), 0).otherwise(s), F.when(_is_hole(), s).otherwise(0)]
    parts = _borders(rings, [*place, "part"], outer_and_holes, lambda n, holes: (n > 0) & (holes == 0))
    whole = _borders(parts, place, [s], lambda n: n > 0)

    size = F.lit(float(cell)) / F.col("cuts")
    left, right, floor = F.col("fc") * size + F.col("lo"), F.col("fc") * size + F.col("hi"), F.col("fr") * size
    yl, yr = floor + F.col("yl"), floor + F.col("yr")

    def row(sign: Column, *ends: Column) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip((sign, *ends), PIECE, strict=True)))

    rows = F.array(
        row(s, left, yl, right, yr),
        F.when(F.col("fr") > 0, row(-s, left, floor, right, floor)),
        F.when(yl > floor, row(s, left, floor, left, yl)),
        F.when(yr > floor, row(-s, right, floor, right, yr)),
    )
    united = whole.select(*cells, F.explode(rows).alias("p")).where("p is not null")
    return united.select(*cells, *(F.col(f"p.{n}").alias(n) for n in PIECE))


def counted_once(edges: DataFrame, cell: float, by: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Tiles and areas of polygons whose parts may overlap and whose rings may cross: every point counts once.

    Only the cells in which a point counts more than once are worked on; the others keep their pieces. The areas are
    (id, area).
    """
    by = list(by)
    cells = [*by, "c", "r"]
    labelled = edges.withColumns({n: F.lit(0) for n in LABELS if n not in edges.columns})
    pieces = cut_lineage(tile(labelled, cell, [*by, *LABELS]))
    doubled = cut_lineage(_doubled_cells(pieces, cell, by))
    if doubled.isEmpty():
        return pieces.select(*cells, *PIECE), polygon_area(edges).select("id", "area")
    united = cut_lineage(_united(pieces, doubled, cell, by))
    calm = pieces.join(doubled.select(*cells), cells, "left_anti")
    changes = united.select("id", _piece_area().alias("__change")).unionByName(doubled.select("id", (-F.col("area")).alias("__change")))
    changes = changes.groupBy("id").agg(F.sum("__change").alias("__change"))
    areas = polygon_area(edges).join(changes, "id", "left").select(
        "id", (F.col("area") + F.coalesce("__change", F.lit(0.0))).alias("area")
    )
    return calm.select(*cells, *PIECE).unionByName(united), areas


def unclosed_polygons(edges: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """(by..., reason) of the outlines that bound no area: edges that lead nowhere, or coordinates that are no numbers."""
    ends = ("x1", "y1", "x2", "y2")
    number = F.lit(True)
    for c in ends:
        number &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    points = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(n).alias("n")) for x, y, n in (("x1", "y1", 1), ("x2", "y2", -1))))
    met = edges.select(*by, number.alias("number"), F.explode(points).alias("p"))
    balance = met.groupBy(*by, "p.x", "p.y").agg(F.sum("p.n").alias("n"), F.min("number").alias("number"))
    reason = F.when(~F.min("number"), "coordinates that are no numbers").when(F.max(F.abs("n")) > 0, "not closed")
    return balance.groupBy(*by).agg(reason.alias("reason")).where("reason is not null")


def _within_reach(edges: DataFrame, other: DataFrame, within: Sequence[str]) -> DataFrame:
    """The polygons whose bounding box meets that of all ``other`` polygons together; no others share area with any."""
    names = {n: f"__{n}" for n in ("xmin", "ymin", "xmax", "ymax")}
    extent = F.broadcast(bbox(other, within).withColumnsRenamed(names))
    by = [*within, "id"]
    each = bbox(edges, by)
    met = each.join(extent, list(within)) if within else each.crossJoin(extent)
    for c in ("x", "y"):
        met = met.where((F.col(f"{c}min") <= F.col(f"__{c}max")) & (F.col(f"__{c}min") <= F.col(f"{c}max")))
    return edges.join(met.select(*by), by, "left_semi")


def overlay_and_quarantine(
    zones: DataFrame,
    systems: DataFrame,
    cell: float,
    zone_attributes: DataFrame,
    system_attributes: DataFrame,
    zone: str = "zone_id",
    system: str = "pwsid",
    within: Sequence[str] = (),
    checked: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``overlay``, and beside it what it had to set aside: (within..., side, id, reason) of outlines that are not closed.

    All outlines are looked at for the latter, when it is read; only those within reach of the other side are cut.
    """
    within = list(within)
    by = [*within, "id"]
    sides, aside = [], []
    for name, edges in ((zone, zones), (system, systems)):
        found = unclosed_polygons(edges, by)
        aside.append(found.select(*within, F.lit(name).alias("side"), F.col("id").cast("string").alias("id"), "reason"))
    near_zones = cut_lineage(_within_reach(zones, systems, within))
    near_systems = cut_lineage(_within_reach(systems, near_zones, within))
    for edges in (near_zones, near_systems):
        whole = edges.join(cut_lineage(unclosed_polygons(edges, by)), by, "left_anti")
        sides.append((cut_lineage(tile(whole, cell, by)), polygon_area(whole)) if checked else counted_once(whole, cell, by))
    (a, zone_areas), (b, system_areas) = sides
    pairs = _overlap_of_tiles(a, b, cell, zone, system, within, CROWDED_PAIRS)
    zone_side = zone_areas.withColumnsRenamed({"id": zone, "area": "zone_area"})
    system_side = system_areas.withColumnsRenamed({"id": system, "area": "system_area"})
    zone_side = zone_side.join(zone_attributes, zone, "left")
    system_side = system_side.join(system_attributes, system, "left")
    return pairs.join(zone_side, zone, "left").join(system_side, system, "left"), aside[0].unionByName(aside[1])


def overlay(
    zones: DataFrame,
    systems: DataFrame,
    cell: float,
    zone_attributes: DataFrame,
    system_attributes: DataFrame,
    zone: str = "zone_id",
    system: str = "pwsid",
    within: Sequence[str] = (),
    checked: bool = False,
) -> DataFrame:
    """Overlapping pairs with both areas, the shared area and all attributes.

    What an outline covers more than once, by overlapping parts of one id or rings that cross themselves, counts once, on
    both sides; ``checked`` says that nothing does. Outlines that are not closed are left out (see
    ``overlay_and_quarantine``).
    """
    return overlay_and_quarantine(
        zones, systems, cell, zone_attributes, system_attributes, zone, system, within, checked
    )[0]


# Pixel rows whose values are summed up in one block.
SUM_BLOCK = 4096


def pixel_cover(zones: DataFrame, size: float, by: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Which pixels polygons cover, without a row for each inner one.

    Returns the pixels that an outline passes through, (by..., c, r, area), and runs of whole ones,
    (by..., c, low, high, s): in column c all rows from low to high, covered s times. Both grow with the outline.
    """
    by = list(by)
    side = F.lit(float(size))
    columns = _cut_columns(_pieces(zones, by), by, side)
    parts = _cut_rows(columns, by, side)
    piece = F.col("s") * (F.col("xr") - F.col("xl")) * (F.col("yl") + F.col("yr")) / 2
    touched = parts.groupBy(*by, "c", "r").agg(F.sum(piece).alias("__area"), F.sum(F.abs(piece)).alias("__terms"))
    crossed = _left_crossings(columns, by, side)
    none = F.lit(None).cast("double")
    events = crossed.select(*by, "c", F.col("__row").alias("r"), "__s", none.alias("__area"), none.alias("__terms")).unionByName(
        touched.select(*by, "c", "r", F.lit(0).cast("bigint").alias("__s"), "__area", "__terms")
    )
    events = events.groupBy(*by, "c", "r").agg(*(F.sum(n).alias(n) for n in ("__s", "__area", "__terms")))
    downwards = Window.partitionBy(*by, "c").orderBy(F.desc("r"))
    upto = F.sum("__s").over(downwards.rowsBetween(Window.unboundedPreceding, 0))
    seen = events.withColumns({"__upto": upto, "__next": F.lead("r").over(downwards)})
    # The lid of a row is what was crossed above it.
    whole = (F.col("__upto") - F.col("__s")) * float(size) ** 2
    area, terms = F.coalesce("__area", F.lit(0.0)) + whole, F.coalesce("__terms", F.lit(0.0)) + F.abs(whole)
    edge = seen.select(*by, "c", "r", area.alias("area"), terms.alias("__terms"))
    edge = edge.where(F.col("area") > ROUNDING * F.col("__terms")).drop("__terms")
    runs = seen.where((F.col("__upto") > 0) & (F.col("__next") < F.col("r") - 1)).select(
        *by, "c", (F.col("__next") + 1).alias("low"), (F.col("r") - 1).alias("high"), F.col("__upto").alias("s")
    )
    return edge, runs


def _sums_upto(pixels: DataFrame, asked: DataFrame, keep: Sequence[str], value: str) -> DataFrame:
    """For each asked (keep..., c, r) the sum and the number of the pixels (c, r, value) of column c in rows up to r.

    Rows are summed within blocks, and the blocks' totals along the column, so that no window spans a whole column.
    """
    none = {k: asked.schema[k].dataType for k in keep}
    both = pixels.select(
        *(F.lit(None).cast(t).alias(k) for k, t in none.items()), "c", "r", F.col(value).cast("double").alias("__v"), F.lit(1).alias("__n")
    ).unionByName(asked.select(*keep, "c", "r", F.lit(0.0).alias("__v"), F.lit(0).alias("__n")))
    both = both.withColumn("__block", F.floor(F.col("r") / SUM_BLOCK))
    inside = Window.partitionBy("c", "__block").orderBy("r")
    inside = inside.rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"__sum": F.sum("__v").over(inside), "__count": F.sum("__n").over(inside)}).where("__n = 0")
    blocks = both.groupBy("c", "__block").agg(F.sum("__v").alias("__v"), F.sum("__n").alias("__n"))
    before = Window.partitionBy("c").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("c", "__block", F.sum("__v").over(before).alias("__v0"), F.sum("__n").over(before).alias("__n0"))
    met = seen.drop("__v", "__n").join(blocks, ["c", "__block"])
    return met.select(
        *keep,
        (F.col("__sum") + F.coalesce("__v0", F.lit(0.0))).alias("sum"),
        (F.col("__count") + F.coalesce("__n0", F.lit(0))).alias("count"),
    )


def zonal_mean(
    zones: DataFrame, pixels: DataFrame, size: float, value: str = "value",
    x0: float = 0.0, y0: float = 0.0, zone: str = "zone_id",
) -> DataFrame:
    """Mean pixel value per zone, each pixel weighted by the area of it inside.

    ``pixels`` holds (px, py, value), pixel (0, 0) having its lower left corner at
    (x0, y0). Zones are cut on the pixel grid itself, so pixels are never turned
    into polygons. Pixels on the outline are joined by position; inner ones are taken as runs, whose sums are
    differences of running sums along the pixel columns. Missing pixels are skipped.
    """
    moved = zones.withColumns(
        {c: F.col(c) - F.lit(x0 if c[0] == "x" else y0) for c in ("x1", "y1", "x2", "y2")}
    )
    edge, runs = pixel_cover(moved, size)
    known = pixels.where(F.col(value).isNotNull()).select(
        F.col("px").cast("bigint").alias("c"), F.col("py").cast("bigint").alias("r"), value
    )
    at_edge = edge.join(known, ["c", "r"]).select(
        "id", (F.col(value) * F.col("area")).alias("sum"), "area", F.lit(1).cast("bigint").alias("n")
    )
    ends = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("high").alias("r")),
        F.struct(F.lit(-1).alias("sign"), (F.col("low") - 1).alias("r")),
    )
    asked = runs.select("id", "c", "s", F.explode(ends).alias("e")).select("id", "c", "s", "e.sign", "e.r")
    weight = F.col("sign") * F.col("s") * float(size) ** 2
    within = _sums_upto(known, asked, ["id", "s", "sign"], value).select(
        "id", (weight * F.col("sum")).alias("sum"), (weight * F.col("count")).alias("area"), (F.col("sign") * F.col("count")).alias("n")
    )
    sums = at_edge.unionByName(within).groupBy(F.col("id").alias(zone)).agg(
        (F.sum("sum") / F.sum("area")).alias("mean"), F.sum("n").alias("n_pixels")
    )
    return sums.where("n_pixels > 0")


REGIONS = ["contiguous", *NON_CONTIGUOUS_FIPS.values()]


def region_of_state(fips: Column) -> Column:
    """``contiguous``, or the code of an outlying state or territory."""
    expr = F.lit("contiguous")
    for code, region in NON_CONTIGUOUS_FIPS.items():
        expr = F.when(fips == code, region).otherwise(expr)
    return expr


def region_of_agency(agency: Column) -> Column:
    return F.when(agency.isin(*NON_CONTIGUOUS_FIPS.values()), agency).otherwise("contiguous")


def with_region(df: DataFrame, geoid: str = "geoid") -> DataFrame:
    return df.withColumn("region", region_of_state(state_of(F.col(geoid))))


def union_regions(regions: Mapping[str, tuple[DataFrame, Mapping[str, str]]], columns: Sequence[str]) -> DataFrame:
    """Stack regional tables under common names: ``{region: (table, renames)}``."""
    stacked: DataFrame | None = None
    for region, (table, renames) in regions.items():
        one = table.withColumnsRenamed(dict(renames)).select(*columns, F.lit(region).alias("region"))
        stacked = one if stacked is None else stacked.unionByName(one)
    if stacked is None:
        raise ValueError("no regions given")
    return stacked
