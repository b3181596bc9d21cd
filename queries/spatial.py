"""Polygons made from the box views: geometry, overlay and zonal statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries.views import Views, with_views
from queries.weighting import rounded, settled
from zonewise.operators import geometry as g
from zonewise.operators import outlines
from zonewise.operators import overlay as o
from zonewise.operators import weights
from zonewise.plans import exposure
from zonewise.session import checkpoint_folder
from zonewise.sources import wkb

CELL = 16.0
BOX = ["x0", "y0", "w", "h"]


def boxes(df: DataFrame, key: str) -> DataFrame:
    return g.box_vertices(df, key, *(F.col(c) for c in BOX))


def box_edges(df: DataFrame, key: str) -> DataFrame:
    """Boxes as edges, each box a ring of its own.

    The views cut ids to six digits, so from key 1,000,000 on boxes far apart share an id. Linked by id alone, their
    vertices became one ring with edges from box to box.
    """
    vertices = g.box_vertices(df, key, *(F.col(c) for c in BOX), keep=BOX)
    edges = g.edges_from_vertices(vertices, ["id", *BOX])
    return edges.select("id", F.lit(0).alias("part"), F.lit(0).alias("ring"), *g.ENDS)


def zones(v: Views) -> DataFrame:
    return box_edges(v.zone_boxes(), "zone_id")


def systems(v: Views) -> DataFrame:
    return box_edges(v.system_boxes(), "pwsid")


def diamonds(v: Views) -> DataFrame:
    """The system boxes' inscribed diamonds, each with a diamond hole of half the size."""
    shapes = []
    for ring, scale in ((0, 0.5), (1, 0.25)):
        ring_points = [(0, -1), (1, 0), (0, 1), (-1, 0)]
        points = F.array(
            *(
                F.struct(
                    (F.col("x0") + F.col("w") * (0.5 + dx * scale)).alias("x"),
                    (F.col("y0") + F.col("h") * (0.5 + dy * scale)).alias("y"),
                )
                for dx, dy in ring_points
            )
        )
        shapes.append(
            v.system_boxes().select(F.col("pwsid").alias("id"), *BOX, F.posexplode(points).alias("seq", "p")).select(
                "id", *BOX, F.lit(0).alias("part"), F.lit(ring).alias("ring"), "seq", "p.x", "p.y"
            )
        )
    # Both rings are written counter-clockwise; normalize turns the holes. The box names them, as in box_edges.
    keys = ["id", *BOX, "part", "ring"]
    return g.normalize(g.edges_from_vertices(shapes[0].unionByName(shapes[1]), keys), keys).drop(*BOX)


def normalized_boxes(v: Views) -> DataFrame:
    """Boxes drawn clockwise, with a point-like ring added, come out sound."""
    reverse = boxes(v.system_boxes(), "pwsid").withColumn("seq", 3 - F.col("seq"))
    flat = reverse.withColumns({"part": F.lit(1), "y": F.lit(0.0)})
    edges = g.normalize(g.edges_from_vertices(reverse.unionByName(flat)))
    return rounded(g.area(edges, ["id", "part"]), area=6)


def pieces_of_boxes(v: Views) -> DataFrame:
    """Each system box as two features that meet along a line."""
    halves = v.system_boxes().select(
        "pwsid", "y0", "h", (F.col("w") / 2).alias("w"), F.posexplode(F.array(F.col("x0"), F.col("x0") + F.col("w") / 2)).alias("row", "x0")
    )
    named = halves.withColumn("feature", F.concat_ws("#", "pwsid", "row"))
    edges = box_edges(named, "feature")
    return edges.select(
        F.substring_index("id", "#", 1).alias("id"), F.substring_index("id", "#", -1).alias("row"), "part", "ring", *g.ENDS
    )


def pairs_of_boxes(v: Views) -> DataFrame:
    return rounded(o.overlap_area(zones(v), systems(v), CELL), overlap_area=4)


def stored_overlap(v: Views) -> DataFrame:
    """Both sides cut once and kept in buckets of cells, then met where they lie."""
    run = uuid.uuid4().hex[:12]
    sides = {f"zone_tiles_{run}": zones(v), f"system_tiles_{run}": systems(v)}
    for name, edges in sides.items():
        o.store_tiles(edges, CELL, name, f"{checkpoint_folder(v.spark)}/{name}", buckets=8)
    return rounded(o.overlap_of_stored(v.spark, *sides, CELL), overlap_area=4)


def overlay_pairs(v: Views) -> DataFrame:
    return o.overlay(
        zones(v), systems(v), CELL, v.zone_boxes().select("zone_id", "pop"), v.system_boxes().select("pwsid", "w", "h")
    )


def dissolve(v: Views) -> DataFrame:
    whole = g.dissolve(pieces_of_boxes(v), "id", "row")
    return rounded(o.overlap_area(zones(v), whole, CELL), overlap_area=4)


def overlay_exposure(v: Views) -> DataFrame:
    """From polygons to exposure: overlay, capped weights, rollup to rows of zones."""
    pairs = overlay_pairs(v).select("zone_id", "pwsid", "overlap_area", "zone_area", F.col("pop").alias("value"))
    weighted = weights.areal_weights(
        weights.dedupe_pairs(weights.only_eligible(pairs, v.measures()), zone="zone_id"), zone="zone_id"
    )
    served = weights.rollup(weighted, zone="zone_id", to=F.substring("zone_id", 1, 5))
    totals = v.zone_boxes().groupBy(F.substring("zone_id", 1, 5).alias("tract_geoid")).agg(F.sum("pop").alias("tract_total_pop"))
    out = exposure.tract_exposure(served, v.measures(), totals)
    out = rounded(
        out, dcpa_medpws_weighted=5, dcpa_maxpws_weighted=5, pfoa_35_medpws_weighted=5,
        tract_total_pop=2, pws_coverage_proportion=3, prop_no_pws=3,
    )
    return settled(out, ct_pop_pws=3)


def zonal_mean(v: Views) -> DataFrame:
    pixels = v.zone_boxes().select(
        (F.col("x0") / 10).alias("px"), (F.col("y0") / 10).alias("py"), F.col("pop").alias("value")
    )
    return settled(o.zonal_mean(systems(v), pixels, 10.0, zone="pwsid"), mean=4)


def overlap_of_parts(v: Views) -> DataFrame:
    """Two copies of a box, a quarter of its width apart, under one id: found and measured."""
    twice = v.system_boxes().select(
        "pwsid", "y0", "w", "h",
        F.posexplode(F.array(F.col("x0"), F.col("x0") + F.col("w") / 4)).alias("row", "x0"),
    ).withColumn("feature", F.concat_ws("#", "pwsid", "row"))
    edges = box_edges(twice, "feature").withColumn("id", F.substring_index("id", "#", 1))
    flagged = o.invalid_polygons(edges, CELL)
    return rounded(flagged, area=4, excess=4)


def overlay_of_duplicates(v: Views) -> DataFrame:
    """Each system as three overlapping features, two of them equal, under one id: counted once."""
    thrice = v.system_boxes().select(
        "pwsid", "y0", "w", "h",
        F.posexplode(F.array(F.col("x0"), F.col("x0"), F.col("x0") + F.col("w") / 4)).alias("row", "x0"),
    ).withColumn("feature", F.concat_ws("#", "pwsid", "row"))
    edges = box_edges(thrice, "feature").select(
        F.substring_index("id", "#", 1).alias("id"), F.substring_index("id", "#", -1).alias("row"), "part", "ring", *g.ENDS
    )
    pairs = o.overlay(
        zones(v), g.dissolve(edges, "id", "row"), CELL,
        v.zone_boxes().select("zone_id"), v.system_boxes().select("pwsid"),
    )
    return rounded(settled(pairs, overlap_area=4), zone_area=4, system_area=4)


def crossed_rings(v: Views) -> DataFrame:
    """Boxes drawn as figures of eight: no signed area, but not lost; they are set aside."""
    points = F.array(
        *(F.struct((F.col("x0") + F.col("w") * dx).alias("x"), (F.col("y0") + F.col("h") * dy).alias("y"))
          for dx, dy in ((0, 0), (1, 1), (1, 0), (0, 1)))
    )
    eights = v.system_boxes().select(
        F.col("pwsid").alias("id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.posexplode(points).alias("seq", "p")
    ).select("id", "part", "ring", "seq", "p.x", "p.y")
    edges = g.normalize(g.edges_from_vertices(eights))
    return rounded(o.invalid_polygons(edges, CELL), area=3, excess=3)


def _outline_figures(edges: DataFrame) -> DataFrame:
    return rounded(outlines.summary(edges), area=3, perimeter=3)


def repaired_outlines(v: Views) -> DataFrame:
    """Each system as a box drawn clockwise and left open, and beside it one drawn as a figure of eight: repaired."""
    corners = (((0, 0), (0, 1), (1, 1), (1, 0)), ((2, 0), (3, 1), (3, 0), (2, 1)))
    shapes = []
    for part, points in enumerate(corners):
        drawn = F.array(
            *(F.struct((F.col("x0") + F.col("w") * dx).alias("x"), (F.col("y0") + F.col("h") * dy).alias("y")) for dx, dy in points)
        )
        shapes.append(
            v.system_boxes().select(F.col("pwsid").alias("id"), F.posexplode(drawn).alias("seq", "p")).select(
                "id", F.lit(part).alias("part"), F.lit(0).alias("ring"), "seq", "p.x", "p.y"
            )
        )
    return _outline_figures(outlines.repair(g.edges_from_vertices(shapes[0].unionByName(shapes[1])), CELL))


def features_of_boxes(v: Views, places: list[tuple[float, float, float, float]]) -> DataFrame:
    """Each system as several box features under one id: (x, y, width, height) in shares of the system's box."""
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    named = [(x0 + w * x, y0 + h * y, w * dx, h * dy) for x, y, dx, dy in places]
    each = F.array(*(F.struct(*(c.alias(n) for c, n in zip(box, ("x0", "y0", "w", "h")))) for box in named))
    features = v.system_boxes().select("pwsid", F.posexplode(each).alias("row", "box"))
    features = features.select(F.concat_ws("#", "pwsid", "row").alias("feature"), "box.*")
    edges = box_edges(features, "feature")
    return edges.select(
        F.substring_index("id", "#", 1).alias("id"), F.substring_index("id", "#", -1).alias("row"), "part", "ring", *g.ENDS
    )


def dissolved_outlines(v: Views) -> DataFrame:
    """Three overlapping features under one id, two of them equal: one outline without inner edges."""
    thrice = features_of_boxes(v, [(0, 0, 1, 1), (0, 0, 1, 1), (0.25, 0, 1, 1)])
    return _outline_figures(outlines.dissolve(thrice, "id", "row", CELL))


def dissolved_frames(v: Views) -> DataFrame:
    """Four features around a gap, and a fifth inside it: one outline with a hole, and a part within that hole."""
    arms = [(0, 0, 1, 0.25), (0, 0.75, 1, 0.25), (0, 0, 0.25, 1), (0.75, 0, 0.25, 1), (0.375, 0.375, 0.25, 0.25)]
    return _outline_figures(outlines.dissolve(features_of_boxes(v, arms), "id", "row", CELL))


def project_albers(v: Views) -> DataFrame:
    degrees = v.table("customer").select(
        "c_custkey",
        (F.col("c_custkey") * 37 % 580 / 10.0 - 125).alias("lon"),
        (F.col("c_custkey") * 53 % 240 / 10.0 + 25).alias("lat"),
    )
    return rounded(g.project_albers(degrees, g.CONTIGUOUS), x=2, y=2)


def hex_outlines(v: Views) -> DataFrame:
    """Zones and systems written as hexadecimal outlines and read back."""
    vertices = boxes(v.zone_boxes(), "zone_id").unionByName(boxes(v.system_boxes(), "pwsid"))
    edges = g.edges_from_vertices(wkb.vertices_from_hex_wkb(wkb.hex_wkb_from_vertices(vertices), "geom_wkb"))
    return rounded(g.bbox(edges).join(g.area(edges), "id"), xmin=4, ymin=4, xmax=4, ymax=4, area=4)


def projected_regions(v: Views) -> DataFrame:
    """Places in three regions, each in its region's projection."""
    share = F.col("c_custkey") * 37 % 580 / F.lit(580.0)
    placed = v.table("customer").select("c_custkey", share.alias("u"), (F.col("c_custkey") * 53 % 470 / 10.0 + 18).alias("lat"))
    placed = placed.withColumn("region", F.when(F.col("lat") >= 50, "AK").when(F.col("lat") < 23, "HI").otherwise("contiguous"))
    lon = F.when(F.col("region") == "AK", F.col("u") * 40 - 175).when(F.col("region") == "HI", F.col("u") * 6 - 160.5)
    placed = placed.withColumn("lon", lon.otherwise(F.col("u") * 58 - 125)).drop("u")
    return rounded(g.project_by_region(placed), lon=6, x=2, y=2)


def region_routing(v: Views) -> DataFrame:
    routed = o.with_region(v.bg_pws())
    by_zone = routed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("zone"))
    agency = F.substring("n_name", 1, 2)
    by_agency = v.table("nation").groupBy(o.region_of_agency(agency).alias("region")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("what", F.lit("agency"))
    return by_zone.unionByName(by_agency)


def union_regions(v: Views) -> DataFrame:
    routed = o.with_region(v.bg_pws())
    parts = {}
    for region in o.REGIONS:
        own = f"{region.lower()}_zone_area"
        table = routed.where(F.col("region") == region).withColumnRenamed("zone_area", own).drop("region")
        parts[region] = (table, {own: "zone_area"})
    stacked = o.union_regions(parts, ["geoid", "pwsid", "overlap_area", "zone_area", "value"])
    return stacked.groupBy("region", "pwsid").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("zone_area"), 4).alias("zone_area")
    )


QUERIES = {
    "rings_from_vertices": lambda v: rounded(systems(v).drop("part", "ring"), x1=4, y1=4, x2=4, y2=4),
    "box_area": lambda v: rounded(g.area(systems(v)), area=4),
    "bounding_box": lambda v: rounded(g.bbox(diamonds(v)), xmin=4, ymin=4, xmax=4, ymax=4),
    "normalize_rings": normalized_boxes,
    "overlap_area": pairs_of_boxes,
    "stored_overlap": stored_overlap,
    "spatial_overlay": lambda v: rounded(overlay_pairs(v), overlap_area=4, zone_area=4, system_area=4),
    "overlay_of_duplicates": overlay_of_duplicates,
    "overlay_polygons": lambda v: settled(o.overlap_area(zones(v), diamonds(v), CELL), overlap_area=4),
    "overlay_exposure": overlay_exposure,
    "zonal_mean": zonal_mean,
    "dissolve": dissolve,
    "overlapping_parts": overlap_of_parts,
    "crossed_rings": crossed_rings,
    "repaired_outlines": repaired_outlines,
    "dissolved_outlines": dissolved_outlines,
    "dissolved_frames": dissolved_frames,
    "hex_outlines": hex_outlines,
    "project_albers": project_albers,
    "projected_regions": projected_regions,
    "region_routing": region_routing,
    "union_regions": union_regions,
}

BOX_PAIRS = """
select zone_id, pwsid, z.w * z.h as zone_area, s.w * s.h as system_area, pop, s.w, s.h,
       (least(z.x0 + z.w, s.x0 + s.w) - greatest(z.x0, s.x0)) * (least(z.y0 + z.h, s.y0 + s.h) - greatest(z.y0, s.y0))
         as overlap_area
from zone_boxes z join system_boxes s
  on z.x0 < s.x0 + s.w and s.x0 < z.x0 + z.w and z.y0 < s.y0 + s.h and s.y0 < z.y0 + z.h"""


def _edges_sql(source: str, key: str, points: list[tuple[str, str]], turn: bool) -> str:
    """Signed left-to-right edges of a shape, counter-clockwise unless turned."""
    rows = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        rows.append(f"select {key} as id, {ax} as px, {ay} as py, {bx} as qx, {by} as qy from {source}")
    sign = "1" if turn else "-1"
    return f"""select id, case when px < qx then {sign} else -({sign}) end as s, least(px, qx) as xl,
  case when px < qx then py else qy end as yl, greatest(px, qx) as xr, case when px < qx then qy else py end as yr
from ({' union all '.join(rows)}) where px <> qx"""


BOX_POINTS = [("x0", "y0"), ("x0 + w", "y0"), ("x0 + w", "y0 + h"), ("x0", "y0 + h")]


def _diamond(scale: float) -> list[tuple[str, str]]:
    return [
        (f"x0 + w * (0.5 + {dx} * {scale})", f"y0 + h * (0.5 + {dy} * {scale})")
        for dx, dy in ((0, -1), (1, 0), (0, 1), (-1, 0))
    ]


ZONE_EDGES = _edges_sql("zone_boxes", "zone_id", BOX_POINTS, False)
DIAMOND_EDGES = (
    _edges_sql("system_boxes", "pwsid", _diamond(0.5), False)
    + " union all " + _edges_sql("system_boxes", "pwsid", _diamond(0.25), True)
)
# Direct double sum over all edge pairs of candidate pairs: no grid involved.
EDGE_INTEGRAL = """
select zone_id, pwsid, sum(s * (twice - case when dl * dr >= 0 then (abs(dl) + abs(dr)) / 2
                       else (dl * dl + dr * dr) / (2 * (abs(dl) + abs(dr))) end) / 2 * (r - l)) as overlap_area
from (select zone_id, pwsid, s, l, r, (al + ar + bl + br) / 2 as twice, al - bl as dl, ar - br as dr
  from (select zone_id, pwsid, a.s * b.s as s, l, r,
      a.yl + (a.yr - a.yl) * (l - a.xl) / (a.xr - a.xl) as al, a.yl + (a.yr - a.yl) * (r - a.xl) / (a.xr - a.xl) as ar,
      b.yl + (b.yr - b.yl) * (l - b.xl) / (b.xr - b.xl) as bl, b.yl + (b.yr - b.yl) * (r - b.xl) / (b.xr - b.xl) as br
    from (select p.zone_id, p.pwsid, a, b, greatest(a.xl, b.xl) as l, least(a.xr, b.xr) as r
          from box_pairs p join zone_edges a on a.id = p.zone_id join diamond_edges b on b.id = p.pwsid
          where a.xl < b.xr and b.xl < a.xr)))
group by 1, 2"""
OVERLAY_SERVED = {
    "box_pairs": BOX_PAIRS,
    "o_weighted": """
select *, pop * case when ws > 1 then wgt / ws else wgt end as bg from (
  select *, sum(wgt) over (partition by zone_id) as ws from (
    select *, overlap_area / zone_area as wgt from box_pairs where pwsid in (select pwsid from measures)))""",
    "o_served": """
select substr(zone_id, 1, 5) as tract_geoid, pwsid, sum(bg) as bg from o_weighted group by 1, 2""",
    "o_totals": "select substr(zone_id, 1, 5) as tract_geoid, sum(pop) as total from zone_boxes group by 1",
}

ORACLES = {
    "rings_from_vertices": with_views(" union all ".join(
        f"select pwsid as id, round({a}, 4) as x1, round({b}, 4) as y1, round({c}, 4) as x2, round({d}, 4) as y2 from system_boxes"
        for (a, b), (c, d) in zip(BOX_POINTS, BOX_POINTS[1:] + BOX_POINTS[:1]))),
    "box_area": with_views("select pwsid as id, round(w * h, 4) as area from system_boxes"),
    "bounding_box": with_views("""
select pwsid as id, round(x0, 4) as xmin, round(y0, 4) as ymin, round(x0 + w, 4) as xmax, round(y0 + h, 4) as ymax
from system_boxes"""),
    "normalize_rings": with_views("select pwsid as id, 0 as part, round(w * h, 6) as area from system_boxes"),
    "overlap_area": with_views(
        "select zone_id, pwsid, round(overlap_area, 4) as overlap_area from box_pairs", box_pairs=BOX_PAIRS),
    "stored_overlap": with_views(
        "select zone_id, pwsid, round(overlap_area, 4) as overlap_area from box_pairs", box_pairs=BOX_PAIRS),
    "spatial_overlay": with_views("""
select zone_id, pwsid, round(overlap_area, 4) as overlap_area, round(zone_area, 4) as zone_area, pop,
       round(system_area, 4) as system_area, w, h from box_pairs""", box_pairs=BOX_PAIRS),
    "overlay_of_duplicates": with_views("""
select zone_id, pwsid, round(overlap_area + 1e-7, 4) as overlap_area, round(zone_area, 4) as zone_area,
       round(system_area, 4) as system_area
from (select zone_id, pwsid, z.w * z.h as zone_area, 1.25 * s.w * s.h as system_area,
    (least(z.x0 + z.w, s.x0 + 1.25 * s.w) - greatest(z.x0, s.x0)) * (least(z.y0 + z.h, s.y0 + s.h) - greatest(z.y0, s.y0))
      as overlap_area
  from zone_boxes z join system_boxes s
    on z.x0 < s.x0 + 1.25 * s.w and s.x0 < z.x0 + z.w and z.y0 < s.y0 + s.h and s.y0 < z.y0 + z.h)
where overlap_area > 1e-7"""),
    "overlay_polygons": with_views("""
select zone_id, pwsid, round(overlap_area + 1e-7, 4) as overlap_area from e where overlap_area > 1e-7""",
        box_pairs=BOX_PAIRS, zone_edges=ZONE_EDGES, diamond_edges=DIAMOND_EDGES, e=EDGE_INTEGRAL),
    "overlay_exposure": with_views("""
select tract_geoid, round(round(sum(dcpa_medpws * bg) / sum(bg), 9), 5) as dcpa_medpws_weighted,
       round(round(sum(dcpa_maxpws * bg) / sum(bg), 9), 5) as dcpa_maxpws_weighted,
       round(round(sum(pfoa_35_medpws * bg) / sum(bg), 9), 5) as pfoa_35_medpws_weighted, count(*) as n_pws_ucmr,
       round(sum(bg) + 1e-6, 3) as ct_pop_pws, max(dcpa_detectpws) as dcpa_detectpws,
       max(pfoa_35_detectpws) as pfoa_35_detectpws, round(max(total), 2) as tract_total_pop,
       round(sum(bg) / max(total), 3) as pws_coverage_proportion, round(1 - round(sum(bg) / max(total), 3), 3) as prop_no_pws
from o_served left join measures using (pwsid) left join o_totals using (tract_geoid) group by 1""", **OVERLAY_SERVED),
    "zonal_mean": with_views("""
select pwsid, round(sum(pop * overlap_area) / sum(overlap_area) + 1e-7, 4) as mean, count(*) as n_pixels
from box_pairs group by 1""", box_pairs=BOX_PAIRS),
    "dissolve": with_views(
        "select zone_id, pwsid, round(overlap_area, 4) as overlap_area from box_pairs", box_pairs=BOX_PAIRS),
    "overlapping_parts": with_views("""
select pwsid as id, round(2 * w * h, 4) as area, round(2 * (w * 0.75) * h, 4) as excess from system_boxes"""),
    "crossed_rings": with_views(
        "select pwsid as id, 0.0::double as area, round(w * h / 2, 3) as excess from system_boxes"),
    "repaired_outlines": with_views("""
select pwsid as id, round(1.5 * w * h, 3) as area, round(2 * (w + h) + 2 * h + 2 * sqrt(w * w + h * h), 3) as perimeter,
       3 as n_parts, 0 as n_holes from system_boxes"""),
    "dissolved_outlines": with_views("""
select pwsid as id, round(1.25 * w * h, 3) as area, round(2.5 * w + 2 * h, 3) as perimeter, 1 as n_parts, 0 as n_holes
from system_boxes"""),
    "dissolved_frames": with_views("""
select pwsid as id, round(0.8125 * w * h, 3) as area, round(3.5 * (w + h), 3) as perimeter, 2 as n_parts, 1 as n_holes
from system_boxes"""),
    "project_albers": """
with c as (select 0.08181919104281579 as e, 6378137.0::double as a),
k as (select e, a, e * e as e2, sin(radians(23)) as s0, sin(radians(29.5)) as s1, sin(radians(45.5)) as s2 from c),
q as (select *, (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) as q0,
             (1 - e2) * (s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) as q1,
             (1 - e2) * (s2 / (1 - e2 * s2 * s2) - ln((1 - e * s2) / (1 + e * s2)) / (2 * e)) as q2,
             (1 - s1 * s1) / (1 - e2 * s1 * s1) as m1, (1 - s2 * s2) / (1 - e2 * s2 * s2) as m2 from k),
n as (select *, (m1 - m2) / (q2 - q1) as n, m1 + (m1 - m2) / (q2 - q1) * q1 as cc from q),
d as (select c_custkey, c_custkey * 37 % 580 / 10.0::double - 125 as lon, c_custkey * 53 % 240 / 10.0::double + 25 as lat,
             sin(radians(c_custkey * 53 % 240 / 10.0::double + 25)) as s from customer),
r as (select *, a * sqrt(cc - n * q0) / n as rho0, radians(lon + 96) * n as th,
             a * sqrt(cc - n * (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / n as rho
      from d, n)
select c_custkey, lon, lat, round(rho * sin(th), 2) as x, round(rho0 - rho * cos(th), 2) as y from r""",
    "hex_outlines": with_views("""
select id, round(x0, 4) as xmin, round(y0, 4) as ymin, round(x0 + w, 4) as xmax, round(y0 + h, 4) as ymax, round(w * h, 4) as area
from (select zone_id as id, x0, y0, w, h from zone_boxes union all select pwsid, x0, y0, w, h from system_boxes)"""),
    "projected_regions": """
with c as (select 1 / 298.257222101 as f, 6378137.0::double as a, 1200 / 3937.0::double as foot),
p(region, lat0, lon0, p1, p2) as (values ('contiguous', 23.0, -96.0, 29.5, 45.5), ('AK', 50.0, -154.0, 55.0, 65.0)),
d as (select c_custkey, c_custkey * 37 % 580 / 580.0::double as u, c_custkey * 53 % 470 / 10.0::double + 18 as lat from customer),
r as (select *, case when lat >= 50 then 'AK' when lat < 23 then 'HI' else 'contiguous' end as region from d),
g as (select c_custkey, lat, region, case region when 'AK' then u * 40 - 175 when 'HI' then u * 6 - 160.5 else u * 58 - 125 end as lon
      from r),
k as (select *, sqrt(f * (2 - f)) as e, f * (2 - f) as e2, f / (2 - f) as n from c),
s as (select p.*, e, e2, a, sin(radians(lat0)) as s0, sin(radians(p1)) as s1, sin(radians(p2)) as s2 from p, k),
q as (select *, (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) as q0,
             (1 - e2) * (s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) as q1,
             (1 - e2) * (s2 / (1 - e2 * s2 * s2) - ln((1 - e * s2) / (1 + e * s2)) / (2 * e)) as q2,
             (1 - s1 * s1) / (1 - e2 * s1 * s1) as m1, (1 - s2 * s2) / (1 - e2 * s2 * s2) as m2 from s),
n as (select *, (m1 - m2) / (q2 - q1) as nn, m1 + (m1 - m2) / (q2 - q1) * q1 as cc from q),
al as (select c_custkey, lat, g.region, lon, radians(lon - lon0) * nn as th, a * sqrt(cc - nn * q0) / nn as rho0,
         a * sqrt(cc - nn * (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2)
           - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e))) / nn as rho
       from g join n on n.region = g.region),
t as (select *, n / 2 - 2 / 3.0::double * n ** 2 + 5 / 16.0::double * n ** 3 + 41 / 180.0::double * n ** 4 as a1,
             13 / 48.0::double * n ** 2 - 3 / 5.0::double * n ** 3 + 557 / 1440.0::double * n ** 4 as a2,
             61 / 240.0::double * n ** 3 - 103 / 140.0::double * n ** 4 as a3, 49561 / 161280.0::double * n ** 4 as a4,
             a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) * 0.99999 as big, radians(21 + 1 / 6.0::double) as b0 from k),
o as (select *, atan(sinh(atanh(sin(b0)) - e * atanh(e * sin(b0)))) as z0 from t),
h as (select *, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) as tt, radians(lon + 158) as l
      from g, o where region = 'HI'),
w as (select *, atan2(tt, cos(l)) as xi, asinh(sin(l) / sqrt(tt * tt + cos(l) ** 2)) as eta from h),
tm as (select c_custkey, lat, region, lon,
         (500000 + big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)
           + a4 * cos(8 * xi) * sinh(8 * eta))) / foot as x,
         big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)
           + a4 * sin(8 * xi) * cosh(8 * eta) - z0 - a1 * sin(2 * z0) - a2 * sin(4 * z0) - a3 * sin(6 * z0) - a4 * sin(8 * z0)) / foot as y
       from w)
select c_custkey, lat, region, round(lon, 6) as lon, round(x, 2) as x, round(y, 2) as y from tm
union all
select c_custkey, lat, region, round(lon, 6), round(rho * sin(th), 2), round(rho0 - rho * cos(th), 2) from al""",
    "region_routing": with_views("""
select case substr(geoid, 1, 2) when '02' then 'AK' else 'contiguous' end as region, count(*) as n, 'zone' as what
from bg_pws group by 1
union all
select case when substr(n_name, 1, 2) in ('AK', 'HI', 'GU', 'PR') then substr(n_name, 1, 2) else 'contiguous' end,
       count(*), 'agency' from nation group by 1"""),
    "union_regions": with_views("""
select case substr(geoid, 1, 2) when '02' then 'AK' when '15' then 'HI' when '66' then 'GU' when '72' then 'PR'
            else 'contiguous' end as region, pwsid, count(*) as n,
       round(sum(zone_area), 4) as zone_area from bg_pws group by 1, 2"""),
}
