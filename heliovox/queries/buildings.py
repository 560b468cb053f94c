"""Queries on rasters of walls, trajectories and planes of buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliovox.operators import building, graph, series, trajectory, views
from heliovox.queries.base import EVENTS, POINTS, events, points
from heliovox.queries.spatial import plane_sql
from heliovox.session import table

R = lambda c, n=6: (F.round(c, n) + F.lit(0.0)).alias(c)


def _wall(spark: SparkSession, d: str, least: float = 65.0) -> DataFrame:
    """Cells of a wall whose mean value is above 65, or another least."""
    cells = events(spark, d).groupBy((F.col("user_id") % 48).cast("bigint").alias("row"), F.hour("ts").cast("bigint").alias("col")).agg(F.avg("value").alias("m"))
    return cells.where(F.col("m") > least).select("row", "col")


def declutter(spark: SparkSession, d: str) -> DataFrame:
    """Points of the components of at least ten points of the occupied cells."""
    return graph.declutter(points(spark, d), 0.06, least=10).select("vec_id")


def closed_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return graph.closed(_wall(spark, d), ["row", "col"])


def opened_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return graph.opened(_wall(spark, d, 40.0), ["row", "col"], corners=False)


def wall_holes(spark: SparkSession, d: str) -> DataFrame:
    return graph.wall_holes(_wall(spark, d), rows=48, cols=24, least=1, most=200).select("cells", "r0", "c0", "r1", "c1")


def inferred_holes(spark: SparkSession, d: str) -> DataFrame:
    return graph.inferred_holes(_wall(spark, d), rows=48, cols=24, refine=2)


def footprint_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of half a metre under the bounding boxes of exported planes."""
    p = table(spark, d, "planes").where("corners_3d is not null")
    along = lambda n: F.transform("corners_3d", lambda c: c[n])
    boxes = p.select("plane_uid", F.array_min(along(0)).alias("u0"), F.array_max(along(0)).alias("u1"), F.array_min(along(1)).alias("v0"), F.array_max(along(1)).alias("v1"))
    return graph.footprints(boxes, 0.5).groupBy("row", "col").agg(F.count("*").alias("planes"))


def oriented_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """The rectangle of least area around the corners of each plane of a series, seen from above."""
    p = table(spark, d, "planes").where("corners_3d is not null").select("series_id", F.explode("corners_3d").alias("c"))
    out = building.oriented_rectangles(p.select("series_id", F.get("c", F.lit(0)).alias("u"), F.get("c", F.lit(1)).alias("v")), by="series_id")
    return out.select("series_id", F.round(F.col("width") * F.col("height"), 5).alias("area"), F.round(F.greatest("width", "height"), 4).alias("longer"))


def floor_levels(spark: SparkSession, d: str) -> DataFrame:
    """The plane through the lowest points of each class."""
    return building.levels(points(spark, d), by="label", band=0.15, share=0.1).select("label", "n", *[R(c, 5) for c in ("nx", "ny", "nz", "d")])


def heading_snap(spark: SparkSession, d: str) -> DataFrame:
    """Paths of users, their days as segments, with headings snapped to right angles and integrated again."""
    rows = events(spark, d).select("user_id", "us", (F.hour("ts") * 15.0).alias("heading"), "value", F.expr("us div 86400000000").alias("segment"))
    out = trajectory.snapped_headings(rows, by=["user_id"], segment="segment", order="us", heading="heading", length="value")
    return out.select("user_id", "us", R("x", 3), R("y", 3))


def rotation_fill(spark: SparkSession, d: str) -> DataFrame:
    """Poses of which every seventh rotation is lost, filled again."""
    p = table(spark, d, "posetum").where("posetum_row_idx is not null and qw is not null")
    # Of rows sent again the first by id.
    p = p.groupBy("session_id", "posetum_row_idx").agg(F.min_by(F.struct(*trajectory.QUATERNION), "pose_id").alias("q")).select("session_id", "posetum_row_idx", "q.*")
    kept = [F.when(F.col("posetum_row_idx") % 7 != 3, F.col(q)).alias(q) for q in trajectory.QUATERNION]
    filled = trajectory.fill_rotations(p.select("session_id", F.col("posetum_row_idx").alias("at"), *kept), by=["session_id"], order="at")
    return filled.select("session_id", "at", *[R(q) for q in trajectory.QUATERNION])


def wall_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Per user the weighted median of the clusters of values found without gaps, and the weighted mean correction towards it."""
    rows = events(spark, d).select("user_id", "value", "event_id", (F.hour("ts") + 1.0).alias("w"))
    out = series.consensus(rows, by=["user_id"], value="value", weight="w", tie="event_id", reach=15.0)
    return out.select("user_id", "n", F.round("correction", 5).alias("correction"))


def region_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones of regions, as boxes made of a user's events."""
    e = events(spark, d).select("user_id", F.hour("ts").alias("h"), "value")
    boxes = e.groupBy("user_id", (F.col("value") > 50).alias("side")).agg(F.min("h").alias("x0"), F.max("h").alias("x1"), F.floor(F.min("value") / 10).alias("y0"), F.floor(F.max("value") / 10).alias("y1"), F.avg(F.col("value") / 10).alias("cy"), F.count("*").alias("area"))
    return boxes.select("user_id", "side", views.zone(25).alias("zone"))


def image_tiles(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 13 + 101).cast("int").alias("w"), (F.col("n_nationkey") * 7 + 77).cast("int").alias("h"))
    return views.tiles(frames, width="w", height="h", rows=3, cols=4).select("n_nationkey", "r", "c", "x0", "y0", "x1", "y1")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Largest and mean turn between poses in succession, per session."""
    out = views.turn_between(table(spark, d, "posetum").where("qx is not null and qy is not null and qz is not null and qw is not null"), by=["session_id"], order="pose_id")
    return out.groupBy("session_id").agg(F.count("turn_deg").alias("n"), F.round(F.max("turn_deg"), 3).alias("most"), F.round(F.avg("turn_deg"), 3).alias("mean"))


def field_of_view(spark: SparkSession, d: str) -> DataFrame:
    """What a thermal camera sees, as a box in the image of a stereo camera beside it."""
    rotation = ((0.999, 0.02, -0.04), (-0.02, 0.9998, 0.0), (0.04, 0.001, 0.9992))
    return views.field_of_view(64, 48, (60.0, 60.0, 32.0, 24.0), (500.0, 500.0, 640.0, 360.0), rotation, (0.05, -0.02, 0.01), (1280, 720), spark)


def wall_layers(spark: SparkSession, d: str) -> DataFrame:
    return views.layers(events(spark, d).select("event_type", F.floor(F.col("value") / 7).alias("layer")), by=["event_type"], layer="layer")


def wall_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each wall's grid that is occupied, glazed or hidden, any layer counting."""
    cells = events(spark, d).select("event_type", (F.col("user_id") % 48).alias("row"), F.hour("ts").alias("col"), "value")
    return views.coverage(cells, by="event_type", rows=48, cols=24, kinds={"occupied": F.col("value") > 5, "glass": F.col("value") > 100, "hidden": F.col("value") < 2}, least=0.7).select("event_type", R("occupied"), R("glass"), R("hidden"), "kept")


def centre_matching(spark: SparkSession, d: str) -> DataFrame:
    """Corners of exported planes against those of the first plane of their series: the turn in which they fit best."""
    p = table(spark, d, "planes").where("corners_3d is not null").select("plane_uid", "series_id", F.posexplode("corners_3d").alias("k", "c"))
    flat = p.select("plane_uid", "series_id", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"))
    lead = flat.groupBy("series_id").agg(F.min("plane_uid").alias("lead"))
    pairs = flat.select("plane_uid", "series_id").distinct().join(lead, "series_id")
    nominal = pairs.join(flat.select(F.col("plane_uid").alias("lead"), "x", "y"), "lead").select("plane_uid", "x", "y")
    return views.matched_centres(flat.select("plane_uid", "x", "y"), nominal, by="plane_uid").select("plane_uid", "shift", R("residual"))


def merged_rectangles(spark: SparkSession, d: str) -> DataFrame:
    cells = events(spark, d).select("event_type", (F.col("user_id") % 24).cast("int").alias("row"), F.hour("ts").cast("int").alias("col")).distinct()
    return graph.merged_rectangles(graph.rectangles(cells, by="event_type"), by="event_type", gate=0.95)


QUERIES = {
    f.__name__: f
    for f in (
        declutter, closed_occupancy, opened_occupancy, wall_holes, inferred_holes, footprint_cells, oriented_rectangles, floor_levels, heading_snap, rotation_fill, wall_consensus,
        region_zones, image_tiles, turns, field_of_view, wall_layers, wall_coverage, centre_matching, merged_rectangles,
    )
}

_W = "w as (select user_id % 48 r, hour(ts) c from events group by 1, 2 having avg(value) > 65)"
_N8 = "(select a.x dr, b.x dc from (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(x))"
_N4 = f"(select * from {_N8} where abs(dr) + abs(dc) <= 1)"
_CLOSED = f"""{_W}, d as (select distinct r + dr r, c + dc c from w, {_N8}), e as (select r + dr r, c + dc c from d, {_N8} group by 1, 2 having count(*) = 9)"""
SQL = {
    "floor_levels": plane_sql(f"(select p.* from {POINTS} p join (select label, quantile_cont(z, 0.1) f from {POINTS} group by 1) using (label) where abs(z - f) <= 0.15::double)"),
    "centre_matching": """with k as (select plane_uid, series_id, c[1] x, c[2] y from (select plane_uid, series_id, unnest(corners_3d) c from planes where corners_3d is not null)), l as (select series_id, min(plane_uid) lead from k group by 1),
        n as (select p.plane_uid, k.x, k.y from (select distinct plane_uid, series_id from k) p join l using (series_id) join k on k.plane_uid = l.lead),
        a0 as (select plane_uid, x - avg(x) over w x, y - avg(y) over w y, count(*) over w m from k window w as (partition by plane_uid)), b0 as (select plane_uid, x - avg(x) over w x, y - avg(y) over w y from n window w as (partition by plane_uid)),
        a1 as (select *, row_number() over (partition by plane_uid order by atan2(y, x), x, y) - 1 i from a0), b as (select *, row_number() over (partition by plane_uid order by atan2(y, x), x, y) - 1 i from b0),
        a as (select plane_uid, x, y, shift, (i + shift) % m i from (select *, unnest(range(m)) shift from a1)),
        f as (select plane_uid, shift, count(*) n, sum(a.x * b.x + a.y * b.y) c, sum(a.x * b.y - a.y * b.x) s, sum(a.x * a.x + a.y * a.y + b.x * b.x + b.y * b.y) q from a join b using (plane_uid, i) group by 1, 2)
        select plane_uid, shift, round(r, 6) + 0.0 residual from (select *, row_number() over (partition by plane_uid order by r, shift) j from (select *, greatest(round((q - 2 * sqrt(c * c + s * s)) / n, 9), 0.0::double) r from f)) where j = 1""",
    # A side of the least rectangle lies along an edge of the hull, so no direction of any two points gives less.
    "oriented_rectangles": """with p as (select distinct series_id, round(c[1], 9) u, round(c[2], 9) v from (select series_id, unnest(corners_3d) c from planes where corners_3d is not null)),
        d as (select distinct a.series_id, round(((atan2(b.v - a.v, b.u - a.u) % (pi() / 2)) + pi() / 2) % (pi() / 2), 12) t from p a join p b on a.series_id = b.series_id and (a.u <> b.u or a.v <> b.v)),
        r as (select series_id, t, max(u * cos(t) + v * sin(t)) - min(u * cos(t) + v * sin(t)) w, max(v * cos(t) - u * sin(t)) - min(v * cos(t) - u * sin(t)) h from d join p using (series_id) group by 1, 2)
        select series_id, round(w * h, 5) area, round(greatest(w, h), 4) longer from (select *, row_number() over (partition by series_id order by w * h, t) i from r) where i = 1""",
    "rotation_fill": """with r as (select session_id, posetum_row_idx at_, case when posetum_row_idx % 7 <> 3 then struct_pack(o := posetum_row_idx, x := qx, y := qy, z := qz, w := qw) end q from posetum where posetum_row_idx is not null and qw is not null
          qualify row_number() over (partition by session_id, posetum_row_idx order by pose_id) = 1),
        b as (select session_id, at_, q, last_value(q ignore nulls) over (partition by session_id order by at_ rows between unbounded preceding and current row) a, first_value(q ignore nulls) over (partition by session_id order by at_ rows between current row and unbounded following) z from r),
        c as (select *, a.x * z.x + a.y * z.y + a.z * z.z + a.w * z.w c, coalesce((at_ - a.o)::double / nullif(z.o - a.o, 0), 0.0::double) t from b), h as (select *, acos(greatest(-1.0::double, least(1.0::double, abs(c)))) h from c),
        w as (select *, case when abs(c) > 0.9995 then 1 - t else sin((1 - t) * h) / sin(h) end f, case when abs(c) > 0.9995 then t else sin(t * h) / sin(h) end * case when c < 0 then -1.0::double else 1.0::double end s from h),
        m as (select *, f * a.x + s * z.x mx, f * a.y + s * z.y my, f * a.z + s * z.z mz, f * a.w + s * z.w mw from w), n as (select *, sqrt(mx * mx + my * my + mz * mz + mw * mw) n from m)
        select session_id, at_ as "at", """ + ", ".join(f"round(coalesce(q.{c}, m{c} / nullif(n, 0), a.{c}, z.{c}), 6) + 0.0 q{c}" for c in "xyzw") + """ from n""",
    "declutter": f"""with recursive p as (select *, cast(floor(x / 0.06) as bigint) i, cast(floor(y / 0.06) as bigint) j, cast(floor(z / 0.06) as bigint) k from {POINTS}),
        q as (select i, j, k, count(*) n, row_number() over (order by i, j, k) id from p group by 1, 2, 3),
        r as (select id a, id b from q union select r.a, y.id from r join q x on x.id = r.b join q y on abs(x.i - y.i) <= 1 and abs(x.j - y.j) <= 1 and abs(x.k - y.k) <= 1),
        m as (select b id, min(a) c from r group by 1), s as (select c from m join q using (id) group by 1 having sum(n) >= 10)
        select vec_id from p join q using (i, j, k) join m using (id) where c in (select c from s)""",
    "closed_occupancy": f'with {_CLOSED} select r as "row", c as "col" from e',
    "opened_occupancy": f"""with {_W.replace('65', '40')}, e as (select r + dr r, c + dc c from w, {_N4} group by 1, 2 having count(*) = 5) select distinct r + dr as "row", c + dc as "col" from e, {_N4}""",
    "wall_holes": f"""with recursive {_CLOSED}, k as (select * from e where r between 0 and 47 and c between 0 and 23), g as (select a.r, b.c from (select unnest(range(48)) r) a, (select unnest(range(24)) c) b),
        f as (select g.* from g anti join k using (r, c)), o as (select r, c from f where r = 0 or r = 47 or c = 0 or c = 23 union select f.r, f.c from o join f on abs(o.r - f.r) + abs(o.c - f.c) = 1),
        h as (select f.*, row_number() over (order by f.r, f.c) id from f anti join o using (r, c)), x as (select id a, id b from h union select x.a, z.id from x join h y on y.id = x.b join h z on abs(y.r - z.r) + abs(y.c - z.c) = 1),
        m as (select b id, min(a) n from x group by 1) select count(*) cells, min(r) r0, min(c) c0, max(r) r1, max(c) c1 from h join m using (id) group by n having count(*) <= 200""",
    "inferred_holes": f"""with {_W}, g as (select a.r, b.c from (select unnest(range(48)) r) a, (select unnest(range(24)) c) b), f as (select g.* from g anti join w using (r, c)) select r * 2 + a.x as "row", c * 2 + b.x as "col" from f, (values (0), (1)) a(x), (values (0), (1)) b(x)""",
    "footprint_cells": """with b as (select list_min(list_transform(corners_3d, lambda c: c[1])) u0, list_max(list_transform(corners_3d, lambda c: c[1])) u1, list_min(list_transform(corners_3d, lambda c: c[2])) v0, list_max(list_transform(corners_3d, lambda c: c[2])) v1 from planes where corners_3d is not null),
        r as (select unnest(range(cast(floor(v0 / 0.5) as bigint), cast(floor(v1 / 0.5) as bigint) + 1)) r, cast(floor(u0 / 0.5) as bigint) a, cast(floor(u1 / 0.5) as bigint) z from b), c as (select r, unnest(range(a, z + 1)) c from r)
        select r as "row", c as "col", count(*) planes from c group by 1, 2""",
    "heading_snap": f"""with e as (select user_id, us, hour(ts) * 15.0::double h, value, us // 86400000000 seg from {EVENTS}), m as (select user_id, seg, degrees(atan2(sum(value * sin(radians(h))), sum(value * cos(radians(h))))) m from e group by 1, 2),
        b as (select *, first_value(m) over (partition by user_id order by seg) b from m), t as (select user_id, seg, m - (b + 90.0 * round_even(round((m - b) / 90.0, 9), 0)) turn from b),
        s as (select e.*, radians(h - turn) a from e join t using (user_id, seg)) select user_id, us, round(sum(value * cos(a)) over w, 3) + 0.0 x, round(sum(value * sin(a)) over w, 3) + 0.0 y from s
        window w as (partition by user_id order by us rows unbounded preceding)""",
    "wall_consensus": """with r as (select user_id, value, event_id, hour(ts) + 1.0::double w from events), o as (select *, sum(w) over (partition by user_id order by value, event_id) c, sum(w) over (partition by user_id) t from r),
        m as (select user_id, min(value) med from o where 2 * c >= t group by 1) select user_id, count(*) n, round(sum((med - value) * w) / sum(w), 5) correction from r join m using (user_id) where abs(value - med) <= 15 group by 1""",
    "region_zones": """with b as (select user_id, value > 50 side, min(hour(ts)) x0, max(hour(ts)) x1, floor(min(value) / 10) y0, floor(max(value) / 10) y1, avg(value / 10) cy, count(*) area from events group by 1, 2),
        s as (select *, greatest(1, x1 - x0) w, greatest(1, y1 - y0) h from b) select user_id, side, case when cy / 25.0 > 0.55 and w > 1.6 * h and y1 >= 22 and area / (w * h) > 0.5 then 'floor' when cy / 25.0 < 0.30 and w > 0.8 * h then 'ceiling'
        when h > 1.3 * w then 'vertical' else 'any' end as "zone" from s""",
    "image_tiles": """with f as (select n_nationkey, n_nationkey * 13 + 101 w, n_nationkey * 7 + 77 h from nation) select n_nationkey, r, c, cast(round_even(w * c / 4.0::double, 0) as int) x0, cast(round_even(h * r / 3.0::double, 0) as int) y0,
        cast(round_even(w * (c + 1) / 4.0::double, 0) as int) x1, cast(round_even(h * (r + 1) / 3.0::double, 0) as int) y1 from f, (select unnest(range(3)) r), (select unnest(range(4)) c)""",
    "turns": """with p as (select session_id, (qx * lag(qx) over w + qy * lag(qy) over w + qz * lag(qz) over w + qw * lag(qw) over w) c, sqrt(qx * qx + qy * qy + qz * qz + qw * qw) s, lag(sqrt(qx * qx + qy * qy + qz * qz + qw * qw)) over w s0 from posetum
        where qx is not null and qy is not null and qz is not null and qw is not null window w as (partition by session_id order by pose_id)), t as (select session_id, 2 * degrees(acos(least(1.0::double, abs(c / (s * s0))))) t from p)
        select session_id, count(t) n, round(max(t), 3) most, round(avg(t), 3) mean from t group by 1""",
    "wall_layers": """with l as (select event_type, cast(floor(value / 7) as bigint) l from events), c as (select event_type, l, row_number() over (partition by event_type order by count(*) desc, l) i from l group by 1, 2)
        select c.event_type, any_value(c.l) as "mode", cast(round_even(quantile_cont(l.l, 0.5), 0) as bigint) as "median", cast(round_even(quantile_cont(l.l, 0.95), 0) as bigint) as "outer" from c join l using (event_type) where i = 1 group by 1""",
    "wall_coverage": """with c as (select event_type, user_id % 48 r, hour(ts) c, bool_or(value > 5) o, bool_or(value > 100) g, bool_or(value < 2) h from events group by 1, 2, 3)
        select event_type, round(sum(o::int) / 1152.0::double, 6) + 0.0 occupied, round(sum(g::int) / 1152.0::double, 6) + 0.0 glass, round(sum(h::int) / 1152.0::double, 6) + 0.0 hidden, sum(o::int) / 1152.0::double >= 0.7 kept from c group by 1""",
}
SQL["largest_holes"] = f"select * from ({SQL['wall_holes']}) order by cells desc, r0, c0 limit 2"
