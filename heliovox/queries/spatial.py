"""Queries on points in space, planes, components and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from heliovox.functions import geometry as g
from heliovox.operators import graph, lattice, space
from heliovox.queries.base import POINTS, event_points, events, points
from heliovox.session import table

R = lambda c, n=6: (F.round(c, n) + F.lit(0.0)).alias(c)
PLANES = [(0, 1.0, 0.0, 0.0, -0.05), (1, 0.0, 1.0, 0.0, 0.1), (2, 0.0, 0.0, 2.0, 0.0), (3, 0.6, 0.8, 0.0, 0.02)]
FACES = [(0, 0, 0.1, -0.1, 0.1, -0.2, 0.2), (1, 1, -0.05, -0.3, 0.1, 0.0, 0.3), (2, 2, 0.0, -0.1, 0.2, -0.1, 0.2)]
# Fixed values of an example camera: focal lengths and centre, distortion, and the pose of the sensor.
CAMERA = (520.0, 515.0, 320.0, 240.0)
# Fixed values of a revisit: distance in plan, samples between, and samples in a block.
REVISIT_M, REVISIT_GAP, REVISIT_BLOCK = 0.5, 100, 1000
DISTORTION = (-0.12, 0.03, 0.001, -0.0005, 0.002)


def z_buffer(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", (F.col("user_id") % 40).alias("row"), F.hour("ts").alias("col"), "value")
    return space.z_buffer(rows, pixel=["row", "col"], depth="value", tolerance=8.0).select("event_id", "row", "col")


def pinhole_project(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    pose = g.quaternion_rows(*g.unit((0.1, -0.2, 0.05, 0.97)))
    local = g.to_local(pose, g.unit((0.3, -0.1, -2.0)), [F.col(a) for a in "xyz"])
    u, v = g.pinhole(local, CAMERA, DISTORTION)
    out = p.select("vec_id", u.alias("u"), v.alias("v"), local[2].alias("depth"))
    return out.select("vec_id", R("u", 4), R("v", 4), R("depth"), g.in_view(F.col("u"), F.col("v"), F.col("depth"), 640, 480).alias("valid"))


def nearest_plane(spark: SparkSession, d: str) -> DataFrame:
    planes = spark.createDataFrame(PLANES, "plane_id int, nx double, ny double, nz double, d double")
    return space.nearest_plane(points(spark, d), planes, point_id="vec_id", threshold=0.04)


def bounded_face(spark: SparkSession, d: str) -> DataFrame:
    faces = spark.createDataFrame(FACES, "face_id int, axis int, fixed double, lo0 double, hi0 double, lo1 double, hi1 double")
    return space.bounded_face(points(spark, d), faces, point_id="vec_id", tolerance=0.05)


def angular_window_stats(spark: SparkSession, d: str) -> DataFrame:
    """Range statistics within 30 degrees of the line of sight."""
    p = [F.col(a) for a in "xyz"]
    rows = points(spark, d).select(g.norm(p).alias("r"), (g.angular_window(p, 30.0) & (F.col("x") > 0)).alias("seen"))
    r = F.when(F.col("seen") & F.col("r").between(0.05, 1.0), F.col("r"))
    return rows.agg(F.count(r).alias("n"), F.count("*").alias("n_total"), *[F.round(f(r), 6).alias(n) for n, f in (("min_r", F.min), ("max_r", F.max), ("mean_r", F.avg), ("std_r", F.stddev_pop))], F.round(F.percentile(r, F.lit(0.5)), 6).alias("median_r"))


def segment_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_type", F.col("user_id").alias("col"), F.hour("ts").alias("row")).distinct()
    return rows.groupBy("event_type").agg(
        F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") + 1).alias("r1"), (F.max("col") + 1).alias("c1"), F.count("*").alias("area"), F.round(F.avg("row"), 6).alias("row_mean"), F.round(F.avg("col"), 6).alias("col_mean")
    )


def outlier_knn(spark: SparkSession, d: str) -> DataFrame:
    return space.knn_outliers(points(spark, d), point_id="vec_id", k=8, ratio=1.0).select("vec_id", R("mean_distance"), "kept")


def outlier_density(spark: SparkSession, d: str) -> DataFrame:
    return space.voxel_outliers(points(spark, d), 0.1, 1.0).select("vec_id")


def densest_crop(spark: SparkSession, d: str) -> DataFrame:
    return space.densest_crop(points(spark, d), 0.1, 0.12).select("vec_id")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    out = graph.cell_components(lattice.distinct_cells(points(spark, d), 0.1), ["i", "j", "k"])
    first = out.groupBy("component").agg(F.min(F.struct("i", "j", "k")).alias("f"), F.count("*").alias("cells"))
    return first.select("f.i", "f.j", "f.k", "cells")


def largest_component(spark: SparkSession, d: str) -> DataFrame:
    return graph.largest_component(lattice.voxels(points(spark, d), 0.1, label="label"), ["i", "j", "k"], weight="n")


def enclosed_hole_fill(spark: SparkSession, d: str) -> DataFrame:
    """Empty regions enclosed in a raster of users by hours: pixels whose mean value is above 50; a pixel's label is the most of its users' hundreds."""
    cells = events(spark, d).groupBy(F.col("user_id").alias("row"), F.hour("ts").alias("col")).agg(F.avg("value").alias("m"), F.max(F.floor(F.col("value") / 100)).alias("label"))
    raster = cells.where("m > 50").select("row", "col", F.least("label", F.lit(2)).alias("label"))
    rows = (cells.agg(F.max("row")).first()[0] or 0) + 1
    return graph.fill_enclosed(raster, rows=rows, cols=24).groupBy("label", "filled").agg(F.count("*").alias("cells"))


def principal_yaw(spark: SparkSession, d: str) -> DataFrame:
    return space.principal_yaw(points(spark, d)).select(R("yaw_deg", 5))


def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return space.folded_circular_mean(p, F.degrees(F.atan2("y", "x")), by=["label"]).select("label", R("mean_deg", 4), R("dispersion"))


def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    return space.fit_planes(points(spark, d), ["label"]).select("label", "n", *[R(c, 5) for c in ("nx", "ny", "nz", "d")])


def rigid_fit_2d(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(n)).cast("double").alias(a) for n, a in enumerate(("sx", "sy", "dx", "dy"))])
    return space.rigid_fit_2d(rows, ["label"]).select("label", R("theta_deg", 4), R("tx"), R("ty"))


def plane_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Canonical normal, tilt, axis and bearing of every exported plane."""
    p = table(spark, d, "planes").where("normal is not null and d is not null").select("plane_uid", *[F.get("normal", F.lit(n)).alias(a) for n, a in enumerate(("nx", "ny", "nz"))], "d")
    n = [F.col(a) for a in ("nx", "ny", "nz")]
    c = g.canonical(n, F.col("d"))
    out = p.select("plane_uid", *[x.alias("c" + a) for x, a in zip(c, ("x", "y", "z", "d"))], g.tilt(n).alias("tilt"), g.axis_of(n).alias("axis"), g.bearing(n[0], n[1], 15.0).alias("bearing"))
    return out.select("plane_uid", *[R(a) for a in ("cx", "cy", "cz", "cd")], R("tilt", 4), "axis", R("bearing", 4))


def revisit_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For every pose the nearest pose of its session within half a metre in plan that lies at least 100 samples before; of equally near ones the earliest, then the smaller id."""
    p = table(spark, d, "posetum").select("session_id", "pose_id", F.col("posetum_row_idx").alias("at"), "tx", "ty").dropna()
    p = p.withColumn("cx", F.floor(F.col("tx") / REVISIT_M)).withColumn("cy", F.floor(F.col("ty") / REVISIT_M))
    # Poses within reach stand in the same cell or one of its eight neighbours. Blocks of samples keep a cell where a session stands still from being one task's.
    late = p.withColumn("block", F.floor(F.col("at") / REVISIT_BLOCK))
    last = p.groupBy("session_id").agg(F.max("at").alias("last"))
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    early = p.join(last, "session_id").select(
        "session_id", F.col("pose_id").alias("earlier_id"), F.col("at").alias("earlier_at"), F.col("tx").alias("ex"), F.col("ty").alias("ey"), "cx", "cy", "last", F.explode(steps).alias("s")
    )
    early = early.where(F.col("earlier_at") + REVISIT_GAP <= F.col("last")).withColumn("block", F.explode(F.sequence(F.floor((F.col("earlier_at") + REVISIT_GAP) / REVISIT_BLOCK), F.floor(F.col("last") / REVISIT_BLOCK))))
    early = early.select("session_id", "earlier_id", "earlier_at", "ex", "ey", (F.col("cx") + F.col("s.x")).alias("cx"), (F.col("cy") + F.col("s.y")).alias("cy"), "block")
    gap = F.sqrt((F.col("tx") - F.col("ex")) * (F.col("tx") - F.col("ex")) + (F.col("ty") - F.col("ey")) * (F.col("ty") - F.col("ey")))
    met = late.join(early, ["session_id", "cx", "cy", "block"]).where(F.col("earlier_at") + REVISIT_GAP <= F.col("at")).withColumn("distance", gap).where(F.col("distance") <= REVISIT_M)
    best = met.groupBy("session_id", "pose_id", "at").agg(F.min(F.struct("distance", "earlier_at", "earlier_id")).alias("b"))
    return best.select("session_id", "pose_id", "at", "b.earlier_id", "b.earlier_at", F.round("b.distance", 9).alias("distance"))


def top_k_similarity(spark: SparkSession, d: str) -> DataFrame:
    """For every class the five vectors most like its mean."""
    score = space.class_cosines(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), vector="embedding", label="label", keep=["vec_id"])
    # A rank limit is pushed below the shuffle, so only five rows per task and class are moved.
    w = Window.partitionBy("label").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    top = score.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return top.select("label", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


def nearest_fill(spark: SparkSession, d: str) -> DataFrame:
    """Empty pixels of sparse frames filled from the nearest sampled one."""
    base = events(spark, d).select(F.col("event_type").alias("frame"), (F.col("user_id") % 30).cast("int").alias("row"), F.hour("ts").cast("int").alias("col"), "value", "event_id")
    samples = base.groupBy("frame", "row", "col").agg(F.min_by("value", "event_id").alias("value")).where("(row + col) % 5 = 0")
    cells = base.select("frame", "row", "col").distinct()
    return space.nearest_sample(cells, samples, frame="frame", value="value")


def ransac_plane(spark: SparkSession, d: str) -> DataFrame:
    """The plane that most events lie near, as points of user, value and hour."""
    return space.ransac_plane(event_points(spark, d), threshold=0.05)


def plane_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Exported planes left per series when fragments of one surface are merged; a series is one building's planes."""
    rows = table(spark, d, "planes").where("normal is not null and d is not null and centroid_3d is not null and inlier_count is not null").dropDuplicates(["series_id", "id"])

    def merge(pdf):
        found = space.dedupe_planes([{"id": i, "normal": n, "d": x, "inlier_count": c, "centroid": m} for i, n, x, c, m in zip(pdf["id"], pdf["normal"], pdf["d"], pdf["inlier_count"], pdf["centroid_3d"])])
        return pdf[pdf["id"].isin([p["id"] for p in found])][["series_id", "id", "inlier_count"]]

    return rows.select("series_id", "id", "normal", "d", "inlier_count", "centroid_3d").groupBy("series_id").applyInPandas(merge, "series_id long, id int, inlier_count long")


def greedy_rectangles(spark: SparkSession, d: str) -> DataFrame:
    cells = events(spark, d).select("event_type", (F.col("user_id") % 24).cast("int").alias("row"), F.hour("ts").cast("int").alias("col")).distinct()
    return graph.rectangles(cells, by="event_type")


def largest_rectangles(spark: SparkSession, d: str) -> DataFrame:
    cells = events(spark, d).groupBy("event_type", (F.col("user_id") % 24).cast("int").alias("row"), F.hour("ts").cast("int").alias("col")).agg(F.avg("value").alias("m")).where("m > 25")
    return graph.inscribed(cells, by="event_type").select("event_type", "area")


QUERIES = {
    f.__name__: f
    for f in (
        z_buffer, pinhole_project, nearest_plane, bounded_face, angular_window_stats, segment_boxes, outlier_knn, outlier_density, densest_crop, connected_components, largest_component,
        enclosed_hole_fill, principal_yaw, circular_mean, plane_fit, rigid_fit_2d, plane_attributes, revisit_nearest, top_k_similarity, nearest_fill, ransac_plane, plane_dedupe,
        greedy_rectangles, largest_rectangles,
    )
}

_V = lambda rows: ", ".join("(" + ", ".join(f"{v!r}::double" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
_CELLS3 = f"c as (select *, cast(floor(x / 0.1) as bigint) i, cast(floor(y / 0.1) as bigint) j, cast(floor(z / 0.1) as bigint) k from {POINTS}), o as (select i, j, k, count(*) n from c group by 1, 2, 3)"
_REACH = f"""with recursive {_CELLS3}, q as (select *, row_number() over (order by i, j, k) id from o),
    r as (select id a, id b from q union select r.a, y.id from r join q x on x.id = r.b join q y on abs(x.i - y.i) <= 1 and abs(x.j - y.j) <= 1 and abs(x.k - y.k) <= 1),
    m as (select b id, min(a) c from r group by 1), l as (select q.*, m.c from q join m using (id))"""
# The rotation of the example pose, as numbers.
_X, _Y, _Z, _W = 0.1, -0.2, 0.05, 0.97
_S = 2.0 / (_X * _X + _Y * _Y + _Z * _Z + _W * _W)
_ROT = [[1 - _S * (_Y * _Y + _Z * _Z), _S * (_X * _Y - _Z * _W), _S * (_X * _Z + _Y * _W)], [_S * (_X * _Y + _Z * _W), 1 - _S * (_X * _X + _Z * _Z), _S * (_Y * _Z - _X * _W)], [_S * (_X * _Z - _Y * _W), _S * (_Y * _Z + _X * _W), 1 - _S * (_X * _X + _Y * _Y)]]
_LOCAL = [" + ".join(f"({_ROT[r][c]!r}::double) * ({a} - ({o}::double))" for r, (a, o) in enumerate((("x", 0.3), ("y", -0.1), ("z", -2.0)))) for c in range(3)]

def plane_sql(source: str) -> str:
    """SQL for the plane of least squares of each label's points: the direction of the least eigenvalue, in closed form."""
    return f"""with c as (select label, count(*) n, avg(x) mx, avg(y) my, avg(z) mz, covar_pop(x, x) a, covar_pop(y, y) b, covar_pop(z, z) c, covar_pop(x, y) d, covar_pop(x, z) e, covar_pop(y, z) f from {source} group by 1),
        q as (select *, (a + b + c) / 3 q from c), p as (select *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) p from q),
        r as (select *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p) r from p),
        l as (select *, q + 2 * p * cos(acos(greatest(-1.0::double, least(1.0::double, r))) / 3 + 2 * pi() / 3) l from r),
        s as (select *, [[d * f - e * (b - l), e * d - (a - l) * f, (a - l) * (b - l) - d * d], [d * (c - l) - e * f, e * e - (a - l) * (c - l), (a - l) * f - d * e], [(b - l) * (c - l) - f * f, f * e - d * (c - l), d * f - (b - l) * e]] k from l),
        v as (select *, list_sort(list_transform(k, lambda t: {{'s': -(t[1] * t[1] + t[2] * t[2] + t[3] * t[3]), 't': t}}))[1] v from s),
        w as (select *, v.t[1] / sqrt(-v.s) x, v.t[2] / sqrt(-v.s) y, v.t[3] / sqrt(-v.s) z from v),
        u as (select *, case when case when abs(x) >= abs(y) and abs(x) >= abs(z) then x when abs(y) >= abs(z) then y else z end < 0 then -1.0::double else 1.0::double end g from w)
        select label, n, round(x * g, 5) + 0.0 nx, round(y * g, 5) + 0.0 ny, round(z * g, 5) + 0.0 nz, round(-g * (x * mx + y * my + z * mz), 5) + 0.0 d from u"""


SQL = {
    "z_buffer": """with e as (select event_id, user_id % 40 as row_, hour(ts) as col_, value from events) select event_id, row_ as "row", col_ as "col" from
        (select *, min(value) over (partition by row_, col_) least_ from e) where value <= least_ + 8.0""",
    "pinhole_project": f"""with l as (select vec_id, {_LOCAL[0]} a, {_LOCAL[1]} b, {_LOCAL[2]} c from {POINTS}), n as (select *, a / c x, b / c y, (a / c) * (a / c) + (b / c) * (b / c) r from l),
        q as (select *, 1 + r * (-0.12::double + r * (0.03::double + r * 0.002::double)) k from n), p as (select vec_id, c, 520.0::double * (x * k + 2 * 0.001::double * x * y - 0.0005::double * (r + 2 * x * x)) + 320 u,
        515.0::double * (y * k + 0.001::double * (r + 2 * y * y) - 2 * 0.0005::double * x * y) + 240 v from q)
        select vec_id, round(u, 4) + 0.0 u, round(v, 4) + 0.0 v, round(c, 6) + 0.0 as "depth", c > 0 and u >= 0 and u < 640 and v >= 0 and v < 480 as valid from p""",
    "nearest_plane": f"""with p as (select * from (values {_V(PLANES)}) p(plane_id, nx, ny, nz, d)), q as (select vec_id, plane_id, abs(x * nx + y * ny + z * nz + d) / sqrt(nx * nx + ny * ny + nz * nz) g from {POINTS}, p),
        b as (select *, row_number() over (partition by vec_id order by g, plane_id) i from q) select vec_id, case when g <= 0.04 then plane_id else -1 end plane_id from b where i = 1""",
    "bounded_face": f"""with f as (select * from (values {_V(FACES)}) f(face_id, axis, fixed, lo0, hi0, lo1, hi1)),
        q as (select vec_id, face_id, abs(case axis when 0 then x when 1 then y else z end - fixed) g, case axis when 0 then y else x end a, case axis when 2 then y else z end b, f.* exclude (face_id) from {POINTS}, f),
        w as (select * from q where g <= 0.05 and a between lo0 - 0.05::double and hi0 + 0.05::double and b between lo1 - 0.05::double and hi1 + 0.05::double)
        select vec_id, face_id from (select *, row_number() over (partition by vec_id order by g, face_id) i from w) where i = 1""",
    "angular_window_stats": f"""with r as (select sqrt(x * x + y * y + z * z) r, abs(degrees(atan2(y, x))) <= 30 and abs(degrees(atan2(z, sqrt(x * x + y * y)))) <= 30 and x > 0 seen from {POINTS}),
        q as (select case when seen and r between 0.05 and 1.0 then r end r from r) select count(r) n, count(*) n_total, round(min(r), 6) min_r, round(max(r), 6) max_r, round(avg(r), 6) mean_r, round(stddev_pop(r), 6) std_r, round(quantile_cont(r, 0.5), 6) median_r from q""",
    "segment_boxes": """with c as (select distinct event_type, user_id as col_, hour(ts) as row_ from events) select event_type, min(row_) r0, min(col_) c0, max(row_) + 1 r1, max(col_) + 1 c1, count(*) area,
        round(avg(row_), 6) row_mean, round(avg(col_), 6) col_mean from c group by 1""",
    "outlier_knn": f"""with p as {POINTS}, d as (select a.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) g from p a, p b where a.vec_id <> b.vec_id),
        k as (select vec_id, avg(g) m from (select *, row_number() over (partition by vec_id order by g) i from d) where i <= 8 group by 1)
        select vec_id, round(m, 6) + 0.0 mean_distance, m < (select avg(m) + stddev_pop(m) from k) kept from k""",
    "outlier_density": f"""with c as (select *, count(*) over (partition by floor(x / 0.1), floor(y / 0.1), floor(z / 0.1)) n from {POINTS}) select vec_id from c where n >= greatest(2, (select avg(n) - stddev_pop(n) from c))""",
    "densest_crop": f"""with c as (select *, cast(floor(x / 0.1) as bigint) i, cast(floor(y / 0.1) as bigint) j from {POINTS}), b as (select i, j from c group by 1, 2 order by count(*) desc, 1, 2 limit 1)
        select vec_id from c, (select (i + 0.5) * 0.1::double cx, (j + 0.5) * 0.1::double cy from b) where abs(x - cx) <= 0.12::double and abs(y - cy) <= 0.12::double""",
    "connected_components": f"{_REACH} select l.i, l.j, l.k, n_ cells from l join (select c, min(id) f, count(*) n_ from l group by 1) g on l.id = g.f",
    "largest_component": f"{_REACH} select i, j, k from l where c = (select c from l group by 1 order by sum(n) desc, c limit 1)",
    "enclosed_hole_fill": """with recursive a as (select user_id r, hour(ts) c, avg(value) m, max(cast(floor(value / 100) as bigint)) label from events group by 1, 2), n as (select max(r) z from a),
        k as (select r, c, least(label, 2) label from a where m > 50), g as (select a.r, b.c from (select unnest(range((select z from n) + 1)) r) a, (select unnest(range(24)) c) b), e as (select g.* from g anti join k using (r, c)),
        o as (select r, c from e where r = 0 or r = (select z from n) or c = 0 or c = 23 union select e.r, e.c from o join e on abs(o.r - e.r) + abs(o.c - e.c) = 1),
        h as (select e.*, row_number() over (order by e.r, e.c) id from e anti join o using (r, c)),
        w as (select id a, id b from h union select w.a, y.id from w join h x on x.id = w.b join h y on abs(x.r - y.r) + abs(x.c - y.c) = 1), m as (select b id, min(a) comp from w group by 1),
        b as (select comp, min(label) lo, max(label) hi from h join m using (id) join k on abs(h.r - k.r) + abs(h.c - k.c) = 1 group by 1)
        select label, filled, count(*) cells from (select label, false filled from k union all select case when lo = hi then lo else 18 end label, true filled from h join m using (id) join b using (comp)) group by 1, 2""",
    "principal_yaw": f"select round(((degrees(atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2) % 180) + 180) % 180, 5) + 0.0 yaw_deg from {POINTS}",
    "circular_mean": f"""with a as (select label, avg(cos(4 * atan2(y, x))) c, avg(sin(4 * atan2(y, x))) s from {POINTS} group by 1) select label, round(((degrees(atan2(s, c)) / 4 % 90) + 90) % 90, 4) + 0.0 mean_deg, round(1 - sqrt(c * c + s * s), 6) + 0.0 dispersion from a""",
    "plane_fit": plane_sql(POINTS),
    "rigid_fit_2d": """with p as (select label, embedding[1]::double sx, embedding[2]::double sy, embedding[3]::double dx, embedding[4]::double dy from embeddings),
        t as (select label, atan2(covar_pop(sx, dy) - covar_pop(sy, dx), covar_pop(sx, dx) + covar_pop(sy, dy)) t, avg(sx) sx, avg(sy) sy, avg(dx) dx, avg(dy) dy from p group by 1)
        select label, round(degrees(t), 4) + 0.0 theta_deg, round(dx - cos(t) * sx + sin(t) * sy, 6) + 0.0 tx, round(dy - sin(t) * sx - cos(t) * sy, 6) + 0.0 ty from t""",
    "plane_attributes": """with p as (select plane_uid, normal[1] x, normal[2] y, normal[3] z, d from planes where normal is not null and d is not null),
        a as (select *, case when abs(x) >= abs(y) and abs(x) >= abs(z) then 0 when abs(y) >= abs(z) then 1 else 2 end axis from p), s as (select *, case when case axis when 0 then x when 1 then y else z end < 0 then -1.0::double else 1.0::double end f from a)
        select plane_uid, round(x * f, 6) + 0.0 cx, round(y * f, 6) + 0.0 cy, round(z * f, 6) + 0.0 cz, round(d * f, 6) + 0.0 cd, round(degrees(acos(greatest(-1.0::double, least(1.0::double, greatest(abs(x), abs(y), abs(z)))))), 4) + 0.0 tilt,
        axis, round((((degrees(atan2(x, y)) + 15) % 360) + 360) % 360, 4) + 0.0 bearing from s""",
    "top_k_similarity": """with e as (select vec_id, label, unnest(embedding)::double v, unnest(range(64)) i from embeddings), u as (select vec_id, label, i, v / sqrt(sum(v * v) over (partition by vec_id)) v from e),
        m as (select label, i, avg(v) m from u group by 1, 2), l as (select label, sqrt(sum(m * m)) n from m group by 1), s as (select m.label, u.vec_id, sum(u.v * m.m) / any_value(l.n) cosine from u join m using (i) join l on l.label = m.label group by 1, 2)
        select label, vec_id, round(cosine, 6) cosine, i as "rank" from (select *, row_number() over (partition by label order by round(cosine, 9) desc, vec_id) i from s) where i <= 5""",
    "nearest_fill": """with e as (select event_type f, cast(user_id % 30 as int) r, cast(hour(ts) as int) c, value, event_id from events), s as (select f, r, c, arg_min(value, event_id) v from e where (r + c) % 5 = 0 group by 1, 2, 3), q as (select distinct f, r, c from e),
        d as (select q.*, s.v, row_number() over (partition by q.f, q.r, q.c order by (q.r - s.r) ** 2 + (q.c - s.c) ** 2, s.r, s.c) i from q join s on q.f = s.f) select f as frame, r as "row", c as "col", v as "value" from d where i = 1""",
    "largest_rectangles": """with c as (select event_type f, cast(user_id % 24 as int) r, cast(hour(ts) as int) c from events group by 1, 2, 3 having avg(value) > 25),
        n as (select a.f, a.r r0, a.c c0, b.r r1, b.c c1, (b.r - a.r + 1) * (b.c - a.c + 1) area from c a join c b on a.f = b.f and b.r >= a.r and b.c >= a.c),
        k as (select n.f, r0, c0, r1, c1, area, count(*) n_ from n join c on c.f = n.f and c.r between r0 and r1 and c.c between c0 and c1 group by all)
        select f as event_type, max(area) area from k where n_ = area group by 1""",
}
