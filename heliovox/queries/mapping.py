"""Queries on many views of one scene, pairs and pictures in the plane, and planes of buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from heliovox.functions import classes, geometry as g, thermal
from heliovox.operators import building, graph, mapping, space, views
from heliovox.queries.base import EVENTS, POINTS, events, points
from heliovox.queries.spatial import PLANES, plane_sql
from heliovox.session import table

R = lambda c, n=6: (F.round(c, n) + F.lit(0.0)).alias(c.split(".")[-1])
REACH, CAMERA, IMAGE, BLOCK, VOXEL = 1.5, (400.0, 400.0, 320.0, 240.0), (640, 480), 20, 0.5
MATERIALS = [("view", 0.95), ("click", 0.9), ("purchase", 0.85), ("signup", 0.92)]


def _corners(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "planes").where("corners_3d is not null").select("plane_uid", F.posexplode("corners_3d").alias("corner", "c"))
    return p.select("plane_uid", "corner", *[F.get("c", F.lit(n)).alias(a) for n, a in enumerate("xyz")])


def _poses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posetum").select("pose_id", "session_id", F.col("tx").alias("px"), F.col("ty").alias("py"), F.col("tz").alias("pz"), "qx", "qy", "qz", "qw").dropna()


def points_in_range(spark: SparkSession, d: str) -> DataFrame:
    """How many poses come within reach of each corner of a plane, and the nearest one."""
    pairs = mapping.within_range(_corners(spark, d), _poses(spark, d), reach=REACH)
    out = pairs.groupBy("plane_uid", "corner").agg(F.count("*").alias("poses"), F.min(F.struct("distance", "pose_id")).alias("b"))
    return out.select("plane_uid", "corner", "poses", F.col("b.pose_id").alias("nearest_id"), R("b.distance"))


def raster_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Views with the kind and emissivity of what was last written to their pixel."""
    rows = events(spark, d).select("event_id", "event_type", (F.col("user_id") % 40).alias("row"), F.hour("ts").alias("col"))
    seen = mapping.looked_up(rows.where("event_type = 'view'").drop("event_type"), rows.where("event_type <> 'view'"), pixel=["row", "col"], order="event_id", payload=["event_type"])
    dim = spark.createDataFrame(MATERIALS, "event_type string, eps double")
    return seen.join(F.broadcast(dim), "event_type", "left").select("event_id", F.coalesce("event_type", F.lit("")).alias("material"), F.coalesce("eps", F.lit(-1.0)).alias("eps"))


def thermal_accumulation(spark: SparkSession, d: str) -> DataFrame:
    """The map of heat loss: corners of planes seen from poses, hidden ones left out, read off a thermal image, corrected and averaged per cell over all views."""
    pairs = mapping.within_range(_corners(spark, d), mapping.oriented(_poses(spark, d)), reach=REACH)
    seen = mapping.seen_pixels(pairs, CAMERA, IMAGE, BLOCK)
    front = space.z_buffer(seen, pixel=["pose_id", "row", "col"], depth="depth", tolerance=0.25)
    image = events(spark, d).select("event_id", (F.col("user_id") % 24).alias("row"), F.hour("ts").alias("col"), "event_type", "value")
    read = mapping.looked_up(front.select("pose_id", "row", "col", "x", "y", "z"), image, pixel=["row", "col"], order="event_id", payload=["event_type", "value"])
    dim = spark.createDataFrame(MATERIALS, "event_type string, eps double")
    read = read.join(F.broadcast(dim), "event_type")  # a vocabulary of materials
    apparent = F.col("value") / 10 + 10
    true = thermal.true_temperature(apparent, F.col("eps"), F.lit(0.95), F.lit(20.0), F.lit(22.0))
    cells = mapping.accumulated(read, VOXEL, value=true)
    u = thermal.u_value(F.col("mean"), F.lit(21.0), F.lit(5.0), F.lit(7.7))
    return cells.select("i", "j", "k", "n", R("mean", 4), R("std", 4), F.round(u, 4).alias("u"))


def revisit_closest(spark: SparkSession, d: str) -> DataFrame:
    """The 300 pairs of revisits that lie closest, of equally close ones those of the earliest poses."""
    from heliovox.queries.spatial import revisit_nearest

    best = revisit_nearest(spark, d).where("distance is not null")
    return best.orderBy("distance", "session_id", "at", "pose_id").limit(300).select("session_id", "pose_id", "earlier_id", "distance")


def pixel_association(spark: SparkSession, d: str) -> DataFrame:
    """The nearest click of each view, as places in a plane of user and value, within one and a half."""
    rows = events(spark, d).select("event_id", "event_type", F.col("user_id").cast("double").alias("u"), F.col("value").alias("v"))
    views, clicks = rows.where("event_type = 'view'"), rows.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("u").alias("cu"), F.col("v").alias("cv"))
    return mapping.nearest_in_plane(views, clicks, left_id="event_id", right_id="click_id", at=("u", "v"), other=("cu", "cv"), reach=1.5).select("event_id", "click_id", R("distance"))


def values_onto_occupied(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of errors in the cells that purchases occupy."""
    rows = events(spark, d).select("event_type", F.floor(F.col("user_id") / 3).alias("i"), F.hour("ts").alias("j"), "value")
    return mapping.onto_occupied(rows.where("event_type = 'error'"), rows.where("event_type = 'purchase'"), cell=["i", "j"], value="value").select("i", "j", R("mean"), "n")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    along = lambda n, f: f(F.transform("corners_3d", lambda c: c[n]))
    return table(spark, d, "planes").where("corners_3d is not null").select("plane_uid", along(0, F.array_min).alias("u0"), along(0, F.array_max).alias("u1"), along(1, F.array_min).alias("v0"), along(1, F.array_max).alias("v1"))


def region_stats(spark: SparkSession, d: str) -> DataFrame:
    """Poses within the bounds of each plane, seen from above."""
    p = table(spark, d, "posetum").select(F.col("tx").alias("x"), F.col("ty").alias("y")).dropna()
    out = mapping.region_stats(p, _boxes(spark, d), region_id="plane_uid", size=2.0)
    return out.select("plane_uid", "n", F.coalesce(F.round("mean_x", 6), F.lit(-999.0)).alias("mean_x"), F.coalesce(F.round("mean_y", 6), F.lit(-999.0)).alias("mean_y"))


def ordinal_zip(spark: SparkSession, d: str) -> DataFrame:
    """Frames and clouds of a session paired by place in order of time: how many, and how far apart at most and on average."""
    frames = table(spark, d, "zed_frames").where("zed_epoch is not null").select("session_id", "frame_id", "zed_epoch")
    clouds = table(spark, d, "lidar_clouds").where("cloud_epoch is not null").select("session_id", "cloud_id", "cloud_epoch")
    both = mapping.zipped(frames, clouds, by="session_id", left_order=["zed_epoch", "frame_id"], right_order=["cloud_epoch", "cloud_id"])
    gap = F.abs(F.col("cloud_epoch") - F.col("zed_epoch"))
    return both.groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.max(gap), 3).alias("most_s"), F.round(F.avg(gap), 3).alias("mean_s"))


def _walls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "planes").where("normal is not null and centroid_3d is not null").select("series_id", "plane_uid", *[F.get("normal", F.lit(n)).alias("n" + a) for n, a in enumerate("xyz")], *[F.get("centroid_3d", F.lit(n)).alias(a) for n, a in enumerate("xyz")])
    return p


def facing_walls(spark: SparkSession, d: str) -> DataFrame:
    """Walls of a series that face each other and are each other's nearest such wall."""
    return mapping.facing_walls(_walls(spark, d).where("abs(nz) < 0.5"), by="series_id", wall_id="plane_uid", degrees=10.0, least_gap=0.5).select("series_id", "plane_uid", "other_id", R("gap"))


def merged_plane_ids(spark: SparkSession, d: str) -> DataFrame:
    """The planes of both tables in one, numbered anew within their series."""
    parts = [table(spark, d, name).select("series_id", "plane_uid", F.lit(name).alias("family"), F.col("id").alias("old_id")) for name in ("planes", "planes_notilt")]
    both = parts[0].unionByName(parts[1])
    return both.withColumn("new_id", F.row_number().over(Window.partitionBy("series_id").orderBy("family", "old_id", "plane_uid")) - 1)


def _picture(spark: SparkSession, d: str) -> DataFrame:
    """Pixels (user, hour) whose mean value is above 50."""
    cells = events(spark, d).groupBy((F.col("user_id") % 48).alias("row"), F.hour("ts").cast("bigint").alias("col")).agg(F.avg("value").alias("m"))
    return cells.where("m > 50").select("row", "col")


def small_components_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the parts of a picture that are at least three pixels wide or high."""
    return graph.without_small(_picture(spark, d), ["row", "col"], least_side=3, corners=False)


def plane_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Normals turned outward from the series' centre, bounds of the corners, and centroids moved half way to their plane."""
    p = table(spark, d, "planes").where("normal is not null and d is not null and centroid_3d is not null and corners_3d is not null")
    three = lambda c, to: [F.get(c, F.lit(n)).alias(to + a) for n, a in enumerate("xyz")]
    p = p.select("series_id", "plane_uid", "d", "corners_3d", *three("normal", "n"), *three("centroid_3d", "c"))
    middle = p.groupBy("series_id").agg(*[F.avg("c" + a).alias("m" + a) for a in "xyz"])
    p = p.join(middle, "series_id")
    n, c, m = ([F.col(s + a) for a in "xyz"] for s in "ncm")
    out, moved, bounds = g.outward(n, c, m), g.snapped(c, n, F.col("d"), 0.5), g.face_bounds(F.col("corners_3d"))
    named = [x.alias(f"{s}{a}") for s, xs in (("out_", out), ("at_", moved)) for a, x in zip("xyz", xs)] + [x.alias(f"{e}_{a}") for x, (a, e) in zip(bounds, [(a, e) for a in "xyz" for e in ("lo", "hi")])]
    kept = p.select("plane_uid", *named)
    return kept.select("plane_uid", *[R(c, 5) for c in kept.columns[1:]])


def pixel_bearings(spark: SparkSession, d: str) -> DataFrame:
    """Directions of pixels, by a camera calibrated at twice the size."""
    k = g.rescaled((1040.0, 1030.0, 640.0, 480.0), (1280, 960), (640, 480))
    rows = events(spark, d).select("event_id", F.col("user_id").cast("double").alias("u"), F.col("value").alias("v"))
    b = g.pixel_bearing(F.col("u"), F.col("v"), k)
    return rows.select("event_id", *[x.alias("to_" + a) for a, x in zip("xyz", b)]).select("event_id", R("to_x"), R("to_y"), R("to_z"))


def rotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Corners of each wide plane's box, turned as the plane is, and how many poses of all stand in it."""
    p = table(spark, d, "planes").where("centroid_3d is not null and width_m is not null and height_m is not null and angle_deg is not null")
    p = p.select("plane_uid", F.get("centroid_3d", F.lit(0)).alias("cx"), F.get("centroid_3d", F.lit(1)).alias("cy"), F.col("width_m").alias("w"), F.col("height_m").alias("h"), F.col("angle_deg").alias("a"))
    corners = g.box_corners(*[F.col(c) for c in ("cx", "cy", "w", "h", "a")])
    poses = table(spark, d, "posetum").select(F.col("tx").alias("x"), F.col("ty").alias("y"))
    n = mapping.counted_in_boxes(p, poses, by="plane_uid", size=4.0).withColumnRenamed("n", "poses")
    out = p.join(n, "plane_uid", "left").withColumn("k", corners)
    return out.select("plane_uid", F.coalesce("poses", F.lit(0)).alias("poses"), *[(F.round(F.get(F.get("k", F.lit(i)), F.lit(j)), 5) + F.lit(0.0)).alias(f"{a}{i}") for i in range(4) for j, a in enumerate("xy")])


def footprint_filter(spark: SparkSession, d: str) -> DataFrame:
    """Poses within half a metre of the bounds of the floors."""
    floors = table(spark, d, "planes").where("lower(orientation) like 'floor%' and corners_3d is not null").select(F.explode("corners_3d").alias("c"))
    x, y = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    bounds = F.broadcast(floors.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")))  # one row
    return table(spark, d, "posetum").join(bounds, F.col("tx").between(F.col("x0") - 0.5, F.col("x1") + 0.5) & F.col("ty").between(F.col("y0") - 0.5, F.col("y1") + 0.5)).select("pose_id")


def manifest_resync(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's rows whose frame still exists, counted again per session."""
    frames = table(spark, d, "zed_frames").select("session_id", "zed_file").distinct()
    rows = table(spark, d, "lidar_depth_assoc_manifest").select("session_id", "zed_file", "row_id")
    kept = rows.join(frames, ["session_id", "zed_file"], "left_semi").groupBy("session_id").agg(F.count("*").alias("kept"))
    return rows.groupBy("session_id").agg(F.count("*").alias("listed")).join(kept, "session_id", "left").select("session_id", "listed", F.coalesce("kept", F.lit(0)).alias("kept"))


def filter_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Region of interest, thin cells out, then one row per cell, in this order."""
    inside = points(spark, d).where("abs(x) <= 0.25 and abs(y) <= 0.25 and abs(z) <= 0.25")
    return space.filtered(inside, outliers=(0.1, 1.0), declutter=None, voxel=0.05).select("i", "j", "k", "n", *[R(a) for a in "xyz"])


def frame_difference(spark: SparkSession, d: str) -> DataFrame:
    """Days as pictures of users' mean values: how much each differs from the one before."""
    frames = events(spark, d).groupBy(F.expr("us div 86400000000").alias("day"), "user_id").agg(F.avg("value").alias("value"))
    return mapping.frame_difference(frames, frame="day", pixel=["user_id"], value="value").select("day", R("difference", 5), "pixels")


def fold_stability(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_type", "event_id", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    return mapping.fold_stability(rows, by="event_type", order=["event_id"], x="x", y="y", folds=5).select("event_type", R("mean_slope", 7), R("std_slope", 7))


def plane_support(spark: SparkSession, d: str) -> DataFrame:
    """Points assigned to each plane, and the spread of their distances."""
    planes = spark.createDataFrame(PLANES, "plane_id int, nx double, ny double, nz double, d double")
    own = space.nearest_plane(points(spark, d), planes, point_id="vec_id", threshold=0.1).where("plane_id >= 0")
    met = points(spark, d).join(own, "vec_id").join(F.broadcast(planes), "plane_id")  # four planes
    gap = g.plane_distance([F.col(c) for c in ("nx", "ny", "nz")], F.col("d"), [F.col(a) for a in "xyz"])
    return met.groupBy("plane_id").agg(F.count("*").alias("n"), F.round(F.stddev_samp(gap), 6).alias("spread"))


def nearest_minute(spark: SparkSession, d: str) -> DataFrame:
    """Per user and kind the event whose minute of the day is nearest to noon, of equally near ones the first by id."""
    far = F.abs(F.hour("ts") * 60 + F.minute("ts") - 720)
    return events(spark, d).groupBy("user_id", "event_type").agg(F.min(F.struct(far.alias("far"), "event_id")).alias("b")).select("user_id", "event_type", "b.event_id", "b.far")


def mixed_order(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a session in order of time, those without one behind, by the number in their name, then by name and id."""
    number = F.regexp_extract("zed_file", r"(\d+)", 1).try_cast("bigint")
    key = [F.col("zed_epoch").isNull().cast("int"), F.coalesce("zed_epoch", number.cast("double")), F.col("zed_file"), F.col("frame_id")]
    return table(spark, d, "zed_frames").withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*key))).select("session_id", "frame_id", "place")


def level_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal planes of a series as floor, roof or level between, by the extremes of height."""
    flat = _walls(spark, d).where("abs(nz) > 0.9")
    ends = flat.groupBy("series_id").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    kind = F.when(F.col("z") - F.col("low") <= 0.3, "floor").when(F.col("high") - F.col("z") <= 0.3, "roof").otherwise("level")
    return flat.join(ends, "series_id").select("series_id", "plane_uid", kind.alias("kind"))


def count_windows(spark: SparkSession, d: str) -> DataFrame:
    """Points of every ten clouds of a session in succession."""
    clouds = table(spark, d, "lidar_clouds").where("n_points is not null")
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("cloud_epoch", "cloud_id")) - 1
    return clouds.withColumn("window", F.floor(turn / 10)).groupBy("session_id", "window").agg(F.count("*").alias("clouds"), F.sum("n_points").alias("points"))


def window_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each kind of event in windows of six hours from its first, borders included."""
    e = events(spark, d).select("event_type", "us")
    first = e.groupBy("event_type").agg(F.min("us").alias("t0"))
    span = 21_600_000_000
    # An event on the border of two windows is in both.
    windows = F.expr(f"if(at > 0 and at % {span} = 0, array(at div {span} - 1, at div {span}), array(at div {span}))")
    w = e.join(first, "event_type").withColumn("at", F.col("us") - F.col("t0")).withColumn("w", F.explode(windows))
    hz = F.try_divide(F.count("*") - 1, (F.max("at") - F.min("at")) / 1e6)
    return w.groupBy("event_type", "w").agg(F.count("*").alias("n"), F.coalesce(F.round(hz, 6), F.lit(-1.0)).alias("hz"))


def rest_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a user's events below 60 that last at least a day."""
    from heliovox.operators import series

    runs = series.runs(events(spark, d), by=["user_id"], order="us", flag=F.col("value") > 60).where("not flag")
    return runs.withColumn("lasts_s", (F.col("last") - F.col("first")) / 1e6).where("lasts_s >= 86400").select("user_id", "first", "last", "length", F.round("lasts_s", 3).alias("lasts_s"))


def glazing(spark: SparkSession, d: str) -> DataFrame:
    """Panes in walls of users by hours: bright pixels are glass, dark ones opaque."""
    cells = events(spark, d).groupBy(F.floor(F.col("user_id") / 30).alias("wall"), (F.col("user_id") % 30).alias("row"), F.hour("ts").alias("col")).agg(F.avg("value").alias("m"))
    panes = views.glazing(cells, by="wall", glass=F.col("m") > 75, opaque=F.col("m") < 40, grow=2, gates={"cells": (4, 400), "width": (2, 24), "filled": (0.3, 1.0)})
    return panes.select("wall", "cells", "r0", "c0", "r1", "c1", R("filled"))


def model_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces of a building model: kind, boundary, and corners in the turn that makes their normal point outward."""
    p = table(spark, d, "planes").where("normal is not null and centroid_3d is not null and corners_3d is not null")
    three = lambda c, to: [F.get(c, F.lit(n)).alias(to + a) for n, a in enumerate("xyz")]
    p = p.select("series_id", "plane_uid", "corners_3d", *three("normal", "n"), *three("centroid_3d", "c"))
    middle = p.groupBy("series_id").agg(*[F.avg("c" + a).alias("m" + a) for a in "xyz"])
    out = building.model_surfaces(p.join(middle, "series_id"), corners="corners_3d", normal=("nx", "ny", "nz"), centre=("cx", "cy", "cz"), interior=("mx", "my", "mz"))
    return out.select("plane_uid", "surface_type", "boundary", "turned", *[(F.round(F.get(F.get("polygon", F.lit(k)), F.lit(n)), 5) + F.lit(0.0)).alias(f"{a}{k}") for k in (0, 1) for n, a in enumerate("xyz")])


def map_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as scans in the axes of each session's pose of that number, as one map of means per session."""
    scans = events(spark, d).select(F.col("user_id").cast("int").alias("at"), (F.col("value") / 51.3).alias("x"), ((F.hour("ts") + 1) / 10.7).alias("y"), ((F.col("event_id") % 7 + 1) / 9.1).alias("z"))
    poses = table(spark, d, "posetum").select("session_id", F.col("posetum_row_idx").alias("at"), "pose_id", *[F.col("t" + a).alias("p" + a) for a in "xyz"], "qx", "qy", "qz", "qw").dropna()
    first = poses.groupBy("session_id", "at").agg(F.min_by(F.struct("px", "py", "pz", "qx", "qy", "qz", "qw"), "pose_id").alias("p")).select("session_id", "at", "p.*")
    out = mapping.rebuilt(scans, mapping.oriented(first), on=["at"], size=1.0, by=["session_id"])
    return out.select("session_id", "i", "j", "k", "n", *[R(a, 8) for a in "xyz"])


def slab_planes(spark: SparkSession, d: str) -> DataFrame:
    """The plane through the highest points of each class."""
    return building.slab(points(spark, d), by="label", axis="z", band=0.2, upper=True).select("label", "n", *[R(c, 5) for c in ("nx", "ny", "nz", "d")])


def box_refit(spark: SparkSession, d: str) -> DataFrame:
    out = building.box_of_cells(points(spark, d), by="label", size=0.05, share=0.05)
    return out.select("label", "cells", *[R(f"{e}_{a}", 5) for a in "xyz" for e in ("lo", "hi")])


def axis_raster(spark: SparkSession, d: str) -> DataFrame:
    """Points of each class on the grid across the axis of their plane, parts of a single cell left out."""
    return building.axis_raster(points(spark, d), by="label", size=0.04, least_side=2)


def smoothed_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces of the classes as rectangles."""
    return building.smoothed(points(spark, d), by="label", size=0.05, band=0.2)


def largest_holes(spark: SparkSession, d: str) -> DataFrame:
    """The two largest holes of the wall, of equally large ones the first."""
    from heliovox.queries.buildings import wall_holes

    return wall_holes(spark, d).orderBy(F.desc("cells"), "r0", "c0").limit(2)


def skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Branches of the skeletons of bright parts in pictures of users by hours, one per kind of event."""
    cells = events(spark, d).groupBy("event_type", (F.col("user_id") % 48).cast("int").alias("row"), F.hour("ts").cast("int").alias("col")).agg(F.avg("value").alias("m"))
    return graph.skeletons(cells.where("m > 50"), by="event_type", least_spur=2)


def class_roles(spark: SparkSession, d: str) -> DataFrame:
    """Names and roles of the classes of points, numbers beyond the last among them."""
    rows = points(spark, d).select((F.col("label") * 3 - 2).alias("number"))
    return rows.groupBy("number", classes.name(F.col("number")).alias("name"), classes.role(F.col("number")).alias("role")).agg(F.count("*").alias("n"))


def pose_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the steps between poses of a session: less where heights are free, as the upper triangle of a matrix."""
    p = table(spark, d, "posetum").where("tz is not null")
    w = F.round(1.0 / (1.0 + F.abs("tz")), 6)
    v = classes.information([F.lit(0.1), F.lit(0.1), w, w, w, F.lit(0.1)])
    return p.select("pose_id", v.alias("v")).select("pose_id", F.size("v").alias("n"), *[F.get("v", F.lit(k)).alias(f"v{k}") for k in (0, 1, 6, 11, 15, 18, 20)])


QUERIES = {
    f.__name__: f
    for f in (
        points_in_range, raster_lookup, thermal_accumulation, revisit_closest, pixel_association, values_onto_occupied, region_stats, ordinal_zip, facing_walls, merged_plane_ids, small_components_dropped, plane_geometry,
        pixel_bearings, rotated_boxes, footprint_filter, manifest_resync, filter_pipeline, frame_difference, fold_stability, plane_support, nearest_minute, mixed_order, level_kinds, count_windows, window_rates, rest_intervals, glazing, model_surfaces, map_rebuild, slab_planes, box_refit,
        axis_raster, smoothed_surfaces, skeletons, largest_holes, class_roles, pose_weights,
    )
}

_V = lambda rows: ", ".join("(" + ", ".join(f"{v!r}::double" if isinstance(v, float) else repr(v) for v in r) + ")" for r in rows)
_CORNERS = "(select plane_uid, k as corner, c[1] x, c[2] y, c[3] z from (select plane_uid, unnest(range(len(corners_3d))) k, unnest(corners_3d) c from planes where corners_3d is not null))"
_POSES = "(select pose_id, session_id, tx px, ty py, tz pz, qx, qy, qz, qw from posetum where pose_id is not null and session_id is not null and tx is not null and ty is not null and tz is not null and qx is not null and qy is not null and qz is not null and qw is not null)"
_PAIRS = f"""p as (select *, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) distance from {_CORNERS} c join {_POSES} q on abs(x - px) <= 1.6::double and abs(y - py) <= 1.6::double and abs(z - pz) <= 1.6::double
    where sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) <= {REACH}::double)"""
_TRUE = "power((power(a + 273.15::double, 4) - (1 - eps) * 0.95::double * power(20.0::double + 273.15::double, 4) - (1 - 0.95::double) * power(22.0::double + 273.15::double, 4)) / (eps * 0.95::double), 0.25::double) - 273.15::double"
_WALLS = "(select series_id, plane_uid, normal[1] nx, normal[2] ny, normal[3] nz, centroid_3d[1] x, centroid_3d[2] y, centroid_3d[3] z from planes where normal is not null and centroid_3d is not null)"
_FACING = "g as (select a.series_id, a.plane_uid, b.plane_uid other_id, abs(a.nx * (b.x - a.x) + a.ny * (b.y - a.y) + a.nz * (b.z - a.z)) gap from w a join w b on a.series_id = b.series_id and a.plane_uid < b.plane_uid where abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) >= cos(radians(10.0::double)))"
_REVISIT = """q as (select session_id, pose_id, posetum_row_idx at_, tx, ty from posetum where session_id is not null and pose_id is not null and posetum_row_idx is not null and tx is not null and ty is not null),
    r as (select a.session_id, a.pose_id, a.at_, b.pose_id earlier_id, b.at_ earlier_at, sqrt((a.tx - b.tx) * (a.tx - b.tx) + (a.ty - b.ty) * (a.ty - b.ty)) distance
      from q a join q b on a.session_id = b.session_id and b.at_ + 100 <= a.at_ and abs(a.tx - b.tx) <= 0.5 and abs(a.ty - b.ty) <= 0.5),
    n as (select *, row_number() over (partition by session_id, pose_id, at_ order by distance, earlier_at, earlier_id) i from r where distance <= 0.5)"""
REVISIT_NEAREST = f'with {_REVISIT} select session_id, pose_id, at_ as "at", earlier_id, earlier_at, round(distance, 9) distance from n where i = 1'
_BOX = "(select plane_uid, centroid_3d[1] cx, centroid_3d[2] cy, width_m w, height_m h, angle_deg a from planes where centroid_3d is not null and width_m is not null and height_m is not null and angle_deg is not null)"
_CORNER = lambda i, a, s, t: f"round(c{a} + {'cos' if a == 'x' else 'sin'}(radians(a)) * w * {s} {'-' if a == 'x' else '+'} {'sin' if a == 'x' else 'cos'}(radians(a)) * h * {t}, 5) + 0.0 {a}{i}"
_SIGNS = [("-0.5::double", "-0.5::double"), ("0.5::double", "-0.5::double"), ("0.5::double", "0.5::double"), ("-0.5::double", "0.5::double")]

SQL = {
    "revisit_nearest": REVISIT_NEAREST,
    "points_in_range": f"""with {_PAIRS}, r as (select *, row_number() over (partition by plane_uid, corner order by distance, pose_id) i, count(*) over (partition by plane_uid, corner) poses from p)
        select plane_uid, corner, poses, pose_id nearest_id, round(distance, 6) + 0.0 distance from r where i = 1""",
    "raster_lookup": f"""with e as (select event_id, event_type, user_id % 40 r, hour(ts) c from events), w as (select r, c, arg_max(event_type, event_id) m from e where event_type <> 'view' group by 1, 2)
        select event_id, coalesce(m, '') material, coalesce(eps, -1.0::double) eps from (select * from e where event_type = 'view') left join w using (r, c) left join (values {_V(MATERIALS)}) k(m, eps) using (m)""",
    "thermal_accumulation": f"""with {_PAIRS}, s as (select *, 2.0::double / (qx * qx + qy * qy + qz * qz + qw * qw) s, x - px dx, y - py dy, z - pz dz from p),
        l as (select *, (1 - s * (qy * qy + qz * qz)) * dx + s * (qx * qy + qz * qw) * dy + s * (qx * qz - qy * qw) * dz ahead, s * (qx * qy - qz * qw) * dx + (1 - s * (qx * qx + qz * qz)) * dy + s * (qy * qz + qx * qw) * dz lft,
          s * (qx * qz + qy * qw) * dx + s * (qy * qz - qx * qw) * dy + (1 - s * (qx * qx + qy * qy)) * dz up from s),
        v as (select *, {CAMERA[0]}::double * (-lft / ahead) + {CAMERA[2]}::double u, {CAMERA[1]}::double * (-up / ahead) + {CAMERA[3]}::double v from l where ahead <> 0),
        n as (select *, cast(floor(v / {BLOCK}) as bigint) r, cast(floor(u / {BLOCK}) as bigint) c from v where ahead > 0 and u >= 0 and u < {IMAGE[0]} and v >= 0 and v < {IMAGE[1]}),
        f as (select * from (select *, min(ahead) over (partition by pose_id, r, c) least_ from n) where ahead <= least_ + 0.25::double),
        m as (select user_id % 24 r, hour(ts) c, arg_max(event_type, event_id) kind, arg_max(value, event_id) val from events group by 1, 2),
        t as (select x, y, z, val / 10 + 10 a, eps from f join m using (r, c) join (values {_V(MATERIALS)}) k(kind, eps) using (kind)), w as (select x, y, z, {_TRUE} t from t),
        o as (select cast(floor(x / {VOXEL}::double) as bigint) i, cast(floor(y / {VOXEL}::double) as bigint) j, cast(floor(z / {VOXEL}::double) as bigint) k, count(t) n, avg(t) mean, stddev_pop(t) std from w group by 1, 2, 3)
        select i, j, k, n, round(mean, 4) + 0.0 mean, round(std, 4) + 0.0 std, round(7.7::double * (21.0::double - mean) / 16.0::double, 4) u from o""",
    "revisit_closest": f"with {_REVISIT} select session_id, pose_id, earlier_id, round(distance, 9) distance from n where i = 1 order by round(distance, 9), session_id, at_, pose_id limit 300",
    "pixel_association": """with v as (select event_id, user_id::double u, value v from events where event_type = 'view'), c as (select event_id click_id, user_id::double u, value v from events where event_type = 'click'),
        p as (select v.event_id, click_id, sqrt((v.u - c.u) * (v.u - c.u) + (v.v - c.v) * (v.v - c.v)) g from v join c on abs(v.u - c.u) <= 1.5 and abs(v.v - c.v) <= 1.5)
        select event_id, click_id, round(g, 6) + 0.0 distance from (select *, row_number() over (partition by event_id order by g, click_id) i from p where g <= 1.5) where i = 1""",
    "values_onto_occupied": """with e as (select event_type, cast(floor(user_id / 3.0) as bigint) i, hour(ts) j, value from events), o as (select distinct i, j from e where event_type = 'purchase')
        select i, j, round(avg(value), 6) + 0.0 mean, count(value) n from e semi join o using (i, j) where event_type = 'error' group by 1, 2""",
    "region_stats": """with b as (select plane_uid, list_min(list_transform(corners_3d, lambda c: c[1])) u0, list_max(list_transform(corners_3d, lambda c: c[1])) u1, list_min(list_transform(corners_3d, lambda c: c[2])) v0,
        list_max(list_transform(corners_3d, lambda c: c[2])) v1 from planes where corners_3d is not null)
        select plane_uid, count(tx) n, coalesce(round(avg(tx), 6), -999.0) mean_x, coalesce(round(avg(ty), 6), -999.0) mean_y from b left join (select tx, ty from posetum where tx is not null and ty is not null) on tx between u0 and u1 and ty between v0 and v1 group by 1""",
    "ordinal_zip": """with f as (select session_id, zed_epoch, row_number() over (partition by session_id order by zed_epoch, frame_id) o from zed_frames where zed_epoch is not null),
        c as (select session_id, cloud_epoch, row_number() over (partition by session_id order by cloud_epoch, cloud_id) o from lidar_clouds where cloud_epoch is not null)
        select session_id, count(*) n, round(max(abs(cloud_epoch - zed_epoch)), 3) most_s, round(avg(abs(cloud_epoch - zed_epoch)), 3) mean_s from f join c using (session_id, o) group by 1""",
    "facing_walls": f"""with w as (select * from {_WALLS} where abs(nz) < 0.5), {_FACING}, b as (select series_id, plane_uid, other_id, gap from g where gap >= 0.5 union all select series_id, other_id, plane_uid, gap from g where gap >= 0.5),
        n as (select * from (select *, row_number() over (partition by series_id, plane_uid order by gap, other_id) i from b) where i = 1)
        select a.series_id, a.plane_uid, a.other_id, round(a.gap, 6) + 0.0 gap from n a join n b on a.series_id = b.series_id and a.plane_uid = b.other_id and a.other_id = b.plane_uid where a.plane_uid < a.other_id""",
    "merged_plane_ids": """with b as (select series_id, plane_uid, 'planes' family, id old_id from planes union all select series_id, plane_uid, 'planes_notilt', id from planes_notilt)
        select *, row_number() over (partition by series_id order by family, old_id nulls first, plane_uid) - 1 new_id from b""",
    "small_components_dropped": """with recursive q as (select r, c, row_number() over (order by r, c) id from (select user_id % 48 r, hour(ts) c from events group by 1, 2 having avg(value) > 50)),
        w as (select id a, id b from q union select w.a, y.id from w join q x on x.id = w.b join q y on abs(x.r - y.r) + abs(x.c - y.c) = 1), m as (select b id, min(a) n from w group by 1),
        k as (select n from q join m using (id) group by 1 having greatest(max(r) - min(r), max(c) - min(c)) + 1 >= 3) select r as "row", c as "col" from q join m using (id) semi join k using (n)""",
    "plane_geometry": """with p as (select series_id, plane_uid, d, corners_3d k, normal[1] nx, normal[2] ny, normal[3] nz, centroid_3d[1] cx, centroid_3d[2] cy, centroid_3d[3] cz from planes where normal is not null and d is not null and centroid_3d is not null and corners_3d is not null),
        q as (select *, avg(cx) over (partition by series_id) mx, avg(cy) over (partition by series_id) my, avg(cz) over (partition by series_id) mz from p),
        s as (select *, case when nx * (cx - mx) + ny * (cy - my) + nz * (cz - mz) < 0 then -1.0::double else 1.0::double end f, nx * cx + ny * cy + nz * cz + d g from q)
        select plane_uid, round(nx * f, 5) + 0.0 out_x, round(ny * f, 5) + 0.0 out_y, round(nz * f, 5) + 0.0 out_z, round(cx - 0.5::double * g * nx, 5) + 0.0 at_x, round(cy - 0.5::double * g * ny, 5) + 0.0 at_y, round(cz - 0.5::double * g * nz, 5) + 0.0 at_z,
        """ + ", ".join(f"round(list_{f}(list_transform(k, lambda c: c[{n}])), 5) + 0.0 {e}_{a}" for n, a in enumerate("xyz", 1) for f, e in (("min", "lo"), ("max", "hi"))) + " from s",
    "pixel_bearings": """with b as (select event_id, (user_id::double - 320.0::double) / 520.0::double x, (value - 240.0::double) / 515.0::double y from events), n as (select *, sqrt(x * x + y * y + 1.0::double) n from b)
        select event_id, round(x / n, 6) + 0.0 to_x, round(y / n, 6) + 0.0 to_y, round(1.0::double / n, 6) + 0.0 to_z from n""",
    "rotated_boxes": f"""with p as {_BOX}, n as (select plane_uid, count(*) poses from p join (select tx, ty from posetum where tx is not null and ty is not null) on w > 0 and h > 0
        and abs((tx - cx) * cos(radians(a)) + (ty - cy) * sin(radians(a))) <= w / 2 and abs((ty - cy) * cos(radians(a)) - (tx - cx) * sin(radians(a))) <= h / 2 group by 1)
        select plane_uid, coalesce(poses, 0) poses, {", ".join(_CORNER(i, a, s, t) for i, (s, t) in enumerate(_SIGNS) for a in "xy")} from p left join n using (plane_uid)""",
    "footprint_filter": """with c as (select unnest(corners_3d) c from planes where lower(orientation) like 'floor%' and corners_3d is not null), b as (select min(c[1]) x0, max(c[1]) x1, min(c[2]) y0, max(c[2]) y1 from c)
        select pose_id from posetum, b where tx between x0 - 0.5 and x1 + 0.5 and ty between y0 - 0.5 and y1 + 0.5""",
    "manifest_resync": """with f as (select distinct session_id, zed_file, 1 hit from zed_frames) select session_id, count(*) listed, count(hit) kept from lidar_depth_assoc_manifest left join f using (session_id, zed_file) group by 1""",
    "filter_pipeline": f"""with i as (select * from {POINTS} where abs(x) <= 0.25 and abs(y) <= 0.25 and abs(z) <= 0.25), c as (select *, count(*) over (partition by floor(x / 0.1), floor(y / 0.1), floor(z / 0.1)) n from i),
        k as (select * exclude (n) from c where n >= greatest(2, (select avg(n) - stddev_pop(n) from c)))
        select cast(floor(x / 0.05) as bigint) i, cast(floor(y / 0.05) as bigint) j, cast(floor(z / 0.05) as bigint) k, count(*) n, round(avg(x), 6) + 0.0 x, round(avg(y), 6) + 0.0 y, round(avg(z), 6) + 0.0 z from k group by 1, 2, 3""",
    "frame_difference": f"""with f as (select us // 86400000000 d, user_id, avg(value) v from {EVENTS} group by 1, 2) select a.d as "day", round(avg(abs(a.v - b.v)), 5) + 0.0 difference, count(*) pixels from f a join f b on a.d = b.d + 1 and a.user_id = b.user_id group by 1""",
    "fold_stability": """with e as (select event_type, user_id::double x, value y, ntile(5) over (partition by event_type order by event_id) f from events), k as (select unnest(range(1, 6)) k),
        s as (select event_type, k, regr_slope(y, x) s from e, k where f <> k group by 1, 2) select event_type, round(avg(s), 7) + 0.0 mean_slope, round(stddev_pop(s), 7) + 0.0 std_slope from s group by 1""",
    "plane_support": f"""with p as (select * from (values {_V(PLANES)}) p(plane_id, nx, ny, nz, d)), q as (select vec_id, plane_id, abs(x * nx + y * ny + z * nz + d) / sqrt(nx * nx + ny * ny + nz * nz) g from {POINTS}, p),
        b as (select *, row_number() over (partition by vec_id order by g, plane_id) i from q) select plane_id, count(*) n, round(stddev_samp(g), 6) spread from b where i = 1 and g <= 0.1 group by 1""",
    "nearest_minute": """with e as (select *, abs(hour(ts) * 60 + minute(ts) - 720) far from events) select user_id, event_type, event_id, cast(far as int) far from (select *, row_number() over (partition by user_id, event_type order by far, event_id) i from e) where i = 1""",
    "mixed_order": """select session_id, frame_id, cast(row_number() over (partition by session_id order by (zed_epoch is null)::int, coalesce(zed_epoch, try_cast(regexp_extract(zed_file, '(\\d+)', 1) as bigint)::double) nulls first, zed_file nulls first, frame_id) as int) place from zed_frames""",
    "level_kinds": f"""with f as (select *, min(z) over (partition by series_id) low, max(z) over (partition by series_id) high from {_WALLS} where abs(nz) > 0.9)
        select series_id, plane_uid, case when z - low <= 0.3 then 'floor' when high - z <= 0.3 then 'roof' else 'level' end kind from f""",
    "count_windows": """with c as (select *, (row_number() over (partition by session_id order by cloud_epoch nulls first, cloud_id) - 1) // 10 w from lidar_clouds where n_points is not null)
        select session_id, w as "window", count(*) clouds, cast(sum(n_points) as bigint) points from c group by 1, 2""",
    "window_rates": f"""with e as (select event_type, (us - min(us) over (partition by event_type)) at_ from {EVENTS}), w as (select event_type, at_, unnest(case when at_ > 0 and at_ % 21600000000 = 0 then [at_ // 21600000000 - 1, at_ // 21600000000] else [at_ // 21600000000] end) w from e)
        select event_type, w, count(*) n, coalesce(round((count(*) - 1) / nullif((max(at_) - min(at_)) / 1e6, 0), 6), -1.0) hz from w group by 1, 2""",
    "glazing": """with recursive a as (select cast(floor(user_id / 30.0) as bigint) w, user_id % 30 r, hour(ts) c, avg(value) m from events group by 1, 2, 3), s as (select w, r, c from a where m > 75), o as (select w, r, c from a where m < 40),
        d as (select w, c, r f, unnest(range(r - 2, r + 1)) r from s), t as (select w, c, f, max(r) stop from d join o using (w, r, c) group by 1, 2, 3), g as (select distinct w, r, c from d left join t using (w, c, f) where stop is null or r > stop),
        n as (select a.x dr, b.x dc from (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(x)), e as (select distinct w, r + dr r, c + dc c from g, n), q0 as (select w, r + dr r, c + dc c from e, n group by 1, 2, 3 having count(*) = 9),
        q as (select *, row_number() over (order by w, r, c) id from q0 anti join o using (w, r, c)),
        x as (select id a, id b from q union select x.a, z.id from x join q y on y.id = x.b join q z on y.w = z.w and abs(y.r - z.r) <= 1 and abs(y.c - z.c) <= 1), k as (select b id, min(a) n from x group by 1),
        p as (select w, n, count(*) cells, min(r) r0, min(c) c0, max(r) r1, max(c) c1 from q join k using (id) group by 1, 2)
        select w as wall, cells, r0, c0, r1, c1, round(cells / ((c1 - c0 + 1) * (r1 - r0 + 1)), 6) + 0.0 filled from p where cells between 4 and 400 and c1 - c0 + 1 between 2 and 24 and cells / ((c1 - c0 + 1) * (r1 - r0 + 1)) >= 0.3""",
    "model_surfaces": """with p as (select series_id, plane_uid, corners_3d k, normal[1] nx, normal[2] ny, normal[3] nz, centroid_3d[1] cx, centroid_3d[2] cy, centroid_3d[3] cz from planes where normal is not null and centroid_3d is not null and corners_3d is not null),
        q as (select *, avg(cx) over (partition by series_id) mx, avg(cy) over (partition by series_id) my, avg(cz) over (partition by series_id) mz,
          k[2][1] - k[1][1] ax, k[2][2] - k[1][2] ay, k[2][3] - k[1][3] az, k[3][1] - k[1][1] bx, k[3][2] - k[1][2] b_y, k[3][3] - k[1][3] bz from p),
        s as (select *, case when nx * (cx - mx) + ny * (cy - my) + nz * (cz - mz) < 0 then -1.0::double else 1.0::double end f, (ay * bz - az * b_y) * nx + (az * bx - ax * bz) * ny + (ax * b_y - ay * bx) * nz g from q),
        t as (select *, g * f < 0 turned, case when abs(nz) <= 0.7 then 'wall' when nz * f > 0 then 'roof' else 'floor' end kind from s), u as (select *, case when turned then list_reverse(k) else k end o from t)
        select plane_uid, kind surface_type, case kind when 'floor' then 'Ground' else 'Outdoors' end boundary, turned, """ + ", ".join(f"round(o[{k + 1}][{n}], 5) + 0.0 {a}{k}" for k in (0, 1) for n, a in enumerate("xyz", 1)) + """ from u""",
    "map_rebuild": """with p as (select session_id, posetum_row_idx at_, tx, ty, tz, qx, qy, qz, qw, 2.0::double / (qx * qx + qy * qy + qz * qz + qw * qw) s from posetum
          where session_id is not null and posetum_row_idx is not null and pose_id is not null and tx is not null and ty is not null and tz is not null and qx is not null and qy is not null and qz is not null and qw is not null
          qualify row_number() over (partition by session_id, posetum_row_idx order by pose_id) = 1), e as (select user_id at_, value / 51.3::double x, (hour(ts) + 1) / 10.7::double y, (event_id % 7 + 1) / 9.1::double z from events),
        w as (select session_id, (1 - s * (qy * qy + qz * qz)) * x + s * (qx * qy - qz * qw) * y + s * (qx * qz + qy * qw) * z + tx x, s * (qx * qy + qz * qw) * x + (1 - s * (qx * qx + qz * qz)) * y + s * (qy * qz - qx * qw) * z + ty y,
          s * (qx * qz - qy * qw) * x + s * (qy * qz + qx * qw) * y + (1 - s * (qx * qx + qy * qy)) * z + tz z from e join p using (at_))
        select session_id, cast(floor(x) as bigint) i, cast(floor(y) as bigint) j, cast(floor(z) as bigint) k, count(*) n, round(avg(x), 8) + 0.0 x, round(avg(y), 8) + 0.0 y, round(avg(z), 8) + 0.0 z from w group by session_id, floor(w.x), floor(w.y), floor(w.z)""",
    "slab_planes": plane_sql(f"(select p.* from {POINTS} p join (select label, max(z) f from {POINTS} group by 1) using (label) where abs(z - f) <= 0.2::double)"),
    "box_refit": f"""with c as (select distinct label, floor(x / 0.05) i, floor(y / 0.05) j, floor(z / 0.05) k from {POINTS}) select label, count(*) cells, """
    + ", ".join(f"round(quantile_cont(({c} + 0.5) * 0.05::double, {q}), 5) + 0.0 {e}_{a}" for c, a in zip("ijk", "xyz") for e, q in (("lo", "0.05"), ("hi", "0.95"))) + " from c group by 1",
    "axis_raster": f"""with recursive f as ({plane_sql(POINTS)}), a as (select label, case when abs(nx) >= abs(ny) and abs(nx) >= abs(nz) then 0 when abs(ny) >= abs(nz) then 1 else 2 end axis from f),
        c as (select p.label, axis, cast(floor(case axis when 2 then y else z end / 0.04) as bigint) r, cast(floor(case axis when 0 then y else x end / 0.04) as bigint) c, count(*) n from {POINTS} p join a on a.label = p.label group by 1, 2, 3, 4),
        q as (select *, row_number() over (order by label, r, c) id from c), x as (select id a, id b from q union select x.a, z.id from x join q y on y.id = x.b join q z on y.label = z.label and abs(y.r - z.r) <= 1 and abs(y.c - z.c) <= 1),
        m as (select b id, min(a) g from x group by 1), k as (select g from q join m using (id) group by 1 having greatest(max(r) - min(r), max(c) - min(c)) + 1 >= 2)
        select label, axis, r as "row", c as "col", n from q join m using (id) semi join k using (g)""",
    "class_roles": f"""with n as (select label * 3 - 2 number from {POINTS}), k as (select number, case when number between 0 and {len(classes.NAMES) - 1} then {classes.NAMES!r}[number + 1] else 'other' end nm from n)
        select number, nm as "name", case when nm in {classes.FENESTRATION!r} then 'fenestration' else 'envelope' end as "role", count(*) n from k group by 1, 2, 3""",
    "pose_weights": """select pose_id, 21 n, 0.1::double v0, 0.0::double v1, 0.1::double v6, round(1.0 / (1.0 + abs(tz)), 6) v11, round(1.0 / (1.0 + abs(tz)), 6) v15, round(1.0 / (1.0 + abs(tz)), 6) v18, 0.1::double v20 from posetum where tz is not null""",
    "rest_intervals": f"""with e as (select user_id, us, value > 60 f, row_number() over (partition by user_id order by us) i from {EVENTS}), g as (select *, i - row_number() over (partition by user_id, f order by us) k from e),
        r as (select user_id, min(us) a, max(us) b, count(*) n from g where not f group by user_id, k) select user_id, a as "first", b as "last", n as length, round((b - a) / 1e6, 3) lasts_s from r where b - a >= 86400000000""",
}
