"""What cameras see and walls hold: zones of image regions, tiles, fields of view, layers, coverage across a wall's thickness, matched centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from heliovox.functions import geometry as g
from heliovox.operators import graph


# Bounds of the rule for zones: heights in the image, ratios of width and height, share of the box filled, pixels from the lower edge.
FLOOR_FROM, FLOOR_WIDE, FLOOR_FULL, FLOOR_EDGE = 0.55, 1.6, 0.5, 3
CEILING_TO, CEILING_WIDE, UPRIGHT = 0.30, 0.8, 1.3


def zone(height: int, *, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1", cy: str = "cy", area: str = "area") -> Column:
    """floor, ceiling, vertical or any, by where a region lies in an image of `height` rows, its shape and how much of its box it fills."""
    across, down = F.greatest(F.lit(1), F.col(x1) - F.col(x0)), F.greatest(F.lit(1), F.col(y1) - F.col(y0))
    level = F.col(cy) / F.lit(float(max(1, height)))
    on_floor = (level > FLOOR_FROM) & (across > FLOOR_WIDE * down) & (F.col(y1) >= height - FLOOR_EDGE) & (F.col(area) > FLOOR_FULL * across * down)
    on_ceiling = (level < CEILING_TO) & (across > CEILING_WIDE * down)
    return F.when(on_floor, "floor").when(on_ceiling, "ceiling").when(down > UPRIGHT * across, "vertical").otherwise("any")


def tiles(frames: DataFrame, *, width: str, height: str, rows: int, cols: int) -> DataFrame:
    """Frames with every box `x0, y0, x1, y1` of a grid over them; edges are rounded, halves to even."""
    cut = lambda size, k, n: F.bround(F.col(size) * k / F.lit(n)).cast("int")
    grid = frames.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return grid.select("*", cut(width, F.col("c"), cols).alias("x0"), cut(height, F.col("r"), rows).alias("y0"), cut(width, F.col("c") + 1, cols).alias("x1"), cut(height, F.col("r") + 1, rows).alias("y1"))


def turn_between(rows: DataFrame, *, by: Sequence[str], order: str) -> DataFrame:
    """Rows with `turn_deg`, the angle of the rotation from the quaternion before (qx, qy, qz, qw); null for the first."""
    w = Window.partitionBy(*by).orderBy(order)
    names = ("qx", "qy", "qz", "qw")
    c = sum((F.col(q) * F.lag(q).over(w) for q in names[1:]), F.col(names[0]) * F.lag(names[0]).over(w))
    size = F.sqrt(sum((F.col(q) * F.col(q) for q in names), F.lit(0.0)))
    d = rows.withColumns({"_c": c, "_s": size * F.lag(size).over(w)})
    return d.withColumn("turn_deg", 2 * F.degrees(g.clipped_acos(F.abs(F.try_divide("_c", "_s"))))).drop("_c", "_s")


def field_of_view(width: int, height: int, here: tuple, there: tuple, rotation: Sequence[Sequence[float]], shift: Sequence[float], other: tuple[int, int], spark, depths: Sequence[float] = (1.0, 2.0, 5.0, 10.0, 50.0)) -> DataFrame:
    """One row `x0, y0, x1, y1`: the box, within the other camera's image, of all that this camera sees: its border's rays at several depths, projected.

    here, there: focal lengths and centres (fx, fy, cx, cy) without distortion; rotation and shift carry points from this camera to the other.
    """
    edge = spark.range(2 * (width + height)).select("id")
    u = F.when(F.col("id") < 2 * width, F.col("id") % width).otherwise(F.when(F.col("id") < 2 * width + height, 0).otherwise(width - 1))
    v = F.when(F.col("id") < 2 * width, F.when(F.col("id") < width, 0).otherwise(height - 1)).otherwise((F.col("id") - 2 * width) % height)
    rays = edge.select(((u - here[2]) / here[0]).alias("rx"), ((v - here[3]) / here[1]).alias("ry")).withColumn("z", F.explode(F.array(*[F.lit(float(z)) for z in depths])))
    p = g.rigid([g.unit(r) for r in rotation], g.unit(shift), [F.col("rx") * F.col("z"), F.col("ry") * F.col("z"), F.col("z")])
    a, b = g.pinhole(p, there)
    seen = rays.select(a.alias("a"), b.alias("b"), p[2].alias("depth")).where("depth > 0")
    clip = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most)).cast("int")
    return seen.agg(clip(F.floor(F.min("a")), other[0]).alias("x0"), clip(F.floor(F.min("b")), other[1]).alias("y0"), clip(F.ceil(F.max("a")), other[0]).alias("x1"), clip(F.ceil(F.max("b")), other[1]).alias("y1"))


def layers(cells: DataFrame, *, by: Sequence[str], layer: str) -> DataFrame:
    """`by, mode, median, outer`: the commonest layer (the least of equal ones), and the median and 95th percentile, rounded half to even."""
    counts = cells.groupBy(*by, layer).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(layer).alias("l"))).alias("_best"))
    middle = cells.groupBy(*by).agg(F.rint(F.percentile(layer, F.lit(0.5))).cast("bigint").alias("median"), F.rint(F.percentile(layer, F.lit(0.95))).cast("bigint").alias("outer"))
    return best.join(middle, list(by)).select(*by, F.col("_best.l").cast("bigint").alias("mode"), "median", "outer")


def coverage(cells: DataFrame, *, by: str, rows: int, cols: int, kinds: dict[str, Column], least: float) -> DataFrame:
    """`by`, a share per kind and `kept`: over a wall's grid of rows x cols, the cells in which any layer across its thickness is of that kind;
    kept if those of the first kind cover at least `least`."""
    flat = cells.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).groupBy(by, "row", "col").agg(*[F.bool_or(k).alias(n) for n, k in kinds.items()])
    out = flat.groupBy(by).agg(*[(F.sum(F.col(n).cast("int")) / F.lit(float(rows * cols))).alias(n) for n in kinds])
    return out.withColumn("kept", F.col(next(iter(kinds))) >= least)


def matched_centres(detected: DataFrame, nominal: DataFrame, *, by: str) -> DataFrame:
    """`by, shift, residual`: by how many places the detected centres (x, y), in order of their angle about their middle, are turned against the nominal ones
    so that they fit best: the mean squared distance after the best rotation and shift, in closed form."""

    def ordered(points: DataFrame) -> DataFrame:
        middle = points.groupBy(by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.count("*").alias("m"))
        p = points.join(middle, by).select(by, "m", (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
        return p.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.atan2("y", "x"), "x", "y")) - 1)

    a = ordered(detected).withColumn("shift", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).withColumn("k", F.pmod(F.col("k") + F.col("shift"), F.col("m")))
    b = ordered(nominal).select(by, "k", F.col("x").alias("u"), F.col("y").alias("v"))
    fit = a.join(b, [by, "k"]).groupBy(by, "shift").agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("c"), F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")).alias("s"),
        F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("q"),
    )
    residual = (F.col("q") - 2 * F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))) / F.col("n")
    return fit.groupBy(by).agg(F.min(F.struct(F.greatest(F.round(residual, 9), F.lit(0.0)).alias("residual"), "shift")).alias("_best")).select(by, "_best.shift", "_best.residual")


def glazing(cells: DataFrame, *, by: str, glass: Column, opaque: Column, grow: int, gates: dict[str, tuple[float, float]]) -> DataFrame:
    """`by, window, cells, r0, c0, r1, c1, filled`: panes of glass in the rasters (`row`, `col`) of walls, numbered by their first cell.

    Glass grows down by up to `grow` cells that nothing opaque occupies, gaps of a cell are closed, and cells that touch, corners included, are one pane. gates:
    least and greatest `cells`, `width`, `height`, `sill` (first row) or `filled` (share of its bounds) of a pane. Rows count upward; `by` is a whole number.
    """
    stride = 1 << 20  # columns apart, so that no two walls touch
    wall = cells.groupBy(by, "row", "col").agg(F.max(glass).alias("_glass"), F.max(opaque).alias("_opaque"))
    wide = wall.select(F.col("row").cast("bigint").alias("row"), (F.col("col") + F.col(by) * stride).cast("bigint").alias("col"), "_glass", "_opaque")
    seeds, solid = wide.where("_glass").select("row", "col"), wide.where("_opaque and not _glass").select("row", "col")
    down = seeds.select("col", F.col("row").alias("_from"), F.explode(F.sequence(F.col("row") - grow, F.col("row"))).alias("row"))
    # Growth stops at the first opaque cell below.
    stops = down.join(solid, ["row", "col"]).groupBy("col", "_from").agg(F.max("row").alias("_stop"))
    grown = down.join(stops, ["col", "_from"], "left").where(F.col("row") > F.coalesce("_stop", F.col("row") - 1)).select("row", "col").distinct()
    shut = graph.closed(grown, ["row", "col"]).join(solid, ["row", "col"], "left_anti")
    panes = graph.cell_components(shut, ["row", "col"])
    out = panes.groupBy("component").agg(F.count("*").alias("cells"), F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    out = out.withColumns({"width": F.col("c1") - F.col("c0") + 1, "height": F.col("r1") - F.col("r0") + 1, "sill": F.col("r0")})
    out = out.withColumn("filled", F.col("cells") / (F.col("width") * F.col("height")))
    for name, (least, most) in gates.items():
        out = out.where(F.col(name).between(least, most))
    place = F.floor((F.col("c0") + stride // 2) / stride)
    return out.select(place.alias(by), F.col("component").alias("window"), "cells", "r0", (F.col("c0") - place * stride).alias("c0"), "r1", (F.col("c1") - place * stride).alias("c1"), "filled")
