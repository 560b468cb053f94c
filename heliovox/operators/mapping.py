"""Many views of one scene: points and the poses that see them, rasters looked up by pixel, regions, pairs in the plane, facing walls.

Pairs within a distance are found by cells of that size: one side is put into its cell and the neighbouring ones, both are joined on
the cell, and the distance is checked exactly. Cells with many members are split at run time, as skewed joins are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from heliovox.functions import geometry as g
from heliovox.operators import lattice
from heliovox.session import small

# Boxes wider than WIDEST cells, and those not of finite size, are few; beyond MOST_WIDE they aren't broadcast.
WIDEST, MOST_WIDE = 64, 10_000
# Points of a leaf, children of a node, and pairs of boxes and nodes that are looked at together.
LEAF, FAN, PAIRS = 32, 8, 4_000
FAR = 1e100


def _paired(left: DataFrame, right: DataFrame, at: Sequence[str], other: Sequence[str], reach: float) -> DataFrame:
    """Left rows joined to right ones whose `other` place is no farther than `reach` from their `at`, with the `distance`."""
    cell = lambda c: F.floor(lattice.clean(c) / F.lit(float(reach)))
    names = [f"_cell_{n}" for n in range(len(at))]
    steps = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(d, names)]) for d in product((-1, 0, 1), repeat=len(at))])
    near = right.withColumn("_s", F.explode(steps)).withColumns({c: cell(o) + F.col(f"_s.{c}") for c, o in zip(names, other)}).drop("_s")
    both = left.withColumns({c: cell(a) for c, a in zip(names, at)}).join(near, names).drop(*names)
    apart = [F.col(a) - F.col(b) for a, b in zip(at, other)]
    return both.withColumn("distance", F.sqrt(sum((x * x for x in apart[1:]), apart[0] * apart[0]))).where(F.col("distance") <= reach)


def within_range(points: DataFrame, poses: DataFrame, *, reach: float) -> DataFrame:
    """Every point (`x, y, z`) with every pose (`px, py, pz`) no farther than `reach`, and their `distance`. Points and poses with a null or NaN coordinate have no partner."""
    return _paired(points, poses, ("x", "y", "z"), ("px", "py", "pz"), reach)


def nearest_in_plane(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, at: tuple[str, str], other: tuple[str, str], reach: float) -> DataFrame:
    """`left_id, right_id, distance`: the nearest right point within `reach` of each left one, of equally near ones the smaller id; left points without one are left out."""
    pairs = _paired(left.select(left_id, *at), right.select(right_id, *other), at, other, reach)
    return pairs.groupBy(left_id).agg(F.min(F.struct("distance", right_id)).alias("b")).select(left_id, F.col(f"b.{right_id}").alias(right_id), "b.distance")


def oriented(poses: DataFrame) -> DataFrame:
    """Poses with their rotation `r00 .. r22` in place of the quaternion `qx, qy, qz, qw`: made once a pose, not once a pair."""
    rows = g.quaternion_rows(*[F.col(q) for q in ("qx", "qy", "qz", "qw")])
    return poses.withColumns({f"r{i}{j}": x for i, row in enumerate(rows) for j, x in enumerate(row)}).drop("qx", "qy", "qz", "qw")


def seen_pixels(pairs: DataFrame, camera: tuple[float, float, float, float], size: tuple[int, int], block: int) -> DataFrame:
    """Pairs of points and oriented poses (`px, py, pz, r00 .. r22`) that fall into the image, with `row, col` of blocks of pixels, and `depth`.

    The camera looks along the pose's first axis, its second axis to the left and its third up.
    """
    rows = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    ahead, left, up = g.to_local(rows, [F.col(c) for c in ("px", "py", "pz")], [F.col(c) for c in ("x", "y", "z")])
    local = pairs.withColumns({"depth": ahead, "_left": left, "_up": up}).drop(*[f"r{i}{j}" for i in range(3) for j in range(3)])
    u, v = g.pinhole((-F.col("_left"), -F.col("_up"), F.col("depth")), camera)
    out = local.withColumns({"_u": u, "_v": v}).drop("_left", "_up").where(g.in_view(F.col("_u"), F.col("_v"), F.col("depth"), *size))
    return out.withColumns({"row": F.floor(F.col("_v") / block), "col": F.floor(F.col("_u") / block)}).drop("_u", "_v")


def looked_up(rows: DataFrame, written: DataFrame, *, pixel: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """Rows with the `payload` of the pixel they fall on, null if nothing was written there; of several writers the last by `order` counts."""
    last = written.groupBy(*pixel).agg(F.max(F.struct(order, *payload)).alias("_w"))
    return rows.join(last, list(pixel), "left").select(*rows.columns, *[F.col(f"_w.{c}").alias(c) for c in payload])


def accumulated(seen: DataFrame, size: float, *, value: Column) -> DataFrame:
    """`i, j, k, n, mean, std` per cell of the points (`x, y, z`), over all views of them that give a value."""
    return lattice.cell_stats(seen.withColumn("_v", value), size, value="_v").where("n > 0")


def onto_occupied(values: DataFrame, occupied: DataFrame, *, cell: Sequence[str], value: str) -> DataFrame:
    """The occupied cells that values fall into, with the mean of those that meet in one."""
    means = values.groupBy(*cell).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return means.join(occupied.select(*cell).distinct(), list(cell), "left_semi")


def region_stats(points: DataFrame, regions: DataFrame, *, region_id: str, size: float) -> DataFrame:
    """`region_id, n, mean_x, mean_y`: the points (`x, y`) in each region `u0, u1, v0, v1`, borders included; regions without any have n = 0.

    Regions are put into all cells of `size` they touch, points into theirs.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("bigint"), F.floor(F.col(b) / size).cast("bigint"))
    cells = regions.where("u0 <= u1 and v0 <= v1").withColumn("_a", F.explode(span("u0", "u1"))).withColumn("_b", F.explode(span("v0", "v1")))
    placed = points.select("x", "y", F.floor(F.col("x") / size).alias("_a"), F.floor(F.col("y") / size).alias("_b"))
    inside = placed.join(cells, ["_a", "_b"]).where("x between u0 and u1 and y between v0 and v1")
    stats = inside.groupBy(region_id).agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    return regions.select(region_id).distinct().join(stats, region_id, "left").fillna({"n": 0})


def _in_box(x, y, cx, cy, c, s, w, h):
    """As `geometry.in_turned_box`, with NaN above all numbers, as in SQL."""
    u, v = np.abs((x - cx) * c + (y - cy) * s), np.abs((y - cy) * c - (x - cx) * s)
    return ((u <= w / 2) | np.isnan(w)) & ((v <= h / 2) | np.isnan(h))


def _tree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Finite points along a Z-curve in rows of a leaf each, and the nodes above them from the leaves up: middle, half sides and number of points, by parent."""

    def bits(a):
        side = a.max() - a.min()
        q = ((a - a.min()) / (side if side > 0 else 1.0) * (2**31 - 1)).astype(np.uint64)
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            q = (q | (q << np.uint64(shift))) & np.uint64(mask)
        return q

    def rows(a, width, fill):
        return np.concatenate([a, np.full(-len(a) % width, fill, dtype=a.dtype)]).reshape(-1, width)

    order = np.argsort(bits(x) | (bits(y) << np.uint64(1)), kind="stable")
    xs, ys = (rows(a[order], LEAF, np.nan) for a in (x, y))
    edges = [f(a, axis=1) for a in (xs, ys) for f in (np.fmin.reduce, np.fmax.reduce)]
    n, levels = (~np.isnan(xs)).sum(axis=1), []
    while True:
        x0, x1, y0, y1 = (rows(e, FAN, np.nan) for e in edges)
        n = rows(n, FAN, 0)
        levels.append(((x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2, n))
        if len(n) == 1:
            return xs, ys, levels
        edges, n = [f(a, axis=1) for a, f in ((x0, np.fmin.reduce), (x1, np.fmax.reduce), (y0, np.fmin.reduce), (y1, np.fmax.reduce))], n.sum(axis=1)


def _counts(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """How many of the points stand in each box `cx, cy, cos, sin, w, h`.

    Nodes wholly inside a box count at once, those outside are left, and only points of leaves that its sides cross are tested one by one. What
    lies nearer to a side than rounding reaches goes on to the test, so the counts are those of testing all points.
    """
    total = np.zeros(len(boxes), dtype=np.int64)
    fit, plain = (np.abs(x) < FAR) & (np.abs(y) < FAR), (np.abs(boxes) < FAR).all(axis=1)
    with np.errstate(all="ignore"):
        for k in np.flatnonzero(~plain):
            total[k] += np.count_nonzero(_in_box(x[fit], y[fit], *boxes[k]))
        for k in np.flatnonzero(~fit):
            total += _in_box(x[k], y[k], *boxes.T)
    if not fit.any() or not plain.any():
        return total
    xs, ys, levels = _tree(x[fit], y[fit])
    far, usual = np.abs(x[fit]).max() + np.abs(y[fit]).max(), np.flatnonzero(plain)
    for k in range(0, len(usual), PAIRS):
        some = boxes[usual[k : k + PAIRS]]
        eps = 1e-9 * (np.abs(some[:, [0, 1, 4, 5]]).sum(axis=1) + far)
        stack = [(len(levels) - 1, np.arange(len(some)), np.zeros(len(some), dtype=np.int64))]
        while stack:
            level, box, node = stack.pop()
            if len(box) > PAIRS:
                stack += [(level, box[j : j + PAIRS], node[j : j + PAIRS]) for j in range(0, len(box), PAIRS)]
                continue
            cx, cy, c, s, w, h = some[box].T[:, :, None]
            if level < 0:
                held = _in_box(xs[node], ys[node], cx, cy, c, s, w, h).sum(axis=1)
            else:
                mx, my, ex, ey, n = (a[node] for a in levels[level])
                dx, dy, e, ac, as_ = mx - cx, my - cy, eps[box][:, None], np.abs(c), np.abs(s)
                u, v, ru, rv = np.abs(dx * c + dy * s), np.abs(dy * c - dx * s), ex * ac + ey * as_, ex * as_ + ey * ac
                whole = (u + ru <= w / 2 - e) & (v + rv <= h / 2 - e)
                held = np.where(whole, n, 0).sum(axis=1)
                row, child = np.nonzero((u - ru <= w / 2 + e) & (v - rv <= h / 2 + e) & ~whole)  # nodes without points are NaN
                if len(row):
                    stack.append((level - 1, box[row], node[row] * FAN + child))
            total[usual[k : k + PAIRS]] += np.bincount(box, weights=held, minlength=len(some)).astype(np.int64)
    return total


def counted_in_boxes(boxes: DataFrame, points: DataFrame, *, by: str, size: float) -> DataFrame:
    """`by, n`: how many points (`x, y`) stand in the turned boxes `cx, cy, w, h, a` (degrees) of each `by`, borders included; those without any are left out.

    Boxes are put into all cells of `size` they touch, points into theirs. The points of a cell are a tree, so a box takes about the square root of
    their number, not every one of them. A task holds the points and boxes of one cell.
    """
    own = boxes.where("w > 0 and h > 0 and cx is not null and cy is not null and a is not null").where(F.col(by).isNotNull())
    own = own.withColumns({"_c": F.cos(F.radians("a")), "_s": F.sin(F.radians("a"))})
    slack = (F.abs("cx") + F.abs("cy") + F.col("w") + F.col("h")) * 1e-9  # of rounding
    along, across = (F.abs(F.col("w") * F.col(p)) / 2 + F.abs(F.col("h") * F.col(q)) / 2 + slack for p, q in (("_c", "_s"), ("_s", "_c")))
    own = own.select(by, "cx", "cy", "_c", "_s", "w", "h", along.alias("_u"), across.alias("_v"))
    placed = points.where("x is not null and y is not null").select("x", "y", F.floor(F.col("x") / size).alias("_a"), F.floor(F.col("y") / size).alias("_b"))
    span = lambda c, r: F.sequence(F.floor((F.col(c) - F.col(r)) / size), F.floor((F.col(c) + F.col(r)) / size))
    usual = F.greatest("_u", "_v") <= WIDEST * size / 2
    cells = own.where(usual).withColumn("_a", F.explode(span("cx", "_u"))).withColumn("_b", F.explode(span("cy", "_v")))
    cells = cells.unionByName(small(own.where(~usual), MOST_WIDE).crossJoin(placed.select("_a", "_b").distinct()))
    kind = dict(own.dtypes)[by]

    def count(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(asked):  # a side without rows may come without columns
            return pd.DataFrame({by: [], "n": []})
        n = _counts(there["x"].to_numpy(), there["y"].to_numpy(), asked[["cx", "cy", "_c", "_s", "w", "h"]].to_numpy())
        return pd.DataFrame({by: asked[by].to_numpy()[n > 0], "n": n[n > 0]})

    each = placed.groupBy("_a", "_b").cogroup(cells.drop("_u", "_v").groupBy("_a", "_b")).applyInPandas(count, f"`{by}` {kind}, n bigint")
    return each.groupBy(by).agg(F.sum("n").alias("n"))


def zipped(left: DataFrame, right: DataFrame, *, by: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The n-th left row of each group beside its n-th right row, as far as both go; `ordinal` counts from 1."""
    number = lambda rows, order: rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [by, "ordinal"])


def frame_difference(frames: DataFrame, *, frame: str, pixel: Sequence[str], value: str) -> DataFrame:
    """`frame, difference, pixels`: mean absolute difference of each frame to the one numbered one less, over the pixels both have."""
    before = frames.select((F.col(frame) + 1).alias(frame), *pixel, F.col(value).alias("_before"))
    both = frames.join(before, [frame, *pixel])
    return both.groupBy(frame).agg(F.avg(F.abs(F.col(value) - F.col("_before"))).alias("difference"), F.count("*").alias("pixels"))


def fold_stability(rows: DataFrame, *, by: str, order: Sequence[str], x: str, y: str, folds: int) -> DataFrame:
    """`by, mean_slope, std_slope`: of straight lines y over x fitted without one of `folds` contiguous parts in turn.

    Sums of each part are made once, map-side; a fit without a part is the whole's sums less the part's.
    """
    parts = rows.withColumn("_fold", F.ntile(folds).over(Window.partitionBy(by).orderBy(*order)))
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y))}
    each = parts.groupBy(by, "_fold").agg(*[s.alias(n) for n, s in sums.items()])
    whole = each.groupBy(by).agg(*[F.sum(n).alias("w" + n) for n in sums])
    n, sx, sy, sxx, sxy = (F.col("w" + c) - F.col(c) for c in sums)
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return each.join(whole, by).groupBy(by).agg(F.avg(slope).alias("mean_slope"), F.stddev_pop(slope).alias("std_slope"))


def facing_walls(walls: DataFrame, *, by: str, wall_id: str, degrees: float, least_gap: float) -> DataFrame:
    """`by, wall_id, other_id, gap`: pairs of walls of a building that face each other and are each other's nearest such wall, smaller id first.

    walls: unit normals `nx, ny, nz` and centres `x, y, z`. Walls face each other if their normals are parallel within `degrees` and their planes lie
    at least `least_gap` apart, measured along the normal of the one with the smaller id. Of equally near ones the smaller id counts.
    A building has tens of walls.
    """
    a = walls.select(by, wall_id, *[F.col(c).alias("a_" + c) for c in ("nx", "ny", "nz", "x", "y", "z")])
    b = walls.select(by, F.col(wall_id).alias("other_id"), *[F.col(c).alias("b_" + c) for c in ("nx", "ny", "nz", "x", "y", "z")])
    side = lambda s, names: [F.col(f"{s}_{c}") for c in names]
    flat = ("nx", "ny", "nz")
    gap = F.abs(g.dot(side("a", flat), [p - q for p, q in zip(side("b", "xyz"), side("a", "xyz"))]))
    pairs = a.join(b, by).where(F.col(wall_id) < F.col("other_id")).where(F.abs(g.dot(side("a", flat), side("b", flat))) >= F.lit(math.cos(math.radians(degrees))))
    pairs = pairs.withColumn("gap", gap).where(F.col("gap") >= least_gap).select(by, wall_id, "other_id", "gap")
    both = pairs.unionByName(pairs.select(by, F.col("other_id").alias(wall_id), F.col(wall_id).alias("other_id"), "gap"))
    best = both.groupBy(by, wall_id).agg(F.min(F.struct("gap", "other_id")).alias("b")).select(by, wall_id, "b.other_id", "b.gap")
    back = best.select(by, F.col("other_id").alias(wall_id), F.col(wall_id).alias("other_id"))
    return best.join(back, [by, wall_id, "other_id"], "left_semi").where(F.col(wall_id) < F.col("other_id"))


def rebuilt(points: DataFrame, poses: DataFrame, *, on: Sequence[str], size: float, by: Sequence[str] = ()) -> DataFrame:
    """`by, i, j, k, n, x, y, z`: scans' points (`x, y, z`, in axes of their pose) brought into the world by corrected, oriented poses, and averaged per cell."""
    rows = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    world = g.rigid(rows, [F.col(c) for c in ("px", "py", "pz")], [F.col(c) for c in ("x", "y", "z")])
    moved = points.join(poses, list(on)).select(*by, *[w.alias(a) for w, a in zip(world, lattice.AXES)])
    return lattice.with_cells(moved, size).groupBy(*by, *lattice.CELL).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in lattice.AXES])
