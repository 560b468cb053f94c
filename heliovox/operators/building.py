"""Planes of one building, tens of them: frames, snapping, duplicates, a closed box. Plain numpy on the driver, as each decision
depends on those before; points only come in as aggregates or through `space`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from heliovox.functions import geometry as g


@dataclass(frozen=True)
class Plane:
    normal: tuple[float, float, float]
    d: float
    support: int
    centroid: tuple[float, float, float]

    @property
    def n(self) -> np.ndarray:
        v = np.array(self.normal, dtype=float)
        return v / np.linalg.norm(v)


def frame(planes: list[Plane], up: tuple[float, float, float] = (0.0, 0.0, 1.0), level: float = 0.8) -> np.ndarray:
    """Rows right, forward, up: up from the support-weighted normals of level planes, forward from those of the best supported upright direction,
    made orthogonal; the axes themselves where there is nothing to go by."""

    def mean(some: list[Plane], along: np.ndarray) -> np.ndarray:
        v = sum((p.support * p.n * (1.0 if p.n @ along >= 0 else -1.0) for p in some), np.zeros(3))
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-9 else along

    axis = np.array(up, dtype=float)
    z = mean([p for p in planes if abs(p.n @ axis) >= level], axis)
    upright = [p for p in planes if abs(p.n @ z) < 1 - level]
    lead = max(upright, key=lambda p: (sum(q.support for q in upright if abs(q.n @ p.n) > 0.9), p.support), default=None)
    forward = np.array([0.0, 1.0, 0.0]) if lead is None else mean([q for q in upright if abs(q.n @ lead.n) > 0.9], lead.n)
    y = forward - (forward @ z) * z
    y = y / np.linalg.norm(y) if np.linalg.norm(y) > 1e-9 else np.cross(z, [1.0, 0.0, 0.0])
    return np.array([np.cross(y, z), y, z])


def snapped(planes: list[Plane], axes: np.ndarray, most_degrees: float = 15.0) -> list[Plane]:
    """Planes within the angle of an axis turned onto it through their centroids; the others as they are."""
    out = []
    for p in planes:
        dots = axes @ p.n
        k = int(np.abs(dots).argmax())
        if np.degrees(np.arccos(min(1.0, abs(dots[k])))) > most_degrees:
            out.append(p)
            continue
        n = axes[k] * (1.0 if dots[k] >= 0 else -1.0)
        out.append(replace(p, normal=tuple(map(float, n)), d=-float(n @ np.array(p.centroid))))
    return out


def collapsed(planes: list[Plane], axes: np.ndarray, most_gap: float = 0.3) -> list[Plane]:
    """Of planes of one axis whose offsets follow one another within the gap, the best supported."""
    sides: dict[int, list[tuple[float, int]]] = {}
    for i, p in enumerate(planes):
        k = int(np.abs(axes @ p.n).argmax())
        sides.setdefault(k, []).append((float(axes[k] @ np.array(p.centroid)), i))
    kept = []
    for offsets in sides.values():
        offsets.sort()
        cluster = [offsets[0]]
        for o in [*offsets[1:], (np.inf, -1)]:
            if o[0] - cluster[-1][0] > most_gap:
                kept.append(max((i for _, i in cluster), key=lambda i: (planes[i].support, -i)))
                cluster = []
            cluster.append(o)
    return [planes[i] for i in sorted(kept)]


def closed_box(planes: list[Plane], axes: np.ndarray, bounds: np.ndarray) -> list[dict]:
    """Six faces `axis, side, offset, support, corners`: per axis and side the best supported plane on that side of the middle, or, open, the bound of the points.

    bounds: least and greatest coordinates (2 x 3) of the points along the axes.
    """
    middle = bounds.mean(axis=0)
    faces, offsets = [], np.empty((2, 3))
    chosen = {}
    for k in range(3):
        for side in (0, 1):
            some = [p for p in planes if int(np.abs(axes @ p.n).argmax()) == k and (axes[k] @ np.array(p.centroid) > middle[k]) == bool(side)]
            best = max(some, key=lambda p: p.support, default=None)
            chosen[k, side] = best
            offsets[side, k] = bounds[side, k] if best is None else axes[k] @ np.array(best.centroid)
    for k in range(3):
        u, v = [a for a in range(3) if a != k]
        for side in (0, 1):
            corners = []
            for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
                c = np.empty(3)
                c[k], c[u], c[v] = offsets[side, k], offsets[a, u], offsets[b, v]
                corners.append((c @ axes).tolist())
            best = chosen[k, side]
            faces.append({"axis": k, "side": side, "offset": float(offsets[side, k]), "support": best.support if best else 0, "corners": corners})
    return faces


def bounds_along(points: DataFrame, axes: np.ndarray) -> np.ndarray:
    """Least and greatest coordinates of points along three axes, one aggregate."""
    along = [sum((F.col(c) * float(a) for c, a in zip("xyz", axis)), F.lit(0.0)) for axis in axes]
    row = points.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(along) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return np.array([[row[f"{n}{k}"] for k in range(3)] for n in ("lo", "hi")], dtype=float)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points in a plane, in order; distinct points if there are fewer than three."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def smallest_rectangle(uv: np.ndarray) -> tuple[float, float, float]:
    """(angle in degrees from 0 to 90, width, height) of the rectangle of least area around points in a plane: one side lies along an edge of their hull."""
    p = np.unique(np.round(uv, 9), axis=0)
    if len(p) < 3:
        span = np.ptp(p, axis=0) if len(p) else np.zeros(2)
        return 0.0, float(span[0]), float(span[1])

    hull = convex_hull(p)
    edges = np.roll(hull, -1, axis=0) - hull
    angles = np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 12))
    c, s = np.cos(angles), np.sin(angles)
    u, v = np.outer(c, hull[:, 0]) + np.outer(s, hull[:, 1]), np.outer(c, hull[:, 1]) - np.outer(s, hull[:, 0])
    w, h = np.ptp(u, axis=1), np.ptp(v, axis=1)
    k = int((w * h).argmin())
    return float(np.degrees(angles[k])), float(w[k]), float(h[k])


def oriented_rectangles(points: DataFrame, *, by: str) -> DataFrame:
    """`by, angle_deg, width, height`: the rectangle of least area around the points (u, v) of each plane.

    Only the corners of the convex hull of a plane's points leave a task, so a plane of any number of points is a few rows in the last one.
    """
    kind = dict(points.dtypes)[by]

    def corners(batches):
        best: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(by, dropna=False):
                p = rows[["u", "v"]].dropna().to_numpy(dtype=float)
                p = np.vstack([p, best[key]]) if key in best else p
                if len(p):
                    best[key] = convex_hull(p)
        for key, p in best.items():
            yield pd.DataFrame({by: key, "u": p[:, 0], "v": p[:, 1]})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        angle, width, height = smallest_rectangle(rows[["u", "v"]].to_numpy())
        return pd.DataFrame([(rows[by].iloc[0], angle, width, height)], columns=[by, "angle_deg", "width", "height"])

    outer = points.select(by, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).mapInPandas(corners, f"`{by}` {kind}, u double, v double")
    return outer.groupBy(by).applyInPandas(fit, f"`{by}` {kind}, angle_deg double, width double, height double")


def levels(points: DataFrame, *, by: str, band: float = 0.1, share: float = 0.02) -> DataFrame:
    """`by, n, nx, ny, nz, d`: the floor under each keyframe: the plane through the points within `band` of the height below which `share` of them lie."""
    from heliovox.operators.space import fit_planes

    floor = points.groupBy(by).agg(F.percentile("z", F.lit(share)).alias("_floor"))
    return fit_planes(points.join(floor, by).where(F.abs(F.col("z") - F.col("_floor")) <= band), [by])


def model_surfaces(planes: DataFrame, *, corners: str, normal: Sequence[str], centre: Sequence[str], interior: Sequence[str]) -> DataFrame:
    """Planes with `surface_type` (wall, roof, floor), `boundary`, `turned` and `polygon`, the corners in the turn, seen from outside, that a building model wants.

    Outward is away from the interior point; corners whose own turn gives the inward normal are reversed. Floors lie on the ground.
    """
    out = g.outward([F.col(c) for c in normal], [F.col(c) for c in centre], [F.col(c) for c in interior])
    at = lambda k, n: F.get(F.get(corners, F.lit(k)), F.lit(n))
    a, b = ([at(k, n) - at(0, n) for n in range(3)] for k in (1, 2))
    own = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    turned = g.dot(own, out) < 0
    kind = F.when(F.abs(F.col(normal[2])) <= 0.7, "wall").when(out[2] > 0, "roof").otherwise("floor")
    d = planes.withColumns({"turned": turned, "surface_type": kind})
    return d.withColumns({"boundary": F.when(F.col("surface_type") == "floor", "Ground").otherwise("Outdoors"), "polygon": F.when(F.col("turned"), F.reverse(corners)).otherwise(F.col(corners))})


def slab(points: DataFrame, *, by: str, axis: str, band: float, upper: bool) -> DataFrame:
    """`by, n, nx, ny, nz, d`: the plane through the points of each group within `band` of its end along an axis: the try for a side that no plane closes."""
    from heliovox.operators.space import fit_planes

    end = points.groupBy(by).agg((F.max if upper else F.min)(axis).alias("_end"))
    return fit_planes(points.join(end, by).where(F.abs(F.col(axis) - F.col("_end")) <= band), [by])


def box_of_cells(points: DataFrame, *, by: str, size: float, share: float) -> DataFrame:
    """`by, cells, lo_x .. hi_z`: the bounds of each group's occupied cells' centres, without the outermost `share` on either side."""
    from heliovox.operators import lattice

    cells = lattice.with_cells(points, size).select(by, *lattice.CELL).distinct()
    ends = [F.percentile(lattice.centre(F.col(c), size), F.lit(q)).alias(f"{e}_{a}") for c, a in zip(lattice.CELL, lattice.AXES) for e, q in (("lo", share), ("hi", 1 - share))]
    return cells.groupBy(by).agg(F.count("*").alias("cells"), *ends)


def axis_raster(points: DataFrame, *, by: str, size: float, least_side: int) -> DataFrame:
    """`by, axis, row, col, n`: each group's points on the grid across the axis that its plane's normal lies nearest to, without parts whose longest side is below
    `least_side` cells. `by` is a whole number."""
    from heliovox.operators import graph, space

    stride = 1 << 20  # columns apart, so that no two groups touch
    axis = space.fit_planes(points, [by]).select(by, g.axis_of([F.col(c) for c in ("nx", "ny", "nz")]).alias("axis"))
    first, second = F.when(F.col("axis") == 0, F.col("y")).otherwise(F.col("x")), F.when(F.col("axis") == 2, F.col("y")).otherwise(F.col("z"))
    cells = points.join(axis, by).groupBy(by, "axis", F.floor(second / size).alias("row"), F.floor(first / size).alias("col")).agg(F.count("*").alias("n"))
    wide = cells.withColumn("_wide", F.col("col") + F.col(by) * stride)
    kept = graph.without_small(wide.select(F.col("row").alias("r"), F.col("_wide").alias("c")), ["r", "c"], least_side=least_side)
    return wide.join(kept, (F.col("row") == F.col("r")) & (F.col("_wide") == F.col("c")), "left_semi").drop("_wide")


def smoothed(points: DataFrame, *, by: str, size: float, band: float) -> DataFrame:
    """`by, axis, r0, c0, r1, c1`: each group's surface as rectangles: points within `band` of its plane, on the grid across the plane's axis, gaps of a cell closed,
    enclosed holes filled, and covered by rectangles. A task holds one surface's raster."""
    from heliovox.operators import graph, space

    planes = space.fit_planes(points, [by]).drop("n")
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    near = points.join(planes, by).where(g.plane_distance(n, F.col("d"), [F.col(a) for a in "xyz"]) <= band).withColumn("axis", g.axis_of(n))
    first, second = F.when(F.col("axis") == 0, F.col("y")).otherwise(F.col("x")), F.when(F.col("axis") == 2, F.col("y")).otherwise(F.col("z"))
    cells = near.select(by, "axis", F.floor(second / size).cast("int").alias("row"), F.floor(first / size).cast("int").alias("col")).distinct()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask, r, c = graph._mask(rows)
        found = [(rows[by].iloc[0], rows["axis"].iloc[0], a + r, b + c, x + r, y + c) for a, b, x, y in graph.cover(graph.filled(graph.closed_mask(mask)))]
        return pd.DataFrame(found, columns=[by, "axis", "r0", "c0", "r1", "c1"])

    return cells.groupBy(by).applyInPandas(run, f"`{by}` {dict(points.dtypes)[by]}, axis int, r0 int, c0 int, r1 int, c1 int")


def moved(planes: list[Plane], rotation: np.ndarray, shift: np.ndarray) -> list[Plane]:
    """Planes after a rigid motion."""
    out = []
    for p in planes:
        n = rotation @ p.n
        out.append(replace(p, normal=tuple(map(float, n)), d=float(p.d / np.linalg.norm(p.normal) - n @ shift), centroid=tuple(map(float, rotation @ np.array(p.centroid) + shift))))
    return out


def reclosed(planes: list[Plane], rotation: np.ndarray, shift: np.ndarray, axes: np.ndarray, bounds: np.ndarray) -> list[dict]:
    """The closed box of planes after a rigid motion, along the moved axes; `bounds` are those of the moved points along these."""
    return closed_box(moved(planes, rotation, shift), axes @ rotation.T, bounds)
