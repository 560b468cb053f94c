"""Trajectories: gaps filled along the shorter arc, headings straightened, places seen again, scans aligned, poses made consistent."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from heliovox.functions import geometry as g
from heliovox.operators import series

QUATERNION = ("qx", "qy", "qz", "qw")


def fill_rotations(rows: DataFrame, *, by: Sequence[str], order: str) -> DataFrame:
    """Missing quaternions from the valid ones before and after, along the shorter arc; at the ends the nearest valid one. `order` is numeric."""
    w = Window.partitionBy(*by).orderBy(order)
    valid = F.when(F.coalesce(*[F.col(q) for q in QUATERNION[:1]]).isNotNull() & F.col("qw").isNotNull(), F.struct(F.col(order).alias("o"), *QUATERNION))
    a = F.last(valid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(valid, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    # Step by step, so that no expression is written out many times over.
    d = rows.withColumns({"_a": a, "_b": b})
    p, q = [F.col(f"_a.{c}") for c in QUATERNION], [F.col(f"_b.{c}") for c in QUATERNION]
    share = F.coalesce(F.try_divide((F.col(order) - F.col("_a.o")).cast("double"), (F.col("_b.o") - F.col("_a.o")).cast("double")), F.lit(0.0))
    d = d.withColumns({"_t": share, "_c": g.dot(p, q)}).withColumn("_w", F.array(*g.slerp_weights(F.col("_c"), F.col("_t"))))
    d = d.withColumn("_m", F.array(*[F.col("_w")[0] * x + F.col("_w")[1] * y for x, y in zip(p, q)]))
    d = d.withColumn("_n", F.sqrt(F.aggregate("_m", F.lit(0.0), lambda acc, x: acc + x * x)))
    filled = {c: F.coalesce(F.col(c), F.try_divide(F.col("_m")[k], F.col("_n")), x, y) for k, (c, x, y) in enumerate(zip(QUATERNION, p, q))}
    return d.withColumns(filled).drop("_a", "_b", "_t", "_c", "_w", "_m", "_n")


def heights_from_first(rows: DataFrame, *, by: Sequence[str], order: str, floor: str, z: str) -> DataFrame:
    """`z` shifted so that the floor height of every keyframe agrees with that of the first one."""
    first = F.first(floor, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(z, F.col(z) - F.coalesce(F.col(floor) - first, F.lit(0.0)))


def snapped_headings(steps: DataFrame, *, by: Sequence[str], segment: str, order: str, heading: str, length: str) -> DataFrame:
    """Steps with `snapped` heading, `x` and `y`: every segment turned so that its length-weighted heading differs from the first one's by a
    multiple of 90 degrees, and the path integrated again."""
    a = F.radians(heading)
    mean = steps.groupBy(*by, segment).agg(F.degrees(F.atan2(F.sum(F.col(length) * F.sin(a)), F.sum(F.col(length) * F.cos(a)))).alias("_m"))
    base = F.first("_m").over(Window.partitionBy(*by).orderBy(segment).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turns = mean.withColumn("_turn", F.col("_m") - (base + 90.0 * F.rint(F.round((F.col("_m") - base) / 90.0, 9)))).drop("_m")
    joined = steps.join(turns, [*by, segment]).withColumn("snapped", F.pmod(F.col(heading) - F.col("_turn"), F.lit(360.0))).drop("_turn")
    s = F.radians("snapped")
    return series.reintegrated(joined, by=by, order=order, step={"x": F.col(length) * F.cos(s), "y": F.col(length) * F.sin(s)})


def scan_descriptors(points: DataFrame, *, scan: str, rings: int = 20, sectors: int = 60, reach: float = 40.0) -> DataFrame:
    """`scan, ring, sector, top`: the greatest height in each cell of a polar grid around the sensor."""
    r = F.hypot(F.col("x"), F.col("y"))
    ring, sector = F.floor(r / reach * rings).cast("int"), F.floor(F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)) / 360.0 * sectors).cast("int")
    return points.where(r < reach).groupBy(scan, ring.alias("ring"), sector.alias("sector")).agg(F.max("z").alias("top"))


def seen_again(descriptors: DataFrame, *, scan: str, least_gap: int, most: float, rings: int = 20) -> DataFrame:
    """`a, b, distance`: for every scan the earlier one, at least `least_gap` before, whose ring profile is nearest, if within `most` (below 1); of equally near ones the first.

    Profiles (mean height and cell count per ring, which turning doesn't change) are one array per scan; the distance of two is that of the arrays over
    the sum of their lengths. Within `most`, lengths lie within a factor, and every projection within a distance that follows from the length: so scans are put
    into cells by length and three projections, and only compared with those of neighbouring cells. Nothing within `most` is missed.
    """
    profile = descriptors.groupBy(scan, "ring").agg(F.sum("top").alias("s"), F.count("*").alias("n")).groupBy(scan).agg(F.map_from_entries(F.collect_list(F.struct("ring", F.struct("s", "n").alias("v")))).alias("m"))
    values = [F.coalesce(F.try_element_at("m", F.lit(k))[c].cast("double"), F.lit(0.0)) for k in range(rings) for c in ("s", "n")]
    scans = profile.select(F.col(scan).cast("bigint").alias("scan"), F.array(*values).alias("v"))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # Sums over a third of the entries each, over the root of their number: projections on three directions at right angles.
    cuts = [round(2 * rings * k / 3) for k in range(4)]
    thirds = [F.aggregate(F.slice("v", a + 1, b - a), F.lit(0.0), lambda acc, x: acc + x) / math.sqrt(b - a) for a, b in zip(cuts, cuts[1:])]
    scans = scans.withColumns({"size": size("v"), **{f"p{n}": t for n, t in enumerate(thirds)}}).where("size > 0")
    factor = math.log((1 + most) / (1 - most))
    level = F.floor(F.log("size") / factor)
    # Of two scans within `most`, one of this level and one of a level beside it, no projection differs by more.
    reach = lambda k: F.exp((k + 2) * factor) * (2 * most)
    cell = lambda n, k: F.floor(F.col(f"p{n}") / reach(k))
    late = scans.select(F.col("scan").alias("a"), F.col("v").alias("va"), F.col("size").alias("sa"), level.alias("k"), *[F.col(f"p{n}") for n in range(3)])
    late = late.select("a", "va", "sa", "k", *[cell(n, F.col("k")).alias(f"c{n}") for n in range(3)])
    early = scans.select(F.col("scan").alias("b"), F.col("v").alias("vb"), F.col("size").alias("sb"), F.explode(F.sequence(level - 1, level + 1)).alias("k"), *[F.col(f"p{n}") for n in range(3)])
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{n}") for n, x in enumerate(d)]) for d in product((-1, 0, 1), repeat=3)])
    early = early.withColumn("d", F.explode(steps)).select("b", "vb", "sb", "k", *[(cell(n, F.col("k")) + F.col(f"d.d{n}")).alias(f"c{n}") for n in range(3)])
    apart = size(F.zip_with("va", "vb", lambda x, y: x - y)) / (F.col("sa") + F.col("sb"))
    met = late.join(early, ["k", "c0", "c1", "c2"]).where(F.col("a") - F.col("b") >= least_gap).select("a", "b", apart.alias("distance")).where(F.col("distance") <= most)
    return met.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", "m.b", "m.distance")


def _nearest_rows(p: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest row of `target` for each of `p`, and the squared distance, some rows at a time."""
    place, gap = np.empty(len(p), np.int64), np.empty(len(p))
    step = max(1, 4_000_000 // max(1, len(target)))
    for start in range(0, len(p), step):
        d = ((p[start : start + step, None] - target[None]) ** 2).sum(axis=2)
        place[start : start + step] = j = d.argmin(axis=1)
        gap[start : start + step] = d[np.arange(len(d)), j]
    return place, gap


def align(source: np.ndarray, target: np.ndarray, start: np.ndarray | None = None, rounds: int = 30, reach: float = 1.0) -> tuple[np.ndarray, float]:
    """(4 x 4 transform, RMSE) that carries `source` onto `target`: nearest points within a reach that shrinks, and the best rigid fit, in turn."""
    t = np.eye(4) if start is None else start.copy()
    rmse = np.inf
    for k in range(rounds):
        p = source @ t[:3, :3].T + t[:3, 3]
        j, gap = _nearest_rows(p, target)
        ok = gap <= max(reach * 0.8**k, 0.1 * reach) ** 2
        if ok.sum() < 6:
            break
        a, b = p[ok], target[j[ok]]
        ca, cb = a.mean(axis=0), b.mean(axis=0)
        u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
        r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = r, cb - r @ ca
        t = step @ t
        rmse = float(np.sqrt(gap[ok].mean()))
        if np.abs(step - np.eye(4)).max() < 1e-7:
            break
    return t, rmse


def optimise(poses: np.ndarray, edges: list[tuple[int, int, np.ndarray, float]], rounds: int = 25) -> np.ndarray:
    """Planar poses (x, y, heading in radians) that agree best with relative ones (from, to, (dx, dy, turn), weight); the first pose stays. Gauss-Newton.

    For keyframes of one recording, thousands at most; the normal equations are dense.
    """
    x = poses.astype(float).copy()
    n = len(x)
    for _ in range(rounds):
        h, rhs = np.zeros((3 * n, 3 * n)), np.zeros(3 * n)
        for i, j, z, weight in edges:
            c, s = np.cos(x[i, 2]), np.sin(x[i, 2])
            dx, dy = x[j, :2] - x[i, :2]
            e = np.array([c * dx + s * dy - z[0], -s * dx + c * dy - z[1], (x[j, 2] - x[i, 2] - z[2] + np.pi) % (2 * np.pi) - np.pi])
            a = np.array([[-c, -s, -s * dx + c * dy], [s, -c, -c * dx - s * dy], [0, 0, -1]])
            b = np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])
            rows, cols = slice(3 * i, 3 * i + 3), slice(3 * j, 3 * j + 3)
            for p, q in ((rows, a), (cols, b)):
                rhs[p] -= weight * q.T @ e
                for r, m in ((rows, a), (cols, b)):
                    h[p, r] += weight * q.T @ m
        h[:3] = 0
        h[:, :3] = 0
        h[:3, :3] = np.eye(3)
        rhs[:3] = 0
        step = np.linalg.solve(h + 1e-9 * np.eye(3 * n), rhs).reshape(n, 3)
        x += step
        if np.abs(step).max() < 1e-9:
            break
    return x


def straightened(keyframes: DataFrame, walls: DataFrame, *, by: Sequence[str], order: str, reach: int = 5) -> DataFrame:
    """Keyframes with `yaw` less the drift of their walls: per keyframe the mean wall angle (which repeats every 90 degrees) against the first keyframes', smoothed.

    walls: `by, order, angle_deg` per wall normal.
    """
    from heliovox.operators.space import folded_circular_mean

    seen = folded_circular_mean(walls, F.col("angle_deg"), by=[*by, order])
    joined = keyframes.join(seen.select(*by, order, (F.col("mean_deg") * 4).alias("_four")), [*by, order], "left")
    smooth = series.rolling_circular_mean(joined, by=by, order=order, degrees="_four", reach=reach, name="_smooth")
    base = F.first("_smooth", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    drift = (F.pmod(F.col("_smooth") - base + 180.0, F.lit(360.0)) - 180.0) / 4
    return smooth.withColumn("yaw", F.col("yaw") - F.coalesce(drift, F.lit(0.0))).drop("_four", "_smooth")
