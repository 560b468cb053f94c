"""Points in space: depth buffers, nearest planes and samples, outliers, dense cells, clouds' axes.

Sets of planes are broadcast only after their number is checked (`MOST_PLANES`); they come from plane fits, tens per building.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from heliovox.functions import geometry as g
from heliovox.operators import lattice

MOST_PLANES = 20_000
MOST_CLASSES = 10_000


def z_buffer(points: DataFrame, *, pixel: Sequence[str], depth: str, tolerance: float) -> DataFrame:
    """Points whose depth is within the tolerance of the least one of their pixel.

    The least depths are aggregated map-side and joined back, so a pixel that many points fall on isn't sorted.
    """
    least = points.where(F.col(depth).isNotNull()).groupBy(*pixel).agg(F.min(depth).alias("_least"))
    return points.join(least, list(pixel)).where(F.col(depth) <= F.col("_least") + tolerance).drop("_least")


def nearest_plane(points: DataFrame, planes: DataFrame, *, point_id: str, threshold: float) -> DataFrame:
    """`point_id, plane_id`: the nearest plane (`plane_id, nx, ny, nz, d`) within the threshold, -1 if none; of equally near ones the smaller id.

    The planes are folded into one array, so each point is compared where it stands: no pairs are made, nothing is shuffled.
    """
    row = planes.select(F.struct("plane_id", "nx", "ny", "nz", "d").alias("p")).limit(MOST_PLANES + 1)
    held = row.agg(F.array_sort(F.collect_list("p")).alias("_ps")).withColumn("_ps", F.when(F.size("_ps") <= MOST_PLANES, F.col("_ps")).otherwise(F.raise_error(F.lit("too many planes for one array"))))
    gap = lambda p: F.try_divide(F.abs(p["nx"] * F.col("x") + p["ny"] * F.col("y") + p["nz"] * F.col("z") + p["d"]), F.sqrt(p["nx"] * p["nx"] + p["ny"] * p["ny"] + p["nz"] * p["nz"]))
    best = F.array_min(F.filter(F.transform("_ps", lambda p: F.struct(gap(p).alias("g"), p["plane_id"].alias("i"))), lambda s: s["g"] <= threshold))
    return points.crossJoin(F.broadcast(held)).select(point_id, F.coalesce(best["i"], F.lit(-1)).alias("plane_id"))  # one row


def bounded_face(points: DataFrame, faces: DataFrame, *, point_id: str, tolerance: float) -> DataFrame:
    """`point_id, face_id`: the nearest axis-aligned face within the tolerance whose bounds, widened by it, contain the point; points on none are left out.
    More than `MOST_PLANES` faces are an error.

    faces: `face_id, axis, fixed, lo0, hi0, lo1, hi1`; bounds run over the other two axes in order. Of equally near faces the smaller id counts.
    """
    at = lambda a: F.when(a == 0, F.col("x")).when(a == 1, F.col("y")).otherwise(F.col("z"))
    first = lambda a: F.when(a == 0, F.col("y")).otherwise(F.col("x"))
    second = lambda a: F.when(a == 2, F.col("y")).otherwise(F.col("z"))
    held = faces.limit(MOST_PLANES + 1).agg(F.array_sort(F.collect_list(F.struct("face_id", "axis", "fixed", "lo0", "hi0", "lo1", "hi1"))).alias("_fs"))
    held = held.withColumn("_fs", F.when(F.size("_fs") <= MOST_PLANES, F.col("_fs")).otherwise(F.raise_error(F.lit("too many faces for one array"))))
    near = F.transform(
        "_fs",
        lambda f: F.struct(
            F.when(first(f["axis"]).between(f["lo0"] - tolerance, f["hi0"] + tolerance) & second(f["axis"]).between(f["lo1"] - tolerance, f["hi1"] + tolerance), F.abs(at(f["axis"]) - f["fixed"])).alias("g"),
            f["face_id"].alias("i"),
        ),
    )
    best = F.array_min(F.filter(near, lambda s: s["g"] <= tolerance))
    return points.crossJoin(F.broadcast(held)).select(point_id, best["i"].alias("face_id")).where("face_id is not null")  # one row


def voxel_outliers(points: DataFrame, size: float, ratio: float) -> DataFrame:
    """Points in cells of at least max(2, mean - ratio * std) points, mean and (population) std over points, not cells."""
    cells = lattice.with_cells(points, size, names=lattice.INNER)
    counts = cells.groupBy(*lattice.INNER).agg(F.count("*").alias("_n"))
    # Sums over points from one row per cell.
    n, s, q = F.sum("_n"), F.sum(F.col("_n") * F.col("_n")), F.sum(F.col("_n") * F.col("_n") * F.col("_n"))
    mean = F.try_divide(s, n)
    limit = counts.agg(F.greatest(F.lit(2.0), mean - ratio * F.sqrt(F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0)))).alias("_limit"))
    kept = counts.crossJoin(F.broadcast(limit)).where("_n >= _limit").select(*lattice.INNER)  # one row
    return cells.join(kept, list(lattice.INNER), "left_semi").drop(*lattice.INNER)


def filtered(points: DataFrame, *, outliers: tuple[float, float] | None, declutter: float | None, voxel: float | None) -> DataFrame:
    """Points through the steps that are wanted, always in this order: thin cells out (cell size, ratio), the largest part alone (gap between parts), the mean of each cell."""
    from heliovox.operators import graph

    if outliers is not None:
        points = voxel_outliers(points, *outliers)
    if declutter is not None:
        points = graph.declutter(points, declutter)
    return points if voxel is None else lattice.grid_average(points, voxel)


def densest_crop(points: DataFrame, size: float, half: float) -> DataFrame:
    """Points within `half` in x and y of the centre of the fullest cell; of equally full ones the least indices count."""
    i, j = (lattice.index(lattice.clean(a), size) for a in "xy")
    full = points.select(i.alias("i"), j.alias("j")).dropna().groupBy("i", "j").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "i", "j")).alias("b"))
    at = F.broadcast(full.select(((F.col("b.i") + 0.5) * size).alias("_cx"), ((F.col("b.j") + 0.5) * size).alias("_cy")))  # one row
    return points.crossJoin(at).where((F.abs(F.col("x") - F.col("_cx")) <= half) & (F.abs(F.col("y") - F.col("_cy")) <= half)).drop("_cx", "_cy")


def principal_yaw(points: DataFrame) -> DataFrame:
    """`yaw_deg`, 0 to 180: the direction in which x and y vary most."""
    a = F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y")) / 2
    return points.agg(F.pmod(F.degrees(a), F.lit(180.0)).alias("yaw_deg"))


def folded_circular_mean(rows: DataFrame, degrees: Column, *, by: Sequence[str] = (), fold: int = 4) -> DataFrame:
    """`mean_deg`, `dispersion`: mean of angles that repeat every 360 / fold degrees, and 1 minus the length of their mean vector."""
    a = F.radians(degrees) * fold
    c, s = F.avg(F.cos(a)), F.avg(F.sin(a))
    return rows.groupBy(*by).agg(F.pmod(F.degrees(F.atan2(s, c)) / fold, F.lit(360.0 / fold)).alias("mean_deg"), (1 - F.sqrt(c * c + s * s)).alias("dispersion"))


def plane_moments(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, centroid and the six second moments of each group: all that a plane fit needs, combined map-side."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias("m" + a) for a in "xyz"], *[F.covar_pop(a, b).alias("c" + a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


def fit_planes(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`by, n, nx, ny, nz, d`: the plane of least squares of each group, its largest component positive. Groups of fewer than three points have none."""

    def solve(batches):
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for i, a in enumerate("xyz"):
                for j, c in enumerate("xyz"):
                    m[:, i, j] = b["c" + min(a, c) + max(a, c)]
            n = np.linalg.eigh(m)[1][:, :, 0] if len(b) else np.empty((0, 3))
            lead = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], axis=1) if len(b) else np.empty((0, 1))
            n = n * np.where(lead < 0, -1.0, 1.0)
            yield b[[*by, "n"]].assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2], d=-(n * b[["mx", "my", "mz"]].to_numpy()).sum(axis=1))

    moments = plane_moments(points, by).where("n >= 3")
    kinds = dict(moments.dtypes)
    return moments.mapInPandas(solve, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n bigint, nx double, ny double, nz double, d double"]))


def rigid_fit_2d(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`theta_deg, tx, ty`: rotation and shift that best carry (sx, sy) onto (dx, dy), in closed form."""
    cov = lambda a, b: F.covar_pop(a, b)
    theta = F.atan2(cov("sx", "dy") - cov("sy", "dx"), cov("sx", "dx") + cov("sy", "dy"))
    out = pairs.groupBy(*by).agg(theta.alias("_t"), *[F.avg(c).alias("_" + c) for c in ("sx", "sy", "dx", "dy")])
    c, s = F.cos("_t"), F.sin("_t")
    return out.select(*by, F.degrees("_t").alias("theta_deg"), (F.col("_dx") - c * F.col("_sx") + s * F.col("_sy")).alias("tx"), (F.col("_dy") - s * F.col("_sx") - c * F.col("_sy")).alias("ty"))


def k_nearest(points: DataFrame, *, point_id: str, k: int, leaf: int = 1000, sample: int = 200_000) -> DataFrame:
    """`point_id, distances`: ascending distances of each point to its k nearest others (fewer if there are fewer).

    A k-d tree over a bounded sample cuts space into boxes of about `leaf` places. Each box finds its own points' neighbours; a point whose
    ball of that radius reaches other boxes is asked there too, and the answers are merged: exact, with no pairs beyond one box
    in a task. Equal places are merged first and count as often as they occur. Rows with a null or NaN coordinate have no neighbours and are left out.
    """
    axes = list(lattice.AXES)
    whole = points.select(F.col(point_id).alias("id"), *[lattice.clean(a).alias(a) for a in axes]).dropna()
    places = whole.groupBy(*axes).agg(F.count("*").alias("m"))
    total = places.count()
    some = places.select(*axes).sample(fraction=min(1.0, 1.2 * sample / max(total, 1)), seed=7).limit(sample).toPandas().to_numpy(dtype=float)
    boxes = _boxes(some, max(8, int(leaf * len(some) / max(total, 1))))

    def locate(batches):
        for b in batches:
            p = b[axes].to_numpy(dtype=float)
            yield b.assign(box=_box_of(boxes, p))

    kinds = ", ".join(f"{a} double" for a in axes)
    placed = places.mapInPandas(locate, f"{kinds}, m bigint, box int")

    def inside(key, rows):
        p, m = rows[axes].to_numpy(dtype=float), rows["m"].to_numpy()
        return rows.assign(distances=pd.Series([d.tolist() for d in _near(p, p, m, k)], index=rows.index, dtype=object))

    own = placed.groupBy("box").applyInPandas(inside, f"{kinds}, m bigint, box int, distances array<double>")

    def reaching(batches):
        for b in batches:
            p = b[axes].to_numpy(dtype=float)
            radius = np.array([d[k - 1] if len(d) >= k else np.inf for d in b["distances"]])
            hits = [np.flatnonzero(_gap(boxes, q) < r) for q, r in zip(p, radius)]
            home = b["box"].to_numpy()
            rows = [(i, x) for i, h in enumerate(hits) for x in h if x != home[i]]
            at = [i for i, _ in rows]
            yield b.iloc[at][axes].assign(box=[int(x) for _, x in rows])

    asked = own.mapInPandas(reaching, f"{kinds}, box int")

    def outside(key, ask, there):
        p, m = there[axes].to_numpy(dtype=float), there["m"].to_numpy()
        return ask[axes].assign(distances=pd.Series([d.tolist() for d in _near(ask[axes].to_numpy(dtype=float), p, m, k, same=False)], index=ask.index, dtype=object))

    more = asked.groupBy("box").cogroup(placed.groupBy("box")).applyInPandas(outside, f"{kinds}, distances array<double>")
    merged = own.select(*axes, "distances").unionByName(more).groupBy(*axes).agg(F.slice(F.array_sort(F.flatten(F.collect_list("distances"))), 1, k).alias("distances"))
    return whole.join(merged, axes).select(F.col("id").alias(point_id), "distances")


def _boxes(p: np.ndarray, leaf: int) -> dict:
    """Splits of a k-d tree as arrays; leaves carry the number of their box and its bounds."""
    low, high = np.full(3, -np.inf), np.full(3, np.inf)
    splits, bounds = [], []

    def cut(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        at = len(splits)
        splits.append(None)
        span = np.ptp(rows, axis=0) if len(rows) else np.zeros(3)
        axis = int(span.argmax())
        value = float(np.median(rows[:, axis])) if len(rows) else 0.0
        left = rows[:, axis] < value if len(rows) else np.zeros(0, bool)
        if len(rows) <= leaf or span[axis] == 0 or not left.any():
            splits[at] = (-1, 0.0, len(bounds), 0)
            bounds.append((lo, hi))
            return at
        mid_hi, mid_lo = hi.copy(), lo.copy()
        mid_hi[axis] = mid_lo[axis] = value
        a = cut(rows[left], lo, mid_hi)
        b = cut(rows[~left], mid_lo, hi)
        splits[at] = (axis, value, a, b)
        return at

    cut(p, low, high)
    return {"splits": splits, "low": np.array([b[0] for b in bounds]), "high": np.array([b[1] for b in bounds])}


def _box_of(boxes: dict, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int32)
    todo = [(0, np.arange(len(p)))]
    while todo:
        at, rows = todo.pop()
        axis, value, a, b = boxes["splits"][at]
        if axis < 0:
            out[rows] = a
            continue
        left = p[rows, axis] < value
        todo += [(a, rows[left]), (b, rows[~left])]
    return out


def _gap(boxes: dict, q: np.ndarray) -> np.ndarray:
    """Distance of a point to every box."""
    return np.sqrt((np.maximum(np.maximum(boxes["low"] - q, q - boxes["high"]), 0.0) ** 2).sum(axis=1))


def _near(asked: np.ndarray, there: np.ndarray, counts: np.ndarray, k: int, same: bool = True, leaf: int = 1000) -> list[np.ndarray]:
    """Ascending distances to the k nearest of `there`, places counted as often as they occur; with `same`, one less of the place itself.

    Many places are cut into small boxes first: each is asked by itself, then those of its neighbours that its balls reach.
    """
    if len(there) <= 4 * leaf or not len(asked):
        return _nearest_of(asked, there, counts, k, same)
    boxes = _boxes(there, leaf)
    order = np.argsort(home := _box_of(boxes, there), kind="stable")
    edges = np.searchsorted(home[order], np.arange(len(boxes["low"]) + 1))
    rows = lambda b: order[edges[b] : edges[b + 1]]
    at = _box_of(boxes, asked)
    out: list[np.ndarray] = [np.empty(0)] * len(asked)
    for b in np.unique(at):
        who, own = np.flatnonzero(at == b), rows(b)
        first = _nearest_of(asked[who], there[own], counts[own], k, same)
        radius = np.array([d[k - 1] if len(d) >= k else np.inf for d in first])
        reached = np.array([_gap(boxes, q) < r for q, r in zip(asked[who], radius)])
        reached[:, b] = False
        others = np.flatnonzero(reached.any(axis=0))
        if len(others):
            far = np.concatenate([rows(o) for o in others])
            more = _nearest_of(asked[who], there[far], counts[far], k, False)
            first = [np.sort(np.r_[x, y])[:k] for x, y in zip(first, more)]
        for i, d in zip(who, first):
            out[i] = d
    return out


def _nearest_of(asked: np.ndarray, there: np.ndarray, counts: np.ndarray, k: int, same: bool) -> list[np.ndarray]:
    out = []
    for start in range(0, len(asked), 256):
        block = asked[start : start + 256]
        d = np.sqrt(((block[:, None, :] - there[None, :, :]) ** 2).sum(axis=2))
        top = min(k + 1, d.shape[1])
        near = np.argpartition(d, top - 1, axis=1)[:, :top] if d.shape[1] else np.empty((len(block), 0), int)
        for i, cols in enumerate(near):
            cols = cols[np.argsort(d[i, cols], kind="stable")]
            times = counts[cols].copy()
            if same:
                times[d[i, cols] == 0] -= 1
            out.append(np.repeat(d[i, cols], times)[:k])
    return out


def knn_outliers(points: DataFrame, *, point_id: str, k: int, ratio: float) -> DataFrame:
    """`point_id, mean_distance, kept`: kept if the mean distance to the k nearest is below mean + ratio * std (population) of all such means."""
    d = k_nearest(points, point_id=point_id, k=k)
    mean = F.try_divide(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x), F.size("distances"))
    d = d.select(point_id, mean.alias("mean_distance"))
    limit = d.agg((F.avg("mean_distance") + ratio * F.stddev_pop("mean_distance")).alias("_limit"))
    return d.crossJoin(F.broadcast(limit)).select(point_id, "mean_distance", F.coalesce(F.col("mean_distance") < F.col("_limit"), F.lit(True)).alias("kept"))  # one row


def class_cosines(rows: DataFrame, *, vector: str, label: str, keep: Sequence[str]) -> DataFrame:
    """`keep, label, cosine`: of every vector with the mean of the unit vectors of every class.

    The classes' means, at most `MOST_CLASSES`, are folded into one row, so each vector is compared where it stands. Null vectors and those of
    length 0 have no direction and are left out, as are null labels.
    """
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    wide = rows.where(F.col(label).isNotNull()).select(*keep, F.col(label).alias("_label"), F.transform(vector, lambda x: x.cast("double")).alias("_v")).withColumn("_size", size("_v")).where("_size > 0")
    unit = wide.withColumn("_u", F.transform("_v", lambda x: F.try_divide(x, F.col("_size"))))
    mean = unit.select("_label", F.posexplode("_u").alias("i", "x")).groupBy("_label", "i").agg(F.avg("x").alias("m")).groupBy("_label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"))
    mean = mean.select("_label", F.transform("m", lambda p: p["m"]).alias("m")).withColumn("size", size("m"))
    held = mean.limit(MOST_CLASSES + 1).agg(F.collect_list(F.struct("_label", "m", "size")).alias("_means"))
    held = held.withColumn("_means", F.when(F.size("_means") <= MOST_CLASSES, F.col("_means")).otherwise(F.raise_error(F.lit("too many classes for one array"))))
    dot = lambda c: F.aggregate(F.zip_with("_u", c["m"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    each = F.transform("_means", lambda c: F.struct(c["_label"].alias(label), F.try_divide(dot(c), c["size"]).alias("cosine")))
    return unit.crossJoin(F.broadcast(held)).select(*keep, F.explode(each).alias("_c")).select(*keep, "_c.*")  # one row


def ransac_plane(points: DataFrame, *, threshold: float, tries: int = 200, seed: int = 0, sample: int = 3000) -> DataFrame:
    """`n, nx, ny, nz, d`: the plane of the best of `tries` triples, refitted to its inliers.

    Triples come from a bounded sample; every hypothesis is scored on all points at once, as one aggregate each of min(distance^2, threshold^2).
    """
    base = points.select(*[lattice.clean(a).alias(a) for a in lattice.AXES]).dropna()
    total = base.count()
    some = base.sample(fraction=min(1.0, 1.3 * sample / max(total, 1)), seed=seed).limit(sample).toPandas().to_numpy(dtype=float)
    rng = np.random.default_rng(seed)
    planes = []
    for _ in range(tries if len(some) >= 3 else 0):
        a, b, c = some[rng.choice(len(some), 3, replace=False)]
        n = np.cross(b - a, c - a)
        if (size := np.linalg.norm(n)) > 1e-12:
            planes.append((*(n / size), -float(n @ a) / size))
    if not planes:
        return fit_planes(base.limit(0))

    hypotheses = np.array(planes)

    def cost(batches):
        loss = np.zeros(len(hypotheses))
        for b in batches:
            p = b.to_numpy(dtype=float)
            for start in range(0, len(p), 4096):
                q = p[start : start + 4096]
                loss += np.minimum((q @ hypotheses[:, :3].T + hypotheses[:, 3]) ** 2, threshold**2).sum(axis=0)
        yield pd.DataFrame({"h": np.arange(len(hypotheses)), "loss": loss})

    best = base.mapInPandas(cost, "h int, loss double").groupBy("h").agg(F.sum("loss").alias("loss")).orderBy("loss", "h").first()["h"]
    nx, ny, nz, d = (F.lit(float(v)) for v in hypotheses[best])
    return fit_planes(base.where(g.plane_distance([nx, ny, nz], d, [F.col(a) for a in lattice.AXES]) <= threshold))


def extract_planes(points: DataFrame, *, threshold: float, least: int, most: int, tries: int = 200, seed: int = 0) -> list[dict]:
    """Planes one after another, each fitted to what the ones before left, until one has fewer than `least` points; by support, largest first."""
    rest, out = points, []
    for turn in range(most):
        found = ransac_plane(rest, threshold=threshold, tries=tries, seed=seed + turn).first()
        if found is None or found["n"] < least:
            break
        out.append(found.asDict())
        n, d = [F.lit(found[c]) for c in ("nx", "ny", "nz")], F.lit(found["d"])
        rest = rest.where(g.plane_distance(n, d, [F.col(a) for a in lattice.AXES]) > threshold)
    return sorted(out, key=lambda p: -p["n"])


def dedupe_planes(planes: list[dict], *, degrees: float = 10.0, offset: float = 0.15) -> list[dict]:
    """Planes of one surface merged into the one with the most inliers: normals within `degrees`, and a centroid within `offset` of the other plane.

    planes: dicts with `normal`, `d`, `inlier_count`, `centroid`; tens of rows, in which each decision depends on those before.
    """
    normals = np.array([p["normal"] for p in planes], dtype=float).reshape(-1, 3)
    lead = np.abs(normals).argmax(axis=1) if len(planes) else []
    flip = np.array([1.0 if n[k] >= 0 else -1.0 for n, k in zip(normals, lead)])
    normals, d = normals * flip[:, None] if len(planes) else normals, flip * np.array([p["d"] for p in planes])
    centres = np.array([p["centroid"] for p in planes], dtype=float).reshape(-1, 3)
    order = sorted(range(len(planes)), key=lambda i: (-planes[i]["inlier_count"], i))
    free, kept = set(order), []
    for i in order:
        if i not in free:
            continue
        kept.append(i)
        angle = np.degrees(np.arccos(np.clip(normals @ normals[i], -1, 1)))
        apart = np.minimum(np.abs(centres @ normals[i] + d[i]), np.abs(normals @ centres[i] + d))
        free -= {j for j in free if j == i or (angle[j] < degrees and apart[j] < offset)}
    return [planes[i] for i in sorted(kept)]


def nearest_sample(cells: DataFrame, samples: DataFrame, *, frame: str, value: str) -> DataFrame:
    """`frame, row, col, value`: every pixel of `cells` takes the value of the sampled pixel nearest to it, of equally near ones the first by row, then column.

    A task holds one frame, whose size the camera bounds. Pixels of frames without samples are null.
    """

    # Both sides may stem from one table; columns of their own keep them apart.
    own = samples.select(F.col(frame).alias("_frame"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.col(value).cast("double").alias("_value"))

    def fill(key, want, have):
        if not len(want) or not len(have):  # a side without rows may come without columns
            return want.assign(**{value: np.nan})[[frame, "row", "col", value]] if len(want) else pd.DataFrame({c: [] for c in (frame, "row", "col", value)})
        p, q = want[["row", "col"]].to_numpy(), have.sort_values(["_row", "_col"], kind="stable")
        at, v = q[["_row", "_col"]].to_numpy(), q["_value"].to_numpy()
        out = np.empty(len(p))
        for start in range(0, len(p), 512):
            d = ((p[start : start + 512, None, :] - at[None]) ** 2).sum(axis=2)
            out[start : start + 512] = v[d.argmin(axis=1)]
        return want.assign(**{value: out})[[frame, "row", "col", value]]

    kind = dict(cells.dtypes)
    return cells.groupBy(frame).cogroup(own.groupBy("_frame")).applyInPandas(fill, f"`{frame}` {kind[frame]}, row {kind['row']}, col {kind['col']}, `{value}` double")
