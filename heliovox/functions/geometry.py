"""Rotations, projections, planes and angles as column expressions, with vectors unrolled into scalars."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(values: Sequence[float]) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def clipped_acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def quaternion_rows(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length; of one near zero, the identity."""
    n = x * x + y * y + z * z + w * w
    s = F.when(n >= 1e-12, 2.0 / n).otherwise(F.lit(0.0))
    return [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]


def rotate(rows: Sequence[Vector], p: Vector) -> list[Column]:
    return [dot(r, p) for r in rows]


def transpose(rows: Sequence[Vector]) -> list[list[Column]]:
    return [list(c) for c in zip(*rows)]


def rigid(rows: Sequence[Vector], shift: Vector, p: Vector) -> list[Column]:
    return [a + b for a, b in zip(rotate(rows, p), shift)]


def to_local(rows: Sequence[Vector], position: Vector, p: Vector) -> list[Column]:
    """World to sensor: the inverse of a pose given by rotation and position."""
    return rotate(transpose(rows), [a - b for a, b in zip(p, position)])


def rotation_of_vector(phi: Vector) -> list[list[Column]]:
    """Rotation matrix of a rotation vector, by the series for small angles."""
    theta = norm(phi)
    small = theta < 1e-8
    a = F.when(small, F.lit(1.0)).otherwise(F.try_divide(F.sin(theta), theta))
    b = F.when(small, F.lit(0.5)).otherwise(F.try_divide(1 - F.cos(theta), theta * theta))
    x, y, z = phi
    return [
        [1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y],
        [b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x],
        [b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y)],
    ]


def slerp_weights(c: Column, t: Column) -> tuple[Column, Column]:
    """Weights of two unit quaternions with dot product `c`, along the shorter arc; linear if they nearly agree."""
    theta = clipped_acos(F.abs(c))
    near = F.abs(c) > 0.9995
    first = F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * theta), F.sin(theta)))
    second = F.when(near, t).otherwise(F.try_divide(F.sin(t * theta), F.sin(theta)))
    return first, second * F.when(c < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def slerp(q0: Vector, q1: Vector, t: Column) -> list[Column]:
    """Between two unit quaternions, made unit again."""
    w0, w1 = slerp_weights(dot(q0, q1), t)
    mixed = F.array(*[w0 * a + w1 * b for a, b in zip(q0, q1)])
    size = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda acc, x: acc + x * x))
    return [F.try_divide(mixed[k], size) for k in range(4)]


def pinhole(p: Vector, k: tuple[float, float, float, float], distortion: Sequence[float] = (0, 0, 0, 0, 0)) -> tuple[Column, Column]:
    """Pixel of a point in camera axes: focal lengths and centre `k`, distortion k1, k2, p1, p2, k3; null at depth 0."""
    fx, fy, cx, cy = k
    k1, k2, p1, p2, k3 = distortion
    x, y = F.try_divide(p[0], p[2]), F.try_divide(p[1], p[2])
    if not any(distortion):
        return fx * x + cx, fy * y + cy
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    u = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    v = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return fx * u + cx, fy * v + cy


def in_view(u: Column, v: Column, depth: Column, width: int, height: int) -> Column:
    return F.coalesce((depth > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def plane_distance(n: Vector, d: Column, p: Vector) -> Column:
    return F.try_divide(F.abs(dot(n, p) + d), norm(n))


def in_plane(p: Vector, origin: Vector, u: Vector, v: Vector, n: Vector) -> tuple[Column, Column, Column]:
    q = [a - b for a, b in zip(p, origin)]
    return dot(q, u), dot(q, v), dot(q, n)


def axis_of(n: Vector) -> Column:
    """0, 1 or 2: the axis along which a normal is longest, the first of equal ones."""
    a, b, c = (F.abs(x) for x in n)
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)


def canonical(n: Vector, d: Column) -> list[Column]:
    """Normal and offset with the largest component positive."""
    longest = F.when(axis_of(n) == 0, n[0]).when(axis_of(n) == 1, n[1]).otherwise(n[2])
    sign = F.when(longest < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [x * sign for x in (*n, d)]


def tilt(n: Vector) -> Column:
    """Degrees between a unit normal and the nearest axis."""
    return F.least(*[F.degrees(clipped_acos(F.abs(x))) for x in n])


def bearing(nx: Column, ny: Column, north: float = 0.0) -> Column:
    return F.pmod(F.degrees(F.atan2(nx, ny)) + north, F.lit(360.0))


def angular_window(p: Vector, half_deg: float) -> Column:
    """Whether a point ahead (along x) lies within the given angle to either side and up or down."""
    az, el = F.degrees(F.atan2(p[1], p[0])), F.degrees(F.atan2(p[2], F.hypot(p[0], p[1])))
    return (F.abs(az) <= half_deg) & (F.abs(el) <= half_deg)


def rescaled(k: tuple[float, float, float, float], calibrated: tuple[int, int], captured: tuple[int, int]) -> tuple[float, float, float, float]:
    """Focal lengths and centre of a camera for captures of another size than it was calibrated with."""
    w, h = captured[0] / calibrated[0], captured[1] / calibrated[1]
    return k[0] * w, k[1] * h, k[2] * w, k[3] * h


def composed(a: tuple[Sequence[Sequence[float]], Sequence[float]], b: tuple[Sequence[Sequence[float]], Sequence[float]]) -> tuple[list[list[float]], list[float]]:
    """The rigid motion (rotation, shift) that does `b`, then `a`."""
    (ra, ta), (rb, tb) = a, b
    rotation = [[sum(ra[i][k] * rb[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return rotation, [sum(ra[i][k] * tb[k] for k in range(3)) + ta[i] for i in range(3)]


def north_up(bearing_deg: float) -> list[list[float]]:
    """Rotation about the vertical that turns a direction of this bearing to the first axis' side: by 90 degrees less the bearing."""
    t = math.radians(90.0 - bearing_deg)
    return [[math.cos(t), -math.sin(t), 0.0], [math.sin(t), math.cos(t), 0.0], [0.0, 0.0, 1.0]]


def outward(n: Vector, point: Vector, interior: Vector) -> list[Column]:
    """A plane's normal at a point of it, turned away from an interior point."""
    sign = F.when(dot(n, [a - b for a, b in zip(point, interior)]) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [x * sign for x in n]


def pixel_bearing(u: Column, v: Column, k: tuple[float, float, float, float]) -> list[Column]:
    """Unit vector, in camera axes, towards a pixel of an undistorted image."""
    p = [(u - k[2]) / k[0], (v - k[3]) / k[1], F.lit(1.0)]
    size = norm(p)
    return [x / size for x in p]


def box_corners(cx: Column, cy: Column, width: Column, depth: Column, yaw_deg: Column) -> Column:
    """The four corners, in turn, of a rectangle in plan that is turned about its centre."""
    c, s = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg))
    at = lambda a, b: F.array(cx + c * width * a - s * depth * b, cy + s * width * a + c * depth * b)
    return F.array(at(-0.5, -0.5), at(0.5, -0.5), at(0.5, 0.5), at(-0.5, 0.5))


def in_turned_box(x: Column, y: Column, cx: Column, cy: Column, width: Column, depth: Column, yaw_deg: Column) -> Column:
    c, s = F.cos(F.radians(yaw_deg)), F.sin(F.radians(yaw_deg))
    return (F.abs((x - cx) * c + (y - cy) * s) <= width / 2) & (F.abs((y - cy) * c - (x - cx) * s) <= depth / 2)


def _part(n: int, corner: Column) -> Column:
    return F.get(corner, F.lit(n))


def face_bounds(corners: Column) -> list[Column]:
    """Least and greatest coordinate of a face's corners, axis by axis."""
    along = [F.transform(corners, partial(_part, n)) for n in range(3)]
    return [f(a) for a in along for f in (F.array_min, F.array_max)]


def snapped(p: Vector, n: Vector, d: Column, share: float) -> list[Column]:
    """A point moved by a share of its distance towards a plane with a unit normal."""
    gap = dot(n, p) + d
    return [a - share * gap * b for a, b in zip(p, n)]
