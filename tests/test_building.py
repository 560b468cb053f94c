import numpy as np
import pytest
from pyspark.sql import functions as F

from heliovox.operators import building as B, graph, trajectory as T


def room(turn=0.3):
    c, s = np.cos(turn), np.sin(turn)
    axes = np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])
    walls = []
    for k, (lo, hi) in enumerate(((-4, 4), (-2, 2), (0, 3))):
        for off, support in ((lo, 100 + k), (hi, 200 + k)):
            n = axes[k] + 0.01 * np.roll(axes[k], 1)
            centre = axes[k] * off + axes[2] * 1.5 * (k < 2)
            walls.append(B.Plane(tuple(n), -float(n @ centre), support, tuple(centre)))
    return axes, walls


def test_frame_snap_and_box():
    axes, walls = room()
    found = B.frame(walls)
    assert all(np.abs(found @ a).max() > 0.999 for a in axes) and np.allclose(found @ found.T, np.eye(3))
    snapped = B.snapped(walls, found)
    assert all(np.isclose(np.abs(found @ p.n).max(), 1) for p in snapped)
    twin = B.Plane(snapped[0].normal, snapped[0].d, 5, tuple(np.array(snapped[0].centroid) + 0.1 * snapped[0].n))
    assert B.collapsed([*snapped, twin], found) == snapped
    faces = B.closed_box(snapped[:-1], found, np.array([[-9, -9, 0], [9, 9, 3.2]]))
    assert len(faces) == 6 and sum(f["support"] == 0 for f in faces) == 1
    assert np.allclose(sorted(f["offset"] for f in faces if f["axis"] == 2), [0, 3.2])
    assert np.allclose(B.frame([]), np.eye(3))


def test_rectangles_of_least_area(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, angle in ((1, 20.0), (2, 65.0)):
        p = rng.uniform([-3, -1], [3, 1], (400, 2))
        p = np.vstack([p, [[-3, -1], [3, -1], [3, 1], [-3, 1]]])
        a = np.radians(angle)
        q = p @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        rows += [(k, *map(float, x)) for x in q]
    rows += [(3, 1.0, 1.0), (3, None, 2.0)]
    out = {r["k"]: r for r in B.oriented_rectangles(spark.createDataFrame(rows, "k int, u double, v double"), by="k").collect()}
    assert out[1]["angle_deg"] == pytest.approx(20, abs=1e-3) and out[1]["width"] * out[1]["height"] == pytest.approx(12, rel=1e-4)
    assert out[2]["angle_deg"] == pytest.approx(65, abs=1e-3) and out[3]["width"] == out[3]["height"] == 0


def test_levels(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(-3, 3, (500, 2))
    floor = np.column_stack([xy, 0.02 * xy[:, 0]])
    rows = [(7, *map(float, p)) for p in np.vstack([floor, rng.uniform([-3, -3, 0.5], [3, 3, 2.5], (200, 3))])]
    got = B.levels(spark.createDataFrame(rows, "k int, x double, y double, z double"), by="k", band=0.15).first()
    assert got["nx"] == pytest.approx(-0.02, abs=0.005) and got["nz"] > 0.99


def test_rotations_filled_along_the_arc(spark):
    h = lambda a: (0.0, 0.0, float(np.sin(a / 2)), float(np.cos(a / 2)))
    none = (None,) * 4
    rows = [(1, 0, *none), (1, 1, *h(0.0)), (1, 2, *none), (1, 3, *none), (1, 4, *h(0.6)), (1, 5, *none)]
    df = spark.createDataFrame(rows, "k int, i int, qx double, qy double, qz double, qw double")
    got = [2 * np.arctan2(r["qz"], r["qw"]) for r in T.fill_rotations(df, by=["k"], order="i").orderBy("i").collect()]
    assert np.allclose(got, [0, 0, 0.2, 0.4, 0.6, 0.6])


def test_headings_snap_to_right_angles(spark):
    steps = [(1, 0, 0, 10.0, 1.0), (1, 0, 1, 12.0, 1.0), (1, 1, 2, 97.0, 2.0), (1, 1, 3, 97.0, 1.0)]
    df = spark.createDataFrame(steps, "k int, seg int, i int, h double, l double")
    out = T.snapped_headings(df, by=["k"], segment="seg", order="i", heading="h", length="l").orderBy("i").collect()
    assert [round(r["snapped"], 6) for r in out] == [10.0, 12.0, 101.0, 101.0]


def test_scan_alignment_and_pose_graph():
    rng = np.random.default_rng(2)
    target = rng.uniform(-2, 2, (250, 3))
    a = 0.1
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    t, rmse = T.align((target - [0.05, -0.04, 0.02]) @ r, target)
    assert rmse < 1e-3 and np.allclose(t[:3, :3], r, atol=1e-3) and np.allclose(t[:3, 3], [0.05, -0.04, 0.02], atol=1e-3)
    n = 20
    truth = np.array([[np.cos(k / n * 2 * np.pi), np.sin(k / n * 2 * np.pi), k / n * 2 * np.pi] for k in range(n)])

    def relative(i, j):
        c, s = np.cos(truth[i, 2]), np.sin(truth[i, 2])
        d = truth[j, :2] - truth[i, :2]
        return np.array([c * d[0] + s * d[1], -s * d[0] + c * d[1], truth[j, 2] - truth[i, 2]])

    edges = [(k, k + 1, relative(k, k + 1), 1.0) for k in range(n - 1)] + [(n - 1, 0, relative(n - 1, 0), 1.0)]
    start = truth + np.vstack([[0, 0, 0], rng.normal(0, 0.05, (n - 1, 3))])
    assert np.allclose(T.optimise(start, edges), truth, atol=1e-6)


def test_places_seen_again(spark):
    rng = np.random.default_rng(3)
    base = {k: rng.uniform([-10, -10, 0], [10, 10, 3], (200, 3)) * [1 + k, 1, 1 + k % 3] for k in range(6)}
    base[5] = base[0][:, [1, 0, 2]]  # turned
    rows = [(k, *map(float, p)) for k, ps in base.items() for p in ps]
    d = T.scan_descriptors(spark.createDataFrame(rows, "scan long, x double, y double, z double"), scan="scan")
    assert [(r["a"], r["b"]) for r in T.seen_again(d, scan="scan", least_gap=3, most=0.15).collect()] == [(5, 0)]


def test_yaw_follows_the_walls(spark):
    keys = spark.createDataFrame([(1, i, float(i)) for i in range(12)], "k int, i int, yaw double")
    walls = spark.createDataFrame([(1, i, 30.0 + i + 90.0 * j) for i in range(12) for j in range(3)], "k int, i int, angle_deg double")
    out = T.straightened(keys, walls, by=["k"], order="i", reach=0).orderBy("i").collect()
    assert np.allclose([r["yaw"] for r in out], 0)


def test_morphology_and_holes(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((14, 16)) < 0.75
    cells = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "row long, col long")

    def shifted(m, grow):
        p = np.pad(m, 3, constant_values=False)
        parts = [np.roll(np.roll(p, a, 0), b, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        return (np.any if grow else np.all)(parts, axis=0)[3:-3, 3:-3]

    got = lambda df: {(r["row"], r["col"]) for r in df.collect()}
    inside = lambda df: df.where("row between 0 and 13 and col between 0 and 15")
    assert got(inside(graph.dilated(cells, ["row", "col"]))) == set(zip(*map(lambda x: x.tolist(), np.nonzero(shifted(mask, True)))))
    assert got(graph.eroded(cells, ["row", "col"])) == set(zip(*map(lambda x: x.tolist(), np.nonzero(shifted(mask, False)))))
    wall = spark.createDataFrame([(r, c) for r in range(12) for c in range(12) if not (4 <= r <= 7 and 4 <= c <= 8)], "row long, col long")
    (hole,) = graph.wall_holes(wall, rows=12, cols=12, least=4, most=50).collect()
    assert (hole["cells"], hole["r0"], hole["c0"], hole["r1"], hole["c1"]) == (20, 4, 4, 7, 8)
    assert graph.inferred_holes(wall, rows=12, cols=12, refine=3).count() == 20 * 9


def test_declutter_and_footprints(spark):
    rows = [(i, i * 0.1, 0.0, 0.0) for i in range(30)] + [(100, 50.0, 0.0, 0.0), (101, 50.0, 0.05, 0.0)]
    p = spark.createDataFrame(rows, "i int, x double, y double, z double")
    assert {r["i"] for r in graph.declutter(p, 0.5).collect()} == set(range(30))
    assert graph.declutter(p, 0.5, least=2).count() == 32 and graph.declutter(p.limit(0), 0.5, least=1).count() == 0
    boxes = spark.createDataFrame([(1, -0.1, 0.9, 0.0, 0.4), (2, 1.0, 0.0, 0.0, 1.0)], "b int, u0 double, u1 double, v0 double, v1 double")
    assert sorted((r["row"], r["col"]) for r in graph.footprints(boxes, 0.5).collect()) == [(0, -1), (0, 0), (0, 1)]
    assert boxes.where(F.lit(False)).count() == 0


def test_rectangles_merge_without_losing_cells():
    rng = np.random.default_rng(8)
    for _ in range(20):
        mask = rng.random((8, 10)) < 0.6
        after = graph.merged(list(graph.cover(mask)), gate=1.0)
        again = np.zeros_like(mask, int)
        for r0, c0, r1, c1 in after:
            again[r0 : r1 + 1, c0 : c1 + 1] += 1
        assert (again == mask).all()
    assert graph.merged([(0, 0, 1, 1), (0, 2, 1, 3), (5, 5, 5, 5)], gate=0.9) == [(0, 0, 1, 3), (5, 5, 5, 5)]
    assert graph.merged([]) == []


def test_centres_and_field_of_view(spark):
    from heliovox.operators import views

    square = np.array([[0, 0], [2, 0], [2, 1], [0, 1.5]])
    a = 1.9
    turned = square @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + 5
    frame = lambda p: spark.createDataFrame([(1, *map(float, q)) for q in p], "b int, x double, y double")
    got = views.matched_centres(frame(turned[[2, 0, 3, 1]]), frame(square), by="b").first()
    assert got["residual"] < 1e-9
    box = views.field_of_view(10, 10, (10.0, 10.0, 5.0, 5.0), (100.0, 100.0, 50.0, 50.0), np.eye(3).tolist(), (0, 0, 0), (100, 100), spark).first()
    assert (box["x0"], box["y0"], box["x1"], box["y1"]) == (0, 0, 90, 90)


def test_rectangle_holds_every_corner_of_the_hull(spark):
    a = np.radians(np.arange(0, 360, 0.1))
    p = np.column_stack([3 * np.cos(a), 2 * np.sin(a)])
    found = B.oriented_rectangles(spark.createDataFrame([(1, float(u), float(v)) for u, v in p], "k int, u double, v double"), by="k").first()
    assert (found["angle_deg"], found["width"], found["height"]) == pytest.approx(B.smallest_rectangle(p))
    assert len(B.convex_hull(p)) == len(p)
    t = np.radians(found["angle_deg"])
    turned = p @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    assert np.all(np.ptp(turned, axis=0) <= np.array([found["width"], found["height"]]) + 1e-9)


def test_places_seen_again_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, profiles = [], {}
    for scan in range(120):
        base = rng.uniform(0.5, 40, 20) if scan < 30 else profiles_of[int(rng.integers(30))] * rng.uniform(0.9, 1.1, 20)
        if scan == 0:
            profiles_of = {}
        if scan < 30:
            profiles_of[scan] = base
        for ring, top in enumerate(base):
            rows.append((scan, ring, 0, float(top)))
        v = np.empty(40)
        v[::2], v[1::2] = base, 1.0
        profiles[scan] = v
    d = spark.createDataFrame(rows, "scan long, ring int, sector int, top double")
    got = {r["a"]: r["b"] for r in T.seen_again(d, scan="scan", least_gap=10, most=0.06).collect()}
    expected = {}
    for a in profiles:
        near = [(np.linalg.norm(profiles[a] - profiles[b]) / (np.linalg.norm(profiles[a]) + np.linalg.norm(profiles[b])), b) for b in profiles if a - b >= 10]
        if near and min(near)[0] <= 0.06:
            expected[a] = min(near)[1]
    assert got == expected and len(expected) > 50


def test_masks_closed_and_filled():
    from heliovox.operators import graph

    mask = np.zeros((9, 9), bool)
    mask[1:8, 1:8] = True
    mask[3:6, 3:6] = False  # a hole
    mask[1, 4] = False  # a notch of one cell
    assert graph.closed_mask(mask)[1, 4] and not graph.closed_mask(mask)[0].any()
    assert not graph.closed_mask(mask)[4, 4]
    full = graph.filled(graph.closed_mask(mask))
    assert full[1:8, 1:8].all() and full.sum() == 49
    ring = np.zeros((5, 5), bool)
    ring[1:4, 1:4] = True
    ring[2, 2:] = False  # open to the side
    assert (graph.filled(ring) == ring).all()


def test_smoothed_surface_of_a_noisy_wall(spark):
    from heliovox.operators import building

    rng = np.random.default_rng(2)
    yz = np.array([(a, b) for a in np.arange(0.025, 2, 0.05) for b in np.arange(0.025, 1, 0.05) if not (0.5 < a < 1.0 and 0.3 < b < 0.7)])
    wall = np.column_stack([rng.normal(0, 0.01, len(yz)), yz])
    far = np.column_stack([np.full(20, 3.0), rng.uniform(0, 1, (20, 2))])
    df = spark.createDataFrame([(1, *map(float, p)) for p in np.vstack([wall, wall, wall, far])], "s int, x double, y double, z double")
    rows = building.smoothed(df, by="s", size=0.05, band=0.4).collect()
    assert [(r["axis"], r["r0"], r["c0"], r["r1"], r["c1"]) for r in rows] == [(0, 0, 0, 19, 39)]
    assert building.smoothed(df.limit(0), by="s", size=0.05, band=0.4).count() == 0


def test_skeleton_of_a_cross():
    from heliovox.operators import graph

    mask = np.zeros((21, 31), bool)
    mask[9:12, 1:30] = True
    mask[1:20, 14:17] = True
    thin = graph.thinned(mask)
    assert thin.sum() < 60 and (thin & ~mask).sum() == 0 and len(graph._parts(set(zip(*map(list, np.nonzero(thin)))))) == 1
    arms = graph.branches(thin, 4)
    assert len(arms) == 4 and sorted(round(a[4]) >= 6 for a in arms) == [True] * 4
    assert {a[1] == a[3] or a[0] == a[2] for a in arms} == {True}
    spur = np.zeros((5, 20), bool)
    spur[3, :] = True
    spur[2, 9] = True
    assert len(graph.branches(spur, 3)) == 1 and graph.branches(spur, 3)[0] == (3, 0, 3, 19, 19.0)


def test_planes_moved_keep_their_points():
    from heliovox.operators import building as B

    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    shift = rng.normal(size=3)
    p = B.Plane((0.0, 0.0, 2.0), -6.0, 10, (1.0, 2.0, 3.0))
    (m,) = B.moved([p], q, shift)
    for x in ((0, 0, 3.0), (5, -2, 3.0)):
        assert abs(np.array(m.normal) @ (q @ np.array(x) + shift) + m.d) < 1e-9
    assert np.allclose(m.centroid, q @ np.array(p.centroid) + shift)
