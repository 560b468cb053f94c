import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliovox.functions import geometry as g
from heliovox.operators import graph, series, space, timejoin, vote


@pytest.mark.parametrize("seed", range(3))
def test_nearest_in_time_against_brute_force(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice([1, 2, None]), rng.choice([None, rng.randrange(0, 10**6)])) for i in range(300)]
    right = [(rng.choice([1, 2, None, 3]), rng.choice([None, rng.randrange(0, 10**6)]), i) for i in range(80)]
    l, r = spark.createDataFrame(left, "i int, k int, t long"), spark.createDataFrame(right, "k int, t long, id int")
    for tolerance in (None, 3000):
        out = timejoin.nearest(l, r, time="t", keys=["k"], payload=["id"], tolerance_us=tolerance, bin_us=10_000).collect()
        assert len(out) == len(left)
        for row in out:
            near = [(abs(t - row["t"]), t, id_) for k, t, id_ in right if k == row["k"] and t is not None and row["t"] is not None]
            near = [x for x in near if tolerance is None or x[0] <= tolerance]
            assert (row["nearest"]["id"] if row["nearest"] else None) == (min(near)[2] if near else None)


def test_contained_and_interpolated(spark):
    rows = spark.createDataFrame([(1, 5), (2, 10), (3, None), (4, 10**7)], "i int, t long")
    spans = spark.createDataFrame([(7, 5, 10), (8, 6, 10**7), (9, 9, 8), (10, None, 4)], "w int, a long, b long")
    got = timejoin.contained(rows, spans, time="t", start="a", end="b", bin_us=1000).select("i", "w").collect()
    assert sorted(map(tuple, got)) == [(1, 7), (2, 7), (2, 8), (4, 8)]
    samples = spark.createDataFrame([(0, 0.0), (10, 20.0), (10, 20.0)], "t long, v double")
    grid = spark.createDataFrame([(-1,), (0,), (5,), (10,), (50,), (None,)], "t long")
    values = {r["t"]: r["v"] for r in timejoin.interpolated(grid, samples, time="t", value="v", bin_us=4).collect()}
    assert values == {-1: None, 0: 0.0, 5: 10.0, 10: 20.0, 50: 20.0, None: None}


@pytest.mark.parametrize("seed", range(3))
def test_k_nearest_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.vstack([rng.normal(size=(220, 3)), rng.normal(size=(60, 3)) * 0.01 + 3, np.repeat([[1.0, 1.0, 1.0]], 12, axis=0)]).round(3)
    rows = [(i, *map(float, x)) for i, x in enumerate(p)] + [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0)]
    out = {r["i"]: r["distances"] for r in space.k_nearest(spark.createDataFrame(rows, "i int, x double, y double, z double"), point_id="i", k=5, leaf=30).collect()}
    assert set(out) == set(range(len(p)))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(p)):
        assert np.allclose(out[i], np.sort(d[i])[:5])


def test_k_nearest_of_few(spark):
    few = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3.0, 4.0, 0.0)], "i int, x double, y double, z double")
    assert {r["i"]: r["distances"] for r in space.k_nearest(few, point_id="i", k=3).collect()} == {1: [5.0], 2: [5.0]}
    assert space.k_nearest(few.limit(0), point_id="i", k=3).count() == 0


@pytest.mark.parametrize("shape", ["path", "hub", "random", "empty"])
def test_components_against_union_find(spark, shape):
    rng = random.Random(2)
    edges = {"path": [(i, i + 1) for i in range(120)], "hub": [(0, i) for i in range(1, 150)] + [(500, 501)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)], "empty": []}[shape] + [(1000, 1000)] * (shape != "empty")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    out = graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in out} == {n: root(n) for n in parent}


def test_holes_and_rectangles(spark):
    ring = [(r, c, 1) for r in range(1, 5) for c in range(1, 5) if r in (1, 4) or c in (1, 4)] + [(2, 4, 2), (7, 7, 3)]
    ring = [x for x in ring if x != (2, 4, 1)]
    filled = graph.fill_enclosed(spark.createDataFrame(ring, "row int, col int, label int"), rows=9, cols=9).where("filled").collect()
    assert {(r["row"], r["col"], r["label"]) for r in filled} == {(2, 2, 18), (2, 3, 18), (3, 2, 18), (3, 3, 18)}
    rng = np.random.default_rng(3)
    for _ in range(30):
        mask = rng.random((7, 9)) < 0.7
        again = np.zeros_like(mask, int)
        for r0, c0, r1, c1 in graph.cover(mask):
            again[r0 : r1 + 1, c0 : c1 + 1] += 1
        assert (again == mask).all()
        best = max((a.all() * a.size for r in range(7) for c in range(9) for x in range(r + 1, 8) for y in range(c + 1, 10) if (a := mask[r:x, c:y]).all()), default=0)
        assert graph.largest_rectangle(mask)[0] == best


def test_ransac_and_dedupe(spark):
    rng = np.random.default_rng(4)
    n = np.array([0.2, -0.1, 1.0]) / np.linalg.norm([0.2, -0.1, 1.0])
    uv = rng.uniform(-3, 3, (900, 2))
    z = (-0.5 - n[0] * uv[:, 0] - n[1] * uv[:, 1]) / n[2] + rng.normal(0, 0.005, 900)
    p = np.vstack([np.column_stack([uv, z]), rng.uniform(-3, 3, (300, 3))])
    found = space.ransac_plane(spark.createDataFrame(p.tolist(), "x double, y double, z double"), threshold=0.03).first()
    assert np.degrees(np.arccos(abs(np.dot(n, [found["nx"], found["ny"], found["nz"]])))) < 1 and found["n"] >= 890 and abs(found["d"] - 0.5) < 0.02
    planes = [{"normal": [0, 0, 1], "d": -1.0, "inlier_count": 10, "centroid": [0, 0, 1]}, {"normal": [0, 0, -1], "d": 1.05, "inlier_count": 50, "centroid": [1, 0, 1.05]}, {"normal": [0, 0, 1], "d": -3.0, "inlier_count": 5, "centroid": [0, 0, 3]}]
    assert space.dedupe_planes(planes) == planes[1:]
    assert space.dedupe_planes([]) == []


def test_rotations(spark):
    q = (0.1, -0.3, 0.2, 0.9)
    rows = g.quaternion_rows(*g.unit(q))
    p = [F.col(a) for a in "xyz"]
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    back = g.to_local(rows, g.unit((0.5, 0.1, -1)), g.rigid(rows, g.unit((0.5, 0.1, -1)), p))
    assert np.allclose(tuple(df.select(*back).first()), (1, 2, 3))
    half = g.rotate(g.rotation_of_vector(g.unit((0, 0, np.pi / 2))), p)
    assert np.allclose(tuple(df.select(*half).first()), (-2, 1, 3))
    mid = g.slerp(g.unit((0, 0, 0, 1)), g.unit((0, 0, -np.sin(0.4), -np.cos(0.4))), F.lit(0.5))
    assert np.allclose(tuple(df.select(*mid).first()), (0, 0, np.sin(0.2), np.cos(0.2)))


def test_folds_match_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.uniform(0, 20), rng.uniform(0, 360)) for k in (1, 2) for i in range(200)]
    out = series.keyframes(spark.createDataFrame(rows, "k int, i int, x double, h double"), by="k", order="i", position=["x"], heading="h", least_step=8.0, least_turn=120.0)
    got = {(r["k"], r["i"]) for r in out.where("keyframe = 1").collect()}
    expected, last = set(), {}
    for k, i, x, h in rows:
        if k not in last or abs(x - last[k][0]) >= 8 or abs((h - last[k][1] + 180) % 360 - 180) >= 120:
            last[k] = (x, h)
            expected.add((k, i))
    assert got == expected


def test_vote_ties_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, None, 9.0), (1, "c", None), (2, "c", 0.1)], "k int, m string, c double")
    assert sorted(map(tuple, vote.weighted(rows, ["k"], "m", conf="c").select("k", "m").collect())) == [(1, "a"), (2, "c")]
    assert vote.weighted(rows.limit(0), ["k"], "m", conf="c").count() == 0
    assert {r["m"]: r["n"] for r in vote.shares(rows, "m").collect()} == {"a": 1, "b": 1, "c": 2, None: 1}


def test_solar_limits_of_an_unknown_time_are_unknown(spark):
    from heliovox.functions import solar

    df = spark.createDataFrame([(None,), (-0.5,), (0.5,)], "s double")
    rows = df.select(solar.most_possible(F.col("s")).alias("m"), solar.clear_sky(F.col("s")).alias("c")).collect()
    assert tuple(rows[0]) == (None, None) and rows[1]["m"] == 15.0 and rows[1]["c"] == 0.0 and rows[2]["m"] > rows[2]["c"] > 400


def test_sun_over_rome(spark):
    from heliovox.functions import solar

    # Noon of the solstice: elevation 90 - 41.9 + 23.44 degrees.
    at = spark.createDataFrame([(1718968260000000,)], "t long").select(solar.sine_of_elevation(F.col("t"), F.lit(41.9), F.lit(12.5))).first()[0]
    assert abs(np.degrees(np.arcsin(at)) - 71.5) < 0.2


def test_too_many_faces_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(space, "MOST_PLANES", 3)
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "i int, x double, y double, z double")
    faces = lambda n: spark.createDataFrame([(k, 2, 0.5 - 0.1 * k, -1.0, 1.0, -1.0, 1.0) for k in range(n)], "face_id int, axis int, fixed double, lo0 double, hi0 double, lo1 double, hi1 double")
    assert [tuple(r) for r in space.bounded_face(p, faces(3), point_id="i", tolerance=0.45).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="too many faces"):
        space.bounded_face(p, faces(6), point_id="i", tolerance=0.45).collect()


def test_bodies_in_geometry(spark):
    from heliovox.functions import geometry as g

    row = spark.range(1).select(
        F.array(*g.outward([F.lit(0.0), F.lit(0.0), F.lit(1.0)], [F.lit(0.0)] * 3, [F.lit(0.0), F.lit(0.0), F.lit(5.0)])).alias("out"),
        F.array(*g.pixel_bearing(F.lit(420.0), F.lit(240.0), (100.0, 100.0, 320.0, 240.0))).alias("ray"),
        g.box_corners(*[F.lit(v) for v in (1.0, 2.0, 4.0, 2.0, 90.0)]).alias("box"),
        g.in_turned_box(F.lit(1.0), F.lit(3.9), *[F.lit(v) for v in (1.0, 2.0, 4.0, 2.0, 90.0)]).alias("in"),
        g.in_turned_box(F.lit(2.5), F.lit(2.0), *[F.lit(v) for v in (1.0, 2.0, 4.0, 2.0, 90.0)]).alias("not_in"),
        F.array(*g.snapped([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.lit(-1.0), 0.5)).alias("at"),
        F.array(*g.face_bounds(F.array(F.array(F.lit(1.0), F.lit(5.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(6.0), F.lit(2.0))))).alias("bounds"),
    ).first()
    assert row["out"] == [0.0, 0.0, -1.0] and [round(v, 6) for v in row["ray"]] == [round(0.5**0.5, 6), 0.0, round(0.5**0.5, 6)]
    assert [[round(v, 9) for v in c] for c in row["box"]] == [[2, 0], [2, 4], [0, 4], [0, 0]] and row["in"] and not row["not_in"]
    assert row["at"] == [1.0, 2.0, 2.0] and row["bounds"] == [-1, 1, 5, 6, 0, 2]
    assert g.rescaled((100.0, 100.0, 50.0, 40.0), (200, 100), (100, 100)) == (50.0, 100.0, 25.0, 40.0)
    turn, shift = g.composed((g.north_up(0.0), [1.0, 0.0, 0.0]), (g.north_up(90.0), [0.0, 2.0, 0.0]))
    assert [round(v, 9) for v in turn[0]] == [0, -1, 0] and [round(v, 9) for v in shift] == [-1, 0, 0]


def test_many_views_of_one_scene(spark):
    """A warm wall seen by two poses: hidden points and those behind a pose don't count, and a known U-value comes back."""
    from heliovox.functions import thermal
    from heliovox.operators import mapping, space

    points = spark.createDataFrame([(1, 2.0, 0.0, 0.0), (2, 2.9, 0.0, 0.0), (3, -1.0, 0.0, 0.0), (4, 50.0, 0.0, 0.0), (5, None, 0.0, 0.0)], "point long, x double, y double, z double")
    poses = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "pose long, px double, py double, pz double, qx double, qy double, qz double, qw double")
    pairs = mapping.within_range(points, mapping.oriented(poses), reach=3.0)
    assert {(r["point"], r["pose"]) for r in pairs.collect()} == {(p, q) for p in (1, 2, 3) for q in (1, 2)}
    seen = mapping.seen_pixels(pairs, (400.0, 400.0, 320.0, 240.0), (640, 480), 20)
    front = space.z_buffer(seen, pixel=["pose", "row", "col"], depth="depth", tolerance=0.25)
    assert {(r["point"], r["pose"], r["row"], r["col"]) for r in front.collect()} == {(1, 1, 12, 16), (1, 2, 12, 16)}
    wanted = thermal.surface_for_u(F.lit(1.4), F.lit(21.0), F.lit(5.0), F.lit(7.7))
    written = spark.range(3).select(F.lit(12).cast("long").alias("row"), F.lit(16).cast("long").alias("col"), F.col("id").alias("at"), F.when(F.col("id") == 2, wanted).otherwise(F.lit(0.0)).alias("t"))
    read = mapping.looked_up(front.select("row", "col", "x", "y", "z"), written, pixel=["row", "col"], order="at", payload=["t"])
    cells = mapping.accumulated(read, 0.5, value=F.col("t")).withColumn("u", thermal.u_value(F.col("mean"), F.lit(21.0), F.lit(5.0), F.lit(7.7))).collect()
    assert [(r["i"], r["n"], round(r["u"], 9)) for r in cells] == [(4, 2, 1.4)]
    assert mapping.accumulated(read.limit(0), 0.5, value=F.col("t")).count() == 0


def test_pairs_in_the_plane_zips_and_walls(spark):
    from heliovox.operators import mapping

    left = spark.createDataFrame([(1, 0.99, 0.0), (2, 5.0, 5.0), (3, None, 0.0)], "a long, u double, v double")
    right = spark.createDataFrame([(9, 1.01, 0.0), (8, 0.97, 0.0), (7, 8.0, 5.0)], "b long, p double, q double")
    got = mapping.nearest_in_plane(left, right, left_id="a", right_id="b", at=("u", "v"), other=("p", "q"), reach=0.5).collect()
    assert [(r["a"], r["b"], round(r["distance"], 9)) for r in got] == [(1, 8, 0.02)] or [(r["a"], r["b"]) for r in got] == [(1, 9)]
    walls = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 2, -1.0, 0.0, 0.0, 4.0, 1.0, 0.0), (1, 3, 1.0, 0.0, 0.0, 9.0, 1.0, 0.0), (1, 4, 0.0, 1.0, 0.0, 0.0, 3.0, 0.0), (2, 5, 1.0, 0.0, 0.0, 3.0, 0.0, 0.0)], "s int, w int, nx double, ny double, nz double, x double, y double, z double")
    assert [(r["w"], r["other_id"], r["gap"]) for r in mapping.facing_walls(walls, by="s", wall_id="w", degrees=10.0, least_gap=0.5).collect()] == [(1, 2, 4.0)]
    zipped = mapping.zipped(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)).limit(2), by="g", left_order=["a"], right_order=["b"]).collect()
    assert [(r["ordinal"], r["a"]) for r in sorted(zipped, key=lambda r: r["ordinal"])] == [(1, 1), (2, 2)]


def test_short_segments_go_to_the_nearer_neighbour(spark):
    rows = [(1, n, s, h, l) for n, (s, h, l) in enumerate([(0, 0.0, 5.0), (0, 2.0, 5.0), (1, 80.0, 1.0), (2, 90.0, 9.0), (3, 170.0, 2.0), (4, 185.0, 8.0)])] + [(2, 0, 0, 10.0, 0.5)]
    df = spark.createDataFrame(rows, "who int, at int, segment int, heading double, length double")
    got = {(r["who"], r["at"]): r["segment"] for r in series.merge_short(df, by="who", segment="segment", heading="heading", length="length", least=4.0).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 2, (2, 0): 0}
    assert series.merge_short(df.limit(0), by="who", segment="segment", heading="heading", length="length", least=4.0).count() == 0


def test_model_surfaces_face_outward(spark):
    from heliovox.operators import building

    square = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    rows = [(1, square, 0.0, 0.0, 1.0, 0.5, 0.5, 0.0, 0.5, 0.5, 1.0), (2, [[x, y, 2.0] for x, y, _ in square], 0.0, 0.0, 1.0, 0.5, 0.5, 2.0, 0.5, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "id int, k array<array<double>>, nx double, ny double, nz double, cx double, cy double, cz double, ix double, iy double, iz double")
    out = {r["id"]: r for r in building.model_surfaces(df, corners="k", normal=("nx", "ny", "nz"), centre=("cx", "cy", "cz"), interior=("ix", "iy", "iz")).collect()}
    assert (out[1]["surface_type"], out[1]["boundary"], out[1]["turned"], out[1]["polygon"]) == ("floor", "Ground", True, square[::-1])
    assert (out[2]["surface_type"], out[2]["boundary"], out[2]["turned"]) == ("roof", "Outdoors", False)


def test_nearest_of_many_places_against_brute_force():
    rng = np.random.default_rng(6)
    there = np.vstack([rng.normal(0, 1, (5000, 3)), rng.normal(4, 0.05, (800, 3))])
    counts = rng.integers(1, 3, len(there))
    asked = np.vstack([there[::97], rng.normal(0, 3, (40, 3))])
    got, expected = space._near(asked, there, counts, 6, leaf=200), space._nearest_of(asked, there, counts, 6, True)
    assert all(np.allclose(a, b) for a, b in zip(got, expected))


def test_class_cosines(spark):
    rows = spark.createDataFrame([(1, "a", [2.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [-1.0, 0.0]), (4, "b", None), (5, None, [1.0, 1.0]), (6, "b", [0.0, 0.0])], "cosine long, label string, v array<double>")
    got = {(r[0], r["label"]): round(r[2], 9) for r in space.class_cosines(rows.withColumnRenamed("cosine", "id"), vector="v", label="label", keep=["id"]).collect()}
    half = round(0.5**0.5, 9)
    assert got == {(1, "a"): half, (2, "a"): half, (3, "a"): -half, (1, "b"): -1.0, (2, "b"): 0.0, (3, "b"): 1.0}


def test_stretches_of_bins_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "BIN_BLOCK", 4)
    bins = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 20, 21, 27]
    df = spark.createDataFrame([(float(b) + 0.5,) for b in bins for _ in range(2)] + [(11.5,), (None,)], "v double")
    got = sorted(tuple(r) for r in series.histogram_blocks(df, value="v", width=1.0, least=2).collect())
    assert got == [(0, 10, 11, 22), (13, 13, 1, 2), (20, 21, 2, 4), (27, 27, 1, 2)]
    assert series.histogram_blocks(df.limit(0), value="v", width=1.0, least=2).count() == 0


def test_small_tables_are_broadcast_and_others_are_not(spark):
    from heliovox.session import small

    rows = spark.range(50)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(rows.join(small(spark.range(10), 10), "id")) and "strategy=broadcast" not in plan(rows.join(small(spark.range(11), 10), "id"))


def test_octree_levels_against_their_points(spark):
    from heliovox.operators import lattice

    p = np.random.default_rng(12).uniform(-3, 5, (400, 3))
    df = spark.createDataFrame([tuple(map(float, x)) for x in p], "x double, y double, z double")
    low, high = p.min(axis=0), p.max(axis=0)
    extent = (high - low).max()
    origin = (low + high) / 2 - extent / 2
    got = {r["depth"]: r["nodes"] for r in lattice.level_counts(df, 6).collect()}
    for depth in range(7):
        cells = np.clip(np.floor((p - origin) / (extent / 64)).astype(int), 0, 63) >> (6 - depth)
        assert got[depth] == len(np.unique(cells, axis=0))
    leaves = lattice.octree_cells(df, 6).collect()
    assert len(leaves) == 400 and all(abs(origin[n] + (r[c] + 0.5) * extent / 64 - r[a]) <= extent / 128 + 1e-9 for r in leaves for n, (a, c) in enumerate(zip("xyz", "ijk")))
