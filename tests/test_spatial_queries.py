"""Queries of points in space over small tables of their own."""

from collections import Counter

import duckdb
import numpy as np

from heliovox.operators import mapping as counting
from heliovox.queries import mapping, spatial


def test_ransac_plane_reads_its_table(spark, tmp_path):
    rows = [(n, f"2024-01-01 {7 if n % 4 else n % 24:02}:10:00", n * 37 % 101, "view", float(n * 53 % 97)) for n in range(400)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    found = spatial.ransac_plane(spark, str(tmp_path)).first()
    assert found["n"] == sum(" 07:" in ts for _, ts, *_ in rows) and abs(abs(found["nz"]) - 1) < 1e-6 and abs(abs(found["d"]) - 7) < 1e-6


def _regions(cells, steps):
    """Sets of cells that the steps join."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        region = set(todo)
        while todo:
            c = todo.pop()
            near = {tuple(a + b for a, b in zip(c, s)) for s in steps} & left
            left -= near
            region |= near
            todo += near
        out.append(region)
    return out


def test_components_of_all_points_against_brute_force(spark, tmp_path):
    p = np.random.default_rng(3).normal(0, 0.35, (250, 3))
    rows = [(n, [float(v) for v in x], n % 10) for n, x in enumerate(p)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cells = [tuple(int(v) for v in np.floor(np.float32(x).astype(float) / 0.1)) for x in p]
    regions = _regions(cells, [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    assert len(regions) > 10
    assert sorted(map(tuple, spatial.connected_components(spark, str(tmp_path)).collect())) == sorted((*min(r), len(r)) for r in regions)
    best = min(regions, key=lambda r: (-sum(c in r for c in cells), min(r)))
    assert {tuple(r) for r in spatial.largest_component(spark, str(tmp_path)).select("i", "j", "k").collect()} == best


def test_holes_of_all_events_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(n, f"2024-01-01 {rng.integers(24):02}:00:00", int(rng.integers(30)), float(rng.integers(260))) for n in range(900)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "'view' as event_type", "value / 2.0 as value").write.parquet(f"{tmp_path}/events.parquet")
    from collections import Counter, defaultdict

    values = defaultdict(list)
    for _, ts, user, v in rows:
        values[user, int(ts[11:13])].append(v / 2.0)
    known = {k: min(2, max(int(x // 100) for x in v)) for k, v in values.items() if sum(v) / len(v) > 50}
    high = max(u for u, _ in values) + 1
    expected = Counter((v, False) for v in known.values())
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    for region in _regions([(r, c) for r in range(high) for c in range(24) if (r, c) not in known], steps):
        if not any(r in (0, high - 1) or c in (0, 23) for r, c in region):
            labels = {known[n] for r, c in region for a, b in steps if (n := (r + a, c + b)) in known}
            expected[(labels.pop() if len(labels) == 1 else 18, True)] += len(region)
    assert len({f for _, f in expected}) == 2
    assert {(r["label"], r["filled"]): r["cells"] for r in spatial.enclosed_hole_fill(spark, str(tmp_path)).collect()} == dict(expected)


def test_nearest_revisit_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(n, int(rng.integers(2)), int(rng.integers(2500)), float(rng.normal(0, 2)), float(rng.normal(0, 2))) for n in range(600)]
    rows += [(1000, 7, 0, 0.499, 0.0), (1001, 7, 100, 0.501, 0.0), (1002, 7, 199, 0.502, 0.0), (1003, 7, 50, 0.5, 0.0)]  # across the edge of a cell
    spark.createDataFrame([*rows, (1004, None, 3, 0.0, 0.0), (1005, 7, 300, None, 0.0)], "pose_id long, session_id long, posetum_row_idx int, tx double, ty double").write.parquet(f"{tmp_path}/posetum.parquet")
    expected = {}
    for i, s, at, x, y in rows:
        near = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, b, j) for j, t, b, u, v in rows if t == s and b + 100 <= at]
        near = [m for m in near if m[0] <= 0.5]
        if near:
            expected[i] = min(near)[2]
    got = spatial.revisit_nearest(spark, str(tmp_path)).collect()
    assert len(got) == len(expected) > 100 and {r["pose_id"]: r["earlier_id"] for r in got} == expected


def test_boxes_are_counted_without_testing_every_point(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 40_000), rng.normal(0, 1, 40_000)
    x[:10_000], y[:10_000] = 0.25, 0.5  # a place where many stand
    a = np.radians(rng.choice([0.0, 90.0, 37.5, -12.25, 180.0], 60))
    boxes = np.stack([rng.normal(0, 1, 60).round(1), rng.normal(0, 1, 60).round(1), np.cos(a), np.sin(a), rng.uniform(0.1, 5, 60), rng.uniform(0.1, 5, 60)], axis=1)
    expected, tested, test = [int(counting._in_box(x, y, *b).sum()) for b in boxes], [0], counting._in_box

    def noted(x, *others):
        tested[0] += np.size(x)
        return test(x, *others)

    monkeypatch.setattr(counting, "_in_box", noted)
    assert counting._counts(x, y, boxes).tolist() == expected and tested[0] < 0.1 * len(x) * len(boxes)


def test_poses_in_turned_boxes_against_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    inf, nan = float("inf"), float("nan")
    poses = [(n, float(rng.normal(0, 6)), float(rng.normal(0, 6))) for n in range(3000)] + [(3000 + n, 1.5, -2.5) for n in range(200)]
    poses += [(4000, -4.000000000000001, 0.5), (4001, None, 0.0), (4002, nan, 0.0), (4003, inf, 0.0), (4004, 1e300, 2.0), (4005, 5000.0, 1.0)]
    boxes = [(n, [float(rng.normal(0, 6)), float(rng.normal(0, 6)), 0.0], float(rng.uniform(0.1, 24)), float(rng.uniform(0.1, 8)), float(rng.choice([0.0, 90.0, 30.0, -41.7]))) for n in range(60)]
    boxes += [(100, [9.884, 0.5, 0.0], 27.768, 1e-12, 0.0)]  # its edge rounds to the other side of a cell's
    boxes += [(101, [0.0, 0.0, 0.0], 1e7, 3.0, 20.0), (102, [0.0, 0.0, 0.0], inf, 3.0, 20.0), (103, [0.0, 0.0, 0.0], nan, 3.0, 0.0), (104, [0.0, 0.0, 0.0], nan, nan, 0.0)]
    boxes += [(105, [nan, 0.0, 0.0], 3.0, 3.0, 0.0), (106, [None, 0.0, 0.0], 3.0, 3.0, 0.0), (107, [0.0, 0.0, 0.0], -1.0, 3.0, 0.0), (108, [1e18, 0.0, 0.0], 3.0, 3.0, 0.0), (109, [0.0, 0.0, 0.0], None, 3.0, 0.0)]
    boxes += [(None, [0.0, 0.0, 0.0], 3.0, 3.0, 0.0), (7, [1.0, 1.0, 0.0], 6.0, 6.0, 45.0)]
    spark.createDataFrame(poses, "pose_id long, tx double, ty double").write.parquet(f"{tmp_path}/posetum.parquet")
    spark.createDataFrame(boxes, "plane_uid long, centroid_3d array<double>, width_m double, height_m double, angle_deg double").write.parquet(f"{tmp_path}/planes.parquet")
    db = duckdb.connect()
    for t in ("posetum", "planes"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    expected = Counter(db.sql(f"select plane_uid, poses from ({mapping.SQL['rotated_boxes']})").fetchall())
    got = Counter((r["plane_uid"], r["poses"]) for r in mapping.rotated_boxes(spark, str(tmp_path)).select("plane_uid", "poses").collect())
    assert got == expected and got[100, 1] == 1 and got[104, 3205] == 1
