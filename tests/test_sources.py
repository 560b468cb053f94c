import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliovox.sources import bag, files
from heliovox.streaming import live


class Writer:
    """Values into a CDR buffer, aligned like the reader expects."""

    def __init__(self, little=True):
        self.end, self.data = "<" if little else ">", bytes([0, 1 if little else 0, 0, 0])

    def put(self, code, value):
        size = struct.calcsize(code)
        self.data += b"\0" * (-(len(self.data) - 4) % size) + struct.pack(self.end + code, value)
        return self

    def text(self, s):
        self.put("I", len(s) + 1)
        self.data += s.encode() + b"\0"
        return self


def cloud(points, little=True, double=False):
    w = Writer(little).put("i", 5).put("I", 6).text("map").put("I", 1).put("I", len(points)).put("I", 4)
    size, code = (8, 8) if double else (4, 7)
    for n, name in enumerate(["i", "x", "y", "z"]):
        w.text(name).put("I", 4 * n if not double else 8 * n).put("B", code).put("I", 1)
    step = size * 4
    w.put("B", 0 if little else 1).put("I", step).put("I", step * len(points)).put("I", step * len(points))
    kind = ("<" if little else ">") + ("f8" if double else "f4")
    w.data += np.column_stack([np.zeros(len(points)), points]).astype(kind).tobytes()
    return w.put("B", 1).data


def custom(points):
    w = Writer().put("i", 5).put("I", 6).text("livox").put("Q", 1).put("I", len(points)).put("B", 3)
    w.data += b"\0\0\0"
    w.put("I", len(points))
    body = b"".join(struct.pack("<IfffBBBB", 0, *p, 9, 0, 0, 0) for p in points)
    return w.data + body[:-1]


@pytest.fixture
def bag_file(tmp_path):
    path = tmp_path / "x.db3"
    with sqlite3.connect(path) as db:
        db.execute("create table topics (id integer primary key, name text, type text)")
        db.execute("create table messages (id integer primary key, topic_id integer, timestamp integer, data blob)")
        db.executemany("insert into topics values (?, ?, ?)", [(1, "/points", bag.POINT_MESSAGES[0]), (2, "/imu", "sensor_msgs/msg/Imu")])
        p = np.array([[1, 2, 3], [4, 5, np.nan], [7, 8, 9]], float)
        for i in range(1, 6):
            db.execute("insert into messages values (?, 1, ?, ?)", (2 * i, i * 10**9 + 5, cloud(p + i, little=i % 2 == 0, double=i == 3)))
            db.execute("insert into messages values (?, 2, ?, x'00')", (2 * i + 1, i * 10**9))
    return str(path)


def test_bag_round_trip(spark, bag_file):
    assert bag.point_topic(spark, bag_file) == "/points"
    rows = bag.points(bag.read(spark, bag_file, topic="/points")).orderBy("id", "point").collect()
    assert [(r["id"], r["point"], r["x"], r["z"]) for r in rows] == [(2 * i, k, v + i, v + 2 + i) for i in range(1, 6) for k, v in ((0, 1.0), (1, 7.0))]
    assert [r["us"] for r in bag.stamps(spark, bag_file, "/points").orderBy("id").collect()] == [i * 10**6 for i in range(1, 6)]
    assert bag.read(spark, bag_file, payload=False).where("data is not null").count() == 0


def test_custom_message_without_its_last_padding():
    p = [(1.0, 2.0, 3.0), (float("inf"), 0.0, 0.0), (4.0, 5.0, 6.0)]
    assert bag.custom_points(custom(p)).tolist() == [[1, 2, 3], [4, 5, 6]]


def test_packets(spark):
    def packet(kind, points):
        code, stride, _ = bag.PACKETS[kind]
        head = struct.pack("<B4H3B12xI8s", 0, 0, 0, len(points), 0, 0, kind, 0, 0, b"")
        return head + b"".join(struct.pack("<3" + {"<i4": "i", "<i2": "h"}[code] + "BB", *p, 7, 1) for p in points)

    good = [(1, packet(1, [(1000, -2000, 3000)])), (2, packet(2, [(100, 200, -300), (1, 2, 3)])), (3, b"short"), (4, None), (5, packet(1, [(1, 2, 3)])[:-1]), (6, packet(1, []))]
    bad = (7, packet(1, [(1, 2, 3)])[:10] + b"\x09" + packet(1, [(1, 2, 3)])[11:])
    out = bag.packets(spark.createDataFrame([*good, bad], "i int, payload binary"), keep=["i"]).orderBy("i", "x").collect()
    assert [(r["i"], round(r["x"], 3), round(r["z"], 3), r["reflectivity"]) for r in out] == [(1, 1.0, 3.0, 7), (2, 0.01, 0.03, 7), (2, 1.0, -3.0, 7)]


def test_text_clouds_maps_tables_and_manifests(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("# .PCD\nDATA ascii\n1 2 3 0.5\n4 5 6\nbroken line x\nnan 1 2\n\n")
    assert sorted((r["x"], r["intensity"]) for r in files.pcd_ascii(spark, str(tmp_path / "a.pcd")).collect()) == [(1.0, 0.5), (4.0, None)]
    np.save(tmp_path / "m.npy", np.array([[1.0, np.nan], [3.0, 4.0]]))
    (tmp_path / "m.csv").write_text("1,\n3,4\n")
    for name in ("m.npy", "m.csv"):
        assert sorted((r["row"], r["col"], r["value"]) for r in files.raster(spark, str(tmp_path / name)).collect()) == [(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    (tmp_path / "t.csv").write_text("material,emissivity\nbrick,0.9\n")
    assert files.table(spark, str(tmp_path / "t.csv"), ["material"]).first()["emissivity"] == 0.9
    with pytest.raises(ValueError, match="notes"):
        files.table(spark, str(tmp_path / "t.csv"), ["material", "notes"])
    (tmp_path / "s.json").write_text('{"triplets": [{"a": 1}, {"a": 2}, {"a": 3}, {"a": 4}, {"a": 5}]}')
    assert [r["a"] for r in files.manifest(spark, str(tmp_path / "s.json"), "triplets", every=2, limit=2).collect()] == [1, 3]


def test_las(spark, tmp_path):
    head = bytearray(227)
    head[96:100], head[104], head[105:107], head[107:111] = (227).to_bytes(4, "little"), 0, (20).to_bytes(2, "little"), (3).to_bytes(4, "little")
    head[131:155], head[155:179] = struct.pack("<3d", 0.01, 0.01, 0.01), struct.pack("<3d", 10, 20, 30)
    body = b"".join(struct.pack("<iii", 100 * i, 200, 300) + bytes([0, 0, 0, 2 + (i == 2)]) + b"\0" * 4 for i in range(3))
    (tmp_path / "c.las").write_bytes(bytes(head) + body)
    rows = files.las(spark, str(tmp_path / "c.las")).orderBy("point").collect()
    assert [(r["x"], r["y"], r["label"]) for r in rows] == [(10.0, 22.0, 2), (11.0, 22.0, 2), (12.0, 22.0, 3)]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(2.00049, 1.0, 0.0, 5.0), (1.0, 1.0, 0.0, None), (3.0, 0.0, 1.0, 9.0)], "x double, y double, z double, t double")
    files.write_csv(p, str(tmp_path / "csv"), order=["x"])
    assert [r["x"] for r in spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True).orderBy("x").collect()] == [1.0, 2.0, 3.0]
    files.write_ply(files.coloured(p, "t"), str(tmp_path / "ply"), colours=True)
    assert "element vertex 3" in {r[0] for r in spark.read.text(str(tmp_path / "ply/head")).collect()}
    assert "3.000000 0.000000 1.000000 255 0 0" in {r[0] for r in spark.read.text(str(tmp_path / "ply/body")).collect()}
    files.documents(p, str(tmp_path / "json"), schema="cloud/v1", made_by="test")
    assert spark.read.json(str(tmp_path / "json")).where("schema = 'cloud/v1' and generated_by = 'test'").count() == 3


def test_weather_page(spark):
    page = "<tr><th scope='row'>01/07/2024 13</th><td>25</td><td>0</td><td>40</td><td>90</td><td>812.5</td></tr><tr><th>99/99/2024 13</th><td>1</td><td>1</td><td>1</td><td>1</td><td>5</td></tr>"
    rows = files.html_rows(spark.createDataFrame([(page,), (None,), ("",)], "html string")).collect()
    assert [(r["utc_us"], r["value"]) for r in rows] == [(1719835200000000, 812.5)]


def test_range_window_and_latest(spark):
    p = spark.createDataFrame([(1.0, 0.0, 0.0), (1.0, 5.0, 0.0), (-1.0, 0.0, 0.0), (50.0, 0.0, 0.0)], "x double, y double, z double")
    assert [r[0] for r in p.select(live.range_in_window(20, 0.1, 10)).collect()] == [1.0, None, None, None]
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in live.latest(rows, key="k", time="t", value="v").collect()} == {(1, "c"), (2, "d")}
    assert rows.where(F.lit(False)).count() == 0


def odometry(stamp, position, rotation):
    w = Writer().put("i", stamp).put("I", 7).text("odom").text("base_link")
    for v in (*position, *rotation):
        w.put("d", v)
    return w.data + b"\0" * 288


def test_poses_of_a_bag(spark, tmp_path):
    path = tmp_path / "p.db3"
    with sqlite3.connect(path) as db:
        db.execute("create table topics (id integer primary key, name text, type text)")
        db.execute("create table messages (id integer primary key, topic_id integer, timestamp integer, data blob)")
        db.executemany("insert into topics values (?, ?, ?)", [(1, "/odom", bag.ODOMETRY), (2, "/imu", "sensor_msgs/msg/Imu")])
        for i in range(1, 4):
            db.execute("insert into messages values (?, 1, ?, ?)", (i, i * 10**9, odometry(i, (i, 2.5, -1.0), (0.0, 0.0, 0.6, 0.8))))
        db.execute("insert into messages values (9, 2, 5, x'00')")
    rows = bag.poses(bag.read(spark, str(path))).orderBy("id").collect()
    assert [(r["id"], r["header_ns"], r["x"], r["y"], r["z"], r["qz"], r["qw"]) for r in rows] == [(i, i * 10**9 + 7, float(i), 2.5, -1.0, 0.6, 0.8) for i in range(1, 4)]


def test_bag_that_was_written(spark, tmp_path):
    path, p = str(tmp_path / "w.db3"), np.array([[1.5, 2.0, -3.0], [0.25, 0.0, 9.0]])
    bag.write_bag(path, "/cloud", "map", p, 12_000_000_345)
    rows = bag.points(bag.read(spark, path)).orderBy("point").collect()
    assert [[r["x"], r["y"], r["z"]] for r in rows] == p.tolist() and rows[0]["stamp_ns"] == 12_000_000_345
    with pytest.raises(FileExistsError):
        bag.write_bag(path, "/cloud", "map", p, 0)


def test_more_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1.0, 2.0, 3.0, 7.0), (4.0, 5.0, 6.0, None), (None, 1.0, 1.0, 1.0)], "x double, y double, z double, intensity double")
    assert files.write_ply_binary(p, str(tmp_path / "c.ply")) == 2
    raw = (tmp_path / "c.ply").read_bytes()
    head, body = raw.split(b"end_header\n")
    assert b"element vertex          2\n" in head and sorted(np.frombuffer(body, "<f4").reshape(-1, 3).tolist()) == [[1, 2, 3], [4, 5, 6]]
    files.write_pcd(p.where("x is not null"), str(tmp_path / "pcd"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "pcd/body")).collect()) == ["1.000000 2.000000 3.000000 7.000000", "4.000000 5.000000 6.000000 0.000000"]
    assert any(r[0] == "POINTS 2" for r in spark.read.text(str(tmp_path / "pcd/head")).collect())
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 2, 2.25), ("a", 1, 1, None), ("b", 0, 1, 3.0)], "file string, row int, col int, value double")
    assert {(r["file"], r["row"], r["line"]) for r in files.map_lines(cells, file="file", cols=3).collect()} == {("a", 0, "1.000,,2.250"), ("a", 1, ",,"), ("b", 0, ",3.000,")}
    files.write_map(cells, str(tmp_path / "maps"), file="file", cols=3)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "maps/file=a")).collect()) == [",,", "1.000,,2.250"]
    files.write_bundle(p, str(tmp_path / "bundle"), voxel=0.5, name="scan")
    columns, scalars = files.bundle(spark, str(tmp_path / "bundle"))
    assert columns.count() == 3 and scalars == {"voxel": 0.5, "name": "scan"}


def test_image_folder(spark, tmp_path):
    for name in ("IMG_10.jpg", "IMG_9.jpg", "cover.jpg"):
        (tmp_path / name).write_bytes(b"x" * 3)
    rows = files.image_folder(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in rows] == ["IMG_9.jpg", "IMG_10.jpg", "cover.jpg"] and {r["length"] for r in rows} == {3}


def test_datagrams_until_silence(spark, tmp_path):
    import socket
    import threading
    import time

    spark.dataSource.register(live.UdpSource)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    query = spark.readStream.format("udp").option("port", str(port)).load().writeStream.format("memory").queryName("datagrams").option("checkpointLocation", str(tmp_path / "c")).start()

    def send():
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for n in range(40):
                s.sendto(b"p%d" % n, ("127.0.0.1", port))
                time.sleep(0.1)

    sender = threading.Thread(target=send)
    sender.start()
    live.stop_when_idle(query, 8.0)
    sender.join()
    got = [bytes(r["payload"]) for r in spark.sql("select payload from datagrams").collect()]
    assert not query.isActive and len(got) > 5 and len(got) == len(set(got))


def test_las_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LAS_RANGE", 7)
    head = bytearray(227)
    head[96:100], head[104], head[105:107], head[107:111] = (227).to_bytes(4, "little"), 0, (20).to_bytes(2, "little"), (30).to_bytes(4, "little")
    head[131:155], head[155:179] = struct.pack("<3d", 1, 1, 1), struct.pack("<3d", 0, 0, 0)
    body = b"".join(struct.pack("<iii", i, 2 * i, 0) + bytes([0, 0, 0, 5]) + b"\0" * 4 for i in range(30))
    (tmp_path / "one.las").write_bytes(bytes(head) + body)
    rows = files.las(spark, str(tmp_path)).orderBy("point").collect()
    assert [(r["point"], r["x"], r["y"], r["label"]) for r in rows] == [(i, float(i), 2.0 * i, 0) for i in range(30)]
