"""Recorded bags: SQLite files of timed messages, read in parallel by ranges of message ids, and decoders of their point payloads."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ODOMETRY = "nav_msgs/msg/Odometry"
POINT_MESSAGES = ("sensor_msgs/msg/PointCloud2", "livox_ros_driver2/msg/CustomMsg")
# Datatype codes of float fields, and the layout of one point of the custom message.
FLOATS = {7: "f4", 8: "f8"}
CUSTOM_STRIDE, CUSTOM_OFFSETS = 20, (4, 8, 12)
# Layouts of the points of a packet by its type (bytes per coordinate, metres per unit), behind a header of 36 bytes.
PACKETS = {1: ("<i4", 14, 1e-3), 2: ("<i2", 8, 1e-2)}
PACKET_HEADER = 36


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.topic, self.payload = options.get("topic"), options.get("payload", "true").lower() == "true"
        self.rows = int(options.get("rowsPerPartition", 2000))

    def _files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".db3"))
        return [self.path]

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self._files():
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                low, high = db.execute("select min(id), max(id) from messages").fetchone()
            if low is not None:
                out += [_Range(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out or [_Range("", 0, -1)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if not part.path:
            return
        data = "m.data" if self.payload else "null"
        sql = f"select m.id, t.name, t.type, m.timestamp, {data} from messages m join topics t on t.id = m.topic_id where m.id between ? and ?" + (" and t.name = ?" if self.topic else "") + " order by m.id"
        with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as db:
            for i, name, kind, stamp, blob in db.execute(sql, (part.low, part.high, *([self.topic] if self.topic else []))):
                yield part.path, i, name, kind, stamp, blob


class BagSource(DataSource):
    """`file, id, topic, type, stamp_ns, data` of a bag file, or of all in a folder.

    Options: path, topic, payload (false leaves `data` null and unread), rowsPerPartition.
    """

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return "file string, id bigint, topic string, type string, stamp_ns bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, *, topic: str | None = None, payload: bool = True) -> DataFrame:
    spark.dataSource.register(BagSource)
    reader = spark.read.format("bag").option("payload", str(payload).lower())
    return (reader.option("topic", topic) if topic else reader).load(path)


def stamps(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Stamps of one topic in microseconds; payloads are never read."""
    return read(spark, path, topic=topic, payload=False).select("id", F.expr("stamp_ns div 1000").alias("us"))


def point_topic(spark: SparkSession, path: str) -> str:
    """The one topic of point messages; an error if there is none or more than one."""
    names = [r[0] for r in read(spark, path, payload=False).where(F.col("type").isin(*POINT_MESSAGES)).select("topic").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"{len(names) or 'no'} topics of point messages; name one")
    return names[0]


class Cdr:
    """Values in order from a CDR buffer; each is aligned to its size, counted from the end of the four bytes of encapsulation."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 4
        self.end = "<" if data[1] & 1 else ">"

    def take(self, code: str) -> int:
        size = struct.calcsize(code)
        self.at += -(self.at - 4) % size
        (value,) = struct.unpack_from(self.end + code, self.data, self.at)
        self.at += size
        return value

    def text(self) -> str:
        n = self.take("I")
        value = self.data[self.at : self.at + max(n - 1, 0)].decode("utf-8", "replace")
        self.at += n
        return value

    def header(self) -> tuple[int, int, str]:
        return self.take("i"), self.take("I"), self.text()


def cloud_points(data: bytes) -> np.ndarray:
    """x, y, z of a point cloud message, by the offsets, types and byte order that it declares; rows that aren't finite are dropped."""
    r = Cdr(data)
    r.header()
    height, width = r.take("I"), r.take("I")
    fields = {}
    for _ in range(r.take("I")):
        name = r.text()
        offset, kind, _count = r.take("I"), r.take("B"), r.take("I")
        fields[name] = (offset, kind)
    order = ">" if r.take("B") else "<"
    step, _row = r.take("I"), r.take("I")
    size = r.take("I")
    if any(fields.get(a, (0, 0))[1] not in FLOATS for a in "xyz"):
        raise ValueError("x, y and z must be float32 or float64")
    kind = np.dtype({"names": list("xyz"), "formats": [order + FLOATS[fields[a][1]] for a in "xyz"], "offsets": [fields[a][0] for a in "xyz"], "itemsize": step})
    return _finite(np.frombuffer(data, kind, min(height * width, size // step), r.at))


def custom_points(data: bytes) -> np.ndarray:
    """x, y, z of the scanner's own message: a header, a time base, the number of points, the scanner, and a sequence of points.

    The sequence has a length of its own; it begins behind three bytes that fill up the scanner's, and its last point may lack its own filling.
    """
    r = Cdr(data)
    r.header()
    for code in "QIB":
        r.take(code)
    length = r.take("I")
    point = np.dtype({"names": list("xyz"), "formats": [r.end + "f4"] * 3, "offsets": CUSTOM_OFFSETS, "itemsize": CUSTOM_STRIDE})
    there = (len(data) - r.at) // CUSTOM_STRIDE
    whole = np.frombuffer(data, point, min(length, there), r.at)
    rest = data[r.at + there * CUSTOM_STRIDE :]
    if there < length and len(rest) >= CUSTOM_OFFSETS[-1] + 4:
        whole = np.append(whole, np.frombuffer(rest.ljust(CUSTOM_STRIDE, b"\0"), point, 1))
    return _finite(whole)


def odometry_pose(data: bytes) -> tuple[int, tuple[float, ...]]:
    """Stamp in ns, and position and rotation (x, y, z, qx, qy, qz, qw), of an odometry message: header, frame of the body, pose."""
    r = Cdr(data)
    seconds, nanos, _frame = r.header()
    r.text()
    return seconds * 1_000_000_000 + nanos, tuple(r.take("d") for _ in range(7))


def poses(messages: DataFrame) -> DataFrame:
    """`file, id, stamp_ns, header_ns, x, y, z, qx, qy, qz, qw` of the odometry messages of a bag; messages of other types give none."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [odometry_pose(bytes(d)) for d in batch["data"]]
            out = batch[["file", "id", "stamp_ns"]].assign(header_ns=[at for at, _ in read])
            for k, name in enumerate(("x", "y", "z", "qx", "qy", "qz", "qw")):
                out[name] = [p[k] for _, p in read]
            yield out

    rows = messages.where((F.col("type") == ODOMETRY) & F.col("data").isNotNull()).select("file", "id", "stamp_ns", "data")
    return rows.mapInPandas(decode, "file string, id bigint, stamp_ns bigint, header_ns bigint, x double, y double, z double, qx double, qy double, qz double, qw double")


def cloud_message(points: np.ndarray, frame: str, stamp_ns: int) -> bytes:
    """A point cloud message of x, y, z as 32-bit floats, little endian."""
    out = bytearray([0, 1, 0, 0])

    def put(code: str, *values: float) -> None:
        for v in values:
            out.extend(b"\0" * (-(len(out) - 4) % struct.calcsize(code)) + struct.pack("<" + code, v))

    def text(value: str) -> None:
        put("I", len(value.encode()) + 1)
        out.extend(value.encode() + b"\0")

    put("i", stamp_ns // 1_000_000_000)
    put("I", stamp_ns % 1_000_000_000)
    text(frame)
    put("I", 1, len(points), 3)
    for n, name in enumerate("xyz"):
        text(name)
        put("I", 4 * n)
        put("B", 7)
        put("I", 1)
    put("B", 0)
    put("I", 12, 12 * len(points), 12 * len(points))
    out.extend(np.ascontiguousarray(points, "<f4").tobytes())
    put("B", 1)
    return bytes(out)


def write_bag(path: str, topic: str, frame: str, points: np.ndarray, stamp_ns: int) -> None:
    """A bag of one point cloud message; an existing file is an error."""
    if os.path.exists(path):
        raise FileExistsError(path)
    with sqlite3.connect(path) as db:
        db.execute("create table topics (id integer primary key, name text not null, type text not null, serialization_format text not null)")
        db.execute("create table messages (id integer primary key, topic_id integer not null, timestamp integer not null, data blob not null)")
        db.execute("insert into topics values (1, ?, ?, 'cdr')", (topic, POINT_MESSAGES[0]))
        db.execute("insert into messages values (1, 1, ?, ?)", (stamp_ns, cloud_message(points, frame, stamp_ns)))


def packet_points(data: bytes) -> np.ndarray | None:
    """x, y, z, reflectivity, tag of a live packet; None for other types and packets that are too short."""
    if len(data) < PACKET_HEADER:
        return None
    (count,), kind = struct.unpack_from("<H", data, 5), data[10]
    if kind not in PACKETS or not count or len(data) < PACKET_HEADER + count * PACKETS[kind][1]:
        return None
    code, stride, metres = PACKETS[kind]
    width = int(code[2:])
    raw = np.frombuffer(data, np.dtype({"names": ["x", "y", "z", "r", "t"], "formats": [code] * 3 + ["u1"] * 2, "offsets": [0, width, 2 * width, 3 * width, 3 * width + 1], "itemsize": stride}), count, PACKET_HEADER)
    return np.column_stack([*[(raw[a] * metres).astype(np.float32).astype(float) for a in "xyz"], raw["r"], raw["t"]])


def _finite(raw: np.ndarray) -> np.ndarray:
    p = np.column_stack([raw[a].astype(float) for a in "xyz"])
    return p[np.isfinite(p).all(axis=1)]


def points(messages: DataFrame, *, stride: int = 1, point_stride: int = 1) -> DataFrame:
    """`file, id, stamp_ns, point, x, y, z` of the point messages of a bag; every `stride`-th by id and of its points every `point_stride`-th.

    `point` is the place in the message before it was thinned out. Messages of other types give no points.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                p = (cloud_points if row.type == POINT_MESSAGES[0] else custom_points)(bytes(row.data))
                keep = np.arange(0, len(p), point_stride)
                yield pd.DataFrame({"file": row.file, "id": row.id, "stamp_ns": row.stamp_ns, "point": keep, "x": p[keep, 0], "y": p[keep, 1], "z": p[keep, 2]})

    rows = messages.where(F.col("type").isin(*POINT_MESSAGES) & F.col("data").isNotNull())
    if stride > 1:
        rows = rows.where(F.pmod(F.col("id") - 1, F.lit(stride)) == 0)
    return rows.mapInPandas(decode, "file string, id bigint, stamp_ns bigint, point bigint, x double, y double, z double")


def packets(rows: DataFrame, *, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Points of live packets, streaming or not: the `keep` columns, `x, y, z, reflectivity, tag`. Unreadable packets give none."""
    names = list(keep)
    kind = dict(rows.dtypes)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                p = packet_points(bytes(row[-1])) if row[-1] is not None else None
                if p is not None:
                    yield pd.DataFrame({**{n: [v] * len(p) for n, v in zip(names, row)}, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "reflectivity": p[:, 3].astype("int16"), "tag": p[:, 4].astype("int16")})

    return rows.select(*names, payload).mapInPandas(decode, ", ".join([f"`{n}` {kind[n]}" for n in names] + ["x double, y double, z double, reflectivity smallint, tag smallint"]))
