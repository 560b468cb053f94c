"""Streams: windows of fixed length, bursts between silences, the latest value, sampled classification, matching of two clocks.

All are plain DataFrame functions that also run on batches, apart from `every_nth`, which keeps a counter per key.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator
from time import monotonic, sleep, time_ns

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from heliovox.functions import geometry as g


def tumbling_stats(points: DataFrame, *, time: str, value: Column, width: str = "500 milliseconds", late: str = "2 seconds", by: list[str] | None = None) -> DataFrame:
    """`start, end, n, n_total, min_v, max_v, mean_v, std_v` per window; null values count in n_total only. Rows later than `late` are dropped."""
    rows = points.withColumn("_v", value)
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    v = F.col("_v")
    out = rows.groupBy(F.window(time, width).alias("w"), *(by or [])).agg(F.count(v).alias("n"), F.count("*").alias("n_total"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.avg(v).alias("mean_v"), F.stddev_pop(v).alias("std_v"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "n_total", "min_v", "max_v", "mean_v", "std_v")


def range_in_window(half_deg: float, least: float, most: float) -> Column:
    """Range of a point (x, y, z) straight ahead, null outside the angle or the range limits."""
    p = [F.col(a).cast("double") for a in "xyz"]
    r = g.norm(p)
    return F.when(g.angular_window(p, half_deg) & (F.col("x") > 0) & r.between(least, most), r)


def bursts(rows: DataFrame, *, time: str, silence: str = "3 seconds", late: str = "10 seconds", by: list[str] | None = None) -> DataFrame:
    """`start, end, n`: stretches of rows without a silence between them; a burst closes when the silence has passed."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = rows.groupBy(F.session_window(time, silence).alias("s"), *(by or [])).agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *(by or []), "n")


def latest(rows: DataFrame, *, key: str, time: str, value: str) -> DataFrame:
    """`key, value, time` of the newest row of each key; of rows at the same time the greatest value. Streams are written in update mode."""
    return rows.groupBy(key).agg(F.max(F.struct(F.col(time), F.col(value))).alias("m")).select(key, F.col("m")[value].alias(value), F.col("m")[time].alias(time))


def matched(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, tolerance_us: int = 50_000, late: str = "5 seconds") -> DataFrame:
    """Pairs of rows of two streams whose times lie within the tolerance; both sides are kept no longer than it and `late` ask for.

    An equi-join on bins as wide as the tolerance: a left row stands in its own and both neighbouring bins. Batches take the nearest
    by `timejoin.nearest`.
    """
    a = left.withWatermark(left_time, late) if left.isStreaming else left
    b = right.withWatermark(right_time, late) if right.isStreaming else right
    own = lambda t: F.expr(f"cast(floor(unix_micros({t}) / {tolerance_us}) as bigint)")
    a = a.withColumn("_bin", F.explode(F.sequence(own(left_time) - 1, own(left_time) + 1)))
    b = b.withColumn("_own", own(right_time))
    t = F.expr(f"make_dt_interval(0, 0, 0, {tolerance_us} / 1e6BD)")
    near = (F.col(right_time) >= F.col(left_time) - t) & (F.col(right_time) <= F.col(left_time) + t)
    return a.join(b, (F.col("_bin") == F.col("_own")) & near).drop("_bin", "_own")


def every_nth(rows: DataFrame, *, key: str, order: str, value: str, n: int, classify) -> DataFrame:
    """`key, order, result, fresh`: `classify(value)` of every n-th row of each key, repeated for those between.

    A stream keeps a counter and the last result per key; rows of one micro-batch are taken by `order`.
    """
    kind = dict(rows.dtypes)
    schema = f"`{key}` {kind[key]}, `{order}` {kind[order]}, result string, fresh boolean"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, None)
        frame = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, v in zip(frame[order], frame[value]):
            fresh = count % n == 0
            last = str(classify(v)) if fresh else last
            count += 1
            out.append((k[0], at, last, fresh))
        state.update((count, last))
        yield pd.DataFrame(out, columns=[key, order, "result", "fresh"])

    d = rows.select(key, order, value)
    return d.groupBy(key).applyInPandasWithState(run, schema, "count bigint, last string", "append", "NoTimeout")


def replay(spark, path: str, schema: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Recorded files as a stream, a few per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class UdpSource(DataSource):
    """`received_us, payload`: datagrams of a port, as a stream. Options: host, port, silence (seconds without any that end a batch), most (datagrams of a batch).

    Datagrams that have been read are kept until their batch is committed, so a batch can be given again.
    """

    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return "received_us bigint, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Datagrams(self.options)


class _Datagrams(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.silence, self.most = float(options.get("silence", "0.2")), int(options.get("most", "10000"))
        self.held: list[tuple[int, tuple]] = []
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((options.get("host", "127.0.0.1"), int(options["port"])))
        self.socket.settimeout(self.silence)

    def __getstate__(self) -> dict:
        # Datagrams are taken in where the stream is planned; the port doesn't travel.
        return {**self.__dict__, "socket": None}

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = []
        while len(rows) < self.most:
            try:
                rows.append((time_ns() // 1000, self.socket.recv(65_535)))
            except TimeoutError:
                break
        first = start["seen"]
        self.held += [(first + n, r) for n, r in enumerate(rows)]
        return iter(rows), {"seen": first + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for n, r in self.held if start["seen"] <= n < end["seen"]])

    def commit(self, end: dict) -> None:
        self.held = [(n, r) for n, r in self.held if n >= end["seen"]]


def stop_when_idle(query, seconds: float, poll: float = 0.5) -> None:
    """Waits until a streaming query has taken in nothing for so long, then stops it."""
    since, before = monotonic(), -1
    while query.isActive:
        batches = [p for p in query.recentProgress if p["numInputRows"] > 0]
        last = batches[-1]["batchId"] if batches else -1
        if last != before:
            since, before = monotonic(), last
        elif monotonic() - since >= seconds:
            query.stop()
            return
        sleep(poll)


def count_windows(rows: DataFrame, *, ordinal: str, size: int, by: list[str], aggregates: list[Column]) -> DataFrame:
    """`by, window, ...`: aggregates of every `size` rows in succession by their ordinal, which counts from 0; streaming or not."""
    return rows.groupBy(*by, F.floor(F.col(ordinal) / size).alias("window")).agg(*aggregates)
