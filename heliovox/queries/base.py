"""Tables of the star schema in the shapes the operators take: points, stamped readings, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heliovox.session import table


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(n)).cast("double").alias(a) for n, a in enumerate("xyz")], "label")


POINTS = "(select vec_id, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z, label from embeddings)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("us", micros("ts"))


EVENTS = "(select *, epoch_us(ts) us from events)"


def event_points(spark: SparkSession, d: str) -> DataFrame:
    """Events as points: user, value and hour of day."""
    return events(spark, d).select("event_id", "event_type", "value", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), F.hour("ts").cast("double").alias("z"))


EVENT_POINTS = "(select event_id, event_type, value, cast(user_id as double) x, value y, cast(hour(ts) as double) z from events)"
