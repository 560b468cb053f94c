"""The project's own tables, prepared for the operators: clocks of loggers, instants of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliovox.functions import solar
from heliovox.operators import spikes, timestamps
from heliovox.session import small, table

HOME_ZONE = "Europe/Rome"
# Loggers that are broadcast, some ten megabytes.
MOST_LOGGERS = 200_000
# Hourly readings under broken cloud vary by half; minute readings hardly at all.
GHI_RULE = spikes.Rule(sparse=3.5, usual=3.0, up=0.55, down=0.73, floor=0.02)
CAPTURE_RULE = spikes.Rule(slopes=True)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "stations").select(F.col("tz_name").alias("zone"))
    return timestamps.zone_intervals(named.union(spark.range(1).select(F.lit(HOME_ZONE))))


def with_logger_time(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of `legnaro_ghi` with `utc_us`, `step_s`, `lat` and `lon`; texts without a zone are in the logger's own clock."""
    # The 40 stations are fixed; the loggers grow, so they are counted first: up to a number they are broadcast and readings stay where they are, beyond it both are shuffled.
    stations = F.broadcast(table(spark, sf_dir, "stations").select("station_id", "tz_name", "lat", "lon"))
    loggers = small(table(spark, sf_dir, "loggers").select("logger_id", "station_id", "step_s", "clock"), MOST_LOGGERS, lambda some: some.join(stations, "station_id", "left").drop("station_id"))
    rows = rows.drop("station_id").join(loggers, "logger_id", "left")
    return timestamps.normalise(rows, _zones(spark, sf_dir), text="timestamp", received="received_at", zone="tz_name", standard=F.col("clock") == "standard").drop("tz_name", "clock")


def with_home_time(spark: SparkSession, sf_dir: str, rows: DataFrame, text: str, received: str) -> DataFrame:
    rows = rows.withColumn("_home", F.lit(HOME_ZONE))
    return timestamps.normalise(rows, _zones(spark, sf_dir), text=text, received=received, zone="_home").drop("_home")


def _unusual(rows: DataFrame, text: str, pattern: str, only: bool) -> DataFrame:
    return rows.where(F.col(text).isNotNull() & ~timestamps.usual(text, pattern)) if only else rows


def logger_readings(spark: SparkSession, sf_dir: str, only_unusual: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "legnaro_ghi")
    return with_logger_time(spark, sf_dir, _unusual(rows, "timestamp", timestamps.USUAL_STAMP, only_unusual))


def capture_rows(spark: SparkSession, sf_dir: str, only_unusual: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "plane3_capture_window_perez")
    return with_home_time(spark, sf_dir, _unusual(rows, "timestamp", timestamps.USUAL_STAMP, only_unusual), "timestamp", "computed_at")


def manifest_rows(spark: SparkSession, sf_dir: str, only_unusual: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "lidar_depth_assoc_manifest")
    return with_home_time(spark, sf_dir, _unusual(rows, "zed_epoch", timestamps.USUAL_EPOCH, only_unusual), "zed_epoch", "written_at")


def implausible_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`reading_id, field, reason` of implausible irradiance per logger."""
    rows = logger_readings(spark, sf_dir)
    seen = F.when(F.col("utc_us") >= 0, F.col("utc_us"))
    sine = solar.sine_of_elevation(seen, F.col("lat"), F.col("lon"))
    rows = rows.withColumn("_sine", sine)
    flagged = spikes.flag(
        rows,
        source="logger_id",
        row_id="reading_id",
        time_us="utc_us",
        fields={"ghi": F.coalesce(solar.most_possible(F.col("_sine")), F.lit(1.1 * solar.SOLAR_CONSTANT))},
        scale=F.coalesce(solar.clear_sky(F.col("_sine")), F.lit(0.0)),
        rule=GHI_RULE,
        offset=20.0,
        grain_s="grain_s",
        near_us=F.unix_micros("received_at"),
    )
    return spikes.rows_of(flagged, table(spark, sf_dir, "legnaro_ghi"), "logger_id", "reading_id", ["ghi"], lambda some: with_logger_time(spark, sf_dir, some))


def implausible_capture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`row_id, field, reason` of implausible beam and plane irradiance per capture."""
    names = ["dni_w_m2", "poa_effective_w_m2"]
    flagged = spikes.flag(
        capture_rows(spark, sf_dir),
        source="capture_id",
        row_id="row_id",
        time_us="utc_us",
        fields=dict.fromkeys(names, F.lit(1.03 * solar.SOLAR_CONSTANT)),
        rule=CAPTURE_RULE,
        offset=0.0,
        grain_s="grain_s",
        hint=F.col("solar_azimuth_deg"),
        near_us=F.unix_micros("computed_at"),
    )
    return spikes.rows_of(flagged, table(spark, sf_dir, "plane3_capture_window_perez"), "capture_id", "row_id", names, lambda some: with_home_time(spark, sf_dir, some, "timestamp", "computed_at"))
