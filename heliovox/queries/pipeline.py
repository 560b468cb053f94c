"""The pN_ queries of the core's data-preparation operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliovox.operators import regrid, rover, schema_drift
from heliovox.queries import drift_sql, time_sql
from heliovox.session import table

# In the order in which their schemas are compared: `planes` against `planes_notilt`.
PLANE_TABLES = ("planes_notilt", "planes")

def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible irradiance value of the loggers and captures."""
    ghi = rover.implausible_readings(spark, sf_dir).select(F.lit("legnaro_ghi").alias("table_name"), F.col("reading_id").alias("row_id"), F.col("field").alias("field_name"))
    beam = rover.implausible_capture_rows(spark, sf_dir).select(F.lit("plane3_capture_window_perez").alias("table_name"), "row_id", F.col("field").alias("field_name"))
    return ghi.unionByName(beam)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant for every time text that is not in its table's usual form."""
    parts = [
        ("legnaro_ghi", rover.logger_readings(spark, sf_dir, True), "reading_id"),
        ("plane3_capture_window_perez", rover.capture_rows(spark, sf_dir, True), "row_id"),
        ("lidar_depth_assoc_manifest", rover.manifest_rows(spark, sf_dir, True), "row_id"),
    ]
    out = [rows.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "utc_us") for name, rows, key in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time-weighted mean per logger and period, to eight digits."""
    grid = regrid.regrid(rover.logger_readings(spark, sf_dir), source="logger_id", time_us="utc_us", value="ghi", step_s="step_s")
    return grid.withColumns({c: F.round(c, 8) for c in ("mean", "coverage")})


def p3_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods that readings cover, in part at least, with time-weighted means."""
    covered = p3_grid(spark, sf_dir).where("coverage > 0")
    return covered.select("logger_id", "slot_us", "n_readings", "mean", "coverage")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods without a reading between a logger's first and last."""
    return p3_grid(spark, sf_dir).where("n_readings = 0").select("logger_id", "slot_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of schema of a plane export against the export before it."""
    rows = table(spark, sf_dir, "plane_records")
    return schema_drift.changes(rows, series="series_id", file="file_id", at="exported_at", body="body").withColumnRenamed("file", "file_id")


def _plane_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `planes_notilt` and `planes` as records: `family, series_id, exported_at, plane_uid, body`."""
    out = []
    for name in PLANE_TABLES:
        rows = table(spark, sf_dir, name)
        # A column is a field of every record, null or not.
        own = F.struct(*[c for c in rows.columns if c not in ("plane_uid", "series_id", "exported_at")])
        out.append(rows.select(F.lit(name).alias("family"), "series_id", "exported_at", "plane_uid", F.to_json(own, {"ignoreNullFields": "false"}).alias("body")))
    return out[0].unionByName(out[1])


def p4_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planes of `plane_records`, `planes` and `planes_notilt` in one schema; `plane_record_id` or `plane_uid` names the row of its table."""
    records = table(spark, sf_dir, "plane_records").withColumnRenamed("record_id", "plane_record_id").withColumn("_file", F.concat_ws("/", F.lit("records"), "file_id"))
    # The rows of one series and time of a table are one export, a file of that series.
    rows = _plane_tables(spark, sf_dir).withColumn("_file", F.concat_ws("/", "family", "series_id", "exported_at"))
    keep = ["file_id", "plane_record_id", "family", "exported_at", "line_no", "plane_uid"]
    return schema_drift.union_table(records.unionByName(rows, allowMissingColumns=True), series="series_id", file="_file", at="exported_at", body="body", keep=keep).drop("_file")


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of schema of table `planes` against `planes_notilt`."""
    # `id` recurs in every series, so planes are matched by series and id.
    thing = F.format_string("%d%09d", "series_id", F.get_json_object("body", "$.id").cast("int"))
    body = F.concat(F.lit('{"_plane":"'), F.coalesce(thing, F.lit("")), F.lit('",'), F.expr("substring(body, 2)"))
    at = F.when(F.col("family") == PLANE_TABLES[0], 0).otherwise(1)
    rows = _plane_tables(spark, sf_dir).select(F.lit(0).alias("series"), "family", F.timestamp_seconds(at).alias("at"), body.alias("body"))
    return schema_drift.changes(rows, series="series", file="family", at="at", body="body", thing="_plane").withColumnRenamed("file", "table_name")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_grid": p3_grid, "p3_means": p3_means, "p4_found": p4_found, "p4_planes": p4_planes, "p4_tables": p4_tables}
SQL: dict[str, str] = {"p2_found": time_sql.P2, "p3_found": time_sql.P3, "p3_grid": time_sql.P3_GRID, "p3_means": time_sql.P3_MEANS, "p4_found": drift_sql.FOUND, "p4_tables": drift_sql.TABLES}
