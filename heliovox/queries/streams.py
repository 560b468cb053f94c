"""Queries that run tables of events through the streaming operators, to the end of what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliovox.queries.base import EVENTS
from heliovox.session import delete, shared_folder, table
from heliovox.sources import files
from heliovox.streaming import live


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream writes until its source is used up, in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    delete(spark, f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(d, pathGlobFilter="events.parquet", recursiveFileLookup=False)
    # The table's times have no zone; they are taken as UTC.
    return rows.withColumn("at", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))


def _us(c: str):
    return F.unix_micros(c).alias(c)


def tumbling_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of values per hour and type, of a stream of events."""
    s = live.tumbling_stats(_events(spark, d), time="at", value=F.when(F.col("value").between(1, 200), F.col("value")), width="1 hour", late="0 seconds", by=["event_type"])
    out = _drained(s)
    return out.select(_us("start"), "event_type", "n", "n_total", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("min_v", "max_v", "mean_v", "std_v")])


def session_idle(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events of each type, closed by 30 minutes of silence."""
    return _drained(live.bursts(_events(spark, d), time="at", silence="30 minutes", late="0 seconds", by=["event_type"])).select(_us("start"), _us("end"), "event_type", "n")


def latest_value(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "value")
    out = live.latest(rows, key="user_id", time="ts", value="value")
    return out.select("user_id", "value", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))


def classify_every_nth(spark: SparkSession, d: str) -> DataFrame:
    """A class for every fourth event of each user, kept until the next."""
    s = live.every_nth(_events(spark, d), key="user_id", order="event_id", value="value", n=4, classify=lambda v: "high" if v > 50 else "low")
    return _drained(s)


def matched_streams(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and purchases within two minutes of each other."""
    e = _events(spark, d)
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("at").alias("a"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("at").alias("b"))
    return _drained(live.matched(a, b, left_time="a", right_time="b", tolerance_us=120_000_000)).select("click_id", "purchase_id")


def html_table_extract(spark: SparkSession, d: str) -> DataFrame:
    """Hourly values read back from weather pages made of the stations' readings."""
    rows = table(spark, d, "events").select("event_id", "ts", "value")
    cell = F.concat(F.lit("<th scope='row'>"), F.date_format("ts", "dd/MM/yyyy HH"), F.lit("</th><td>1.0</td><td>0</td>\n<td>40</td><td>90</td><td>"), F.round("value", 2).cast("string"), F.lit("</td>"))
    pages = rows.groupBy((F.col("event_id") % 50).alias("page")).agg(F.concat(F.lit("<table><tr>"), F.listagg(cell, F.lit("</tr>\n<tr>")), F.lit("</tr></table>")).alias("html"))
    return files.html_rows(pages).groupBy("utc_us").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (tumbling_stats, session_idle, latest_value, classify_every_nth, matched_streams, html_table_extract)}

# A stream closes a window when its watermark, the greatest time seen, passes the window's end; what is still open is not written.
SQL = {
    "tumbling_stats": f"""with e as (select *, case when value between 1 and 200 then value end v, us // 3600000000 * 3600000000 as s from {EVENTS})
        select s as "start", event_type, count(v) n, count(*) n_total, coalesce(round(min(v), 6), -1.0) min_v, coalesce(round(max(v), 6), -1.0) max_v, coalesce(round(avg(v), 6), -1.0) mean_v, coalesce(round(stddev_pop(v), 6), -1.0) std_v
        from e where s + 3600000000 <= (select max(us) from e) group by 1, 2""",
    "session_idle": f"""with e as (select *, coalesce((us - lag(us) over (partition by event_type order by us) > 1800000000)::int, 1) b from {EVENTS}), g as (select *, sum(b) over (partition by event_type order by us) k from e)
        select min(us) as "start", max(us) + 1800000000 as "end", event_type, count(*) n from g group by event_type, k having max(us) + 1800000000 <= (select max(us) from e)""",
    "latest_value": f"select user_id, arg_max(value, us) as value, max(us) us from {EVENTS} group by 1",
    "classify_every_nth": """with e as (select *, row_number() over (partition by user_id order by event_id) - 1 i from events), c as (select user_id, i // 4 k, case when value > 50 then 'high' else 'low' end result from e where i % 4 = 0)
        select e.user_id, e.event_id, c.result, e.i % 4 = 0 fresh from e join c on c.user_id = e.user_id and c.k = e.i // 4""",
    "matched_streams": f"""with e as {EVENTS} select a.event_id click_id, b.event_id purchase_id from e a join e b on b.us between a.us - 120000000 and a.us + 120000000 where a.event_type = 'click' and b.event_type = 'purchase'""",
    "html_table_extract": f"""select us // 3600000000 * 3600000000 - 3600000000 as utc_us, count(*) n, round(sum(round(value, 2)), 4) total from {EVENTS} group by 1""",
}
