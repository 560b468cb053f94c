"""Queries on streams in time, on series, and on the physics of surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliovox.functions import thermal
from heliovox.operators import series, timejoin, vote
from heliovox.queries.base import EVENTS, events
from heliovox.session import table

R = lambda c, n=6: (F.round(c, n) + F.lit(0.0)).alias(c)


def _kind(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind)


def nearest_time_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Every view with the nearest click and purchase, and whether either is far."""
    left = _kind(spark, d, "view").select("event_id", "us")
    out = left
    for name in ("click", "purchase"):
        right = _kind(spark, d, name).select("us", F.col("event_id").alias("id"))
        out = timejoin.nearest(out, right, time="us", payload=["id"], offset_us=1000).withColumns({f"{name}_id": F.col("nearest.id"), f"{name}_us": F.col("delta_us")}).drop("nearest", "delta_us")
    far = (F.abs("click_us") > 600_000_000) | (F.abs("purchase_us") > 600_000_000)
    return out.select("event_id", "click_id", "click_us", "purchase_id", "purchase_us", F.when(far, "low_confidence").otherwise("ok").alias("status"))


def nearest_time_tolerance(spark: SparkSession, d: str) -> DataFrame:
    left, right = _kind(spark, d, "error").select("event_id", "us"), _kind(spark, d, "signup").select("us", F.col("event_id").alias("id"))
    out = timejoin.nearest(left, right, time="us", payload=["id"], tolerance_us=300_000_000)
    return out.where("nearest is not null").select("event_id", F.col("nearest.id").alias("signup_id"), "delta_us")


def interpolate_onto_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = _kind(spark, d, "view").select("event_id", "us")
    samples = _kind(spark, d, "purchase").select("us", "value")
    return timejoin.interpolated(grid, samples, time="us", value="value").select("event_id", F.coalesce(F.round("value", 6), F.lit(-1.0)).alias("value"))


def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    purchases = _kind(spark, d, "purchase").select(F.col("event_id").alias("window_id"), F.col("us").alias("a"), (F.col("us") + 1_800_000_000).alias("b"))
    hits = timejoin.contained(events(spark, d).select("event_id", "us", "value"), purchases, time="us", start="a", end="b")
    return hits.groupBy("window_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def rate_stats(spark: SparkSession, d: str) -> DataFrame:
    out = series.rate_stats(events(spark, d), by=["event_type"], time="us")
    return out.select("event_type", "n", *[R(c) for c in ("span_s", "rate_hz", "median_hz", "jitter_ms", "max_gap_s")], "gaps", "missing")


def rate_verdict(spark: SparkSession, d: str) -> DataFrame:
    out = series.rate_stats(events(spark, d), by=["user_id"], time="us")
    return out.select("user_id", "n", series.verdict(F.col("rate_hz"), 1 / 39000, 0.1).alias("verdict"))


def mad_segmentation(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_type", "us", "value")
    limits = series.median_and_mad(rows, by=["event_type"], value="value")
    return series.segments(rows.join(limits, "event_type"), by=["event_type"], order="us", value="value", threshold=F.col("median") + 1.5 * F.col("mad"), least_move=2, least_rest=10)


def value_runs(spark: SparkSession, d: str) -> DataFrame:
    return series.runs(events(spark, d), by=["event_type"], order="us", flag=F.col("value") > 60).where("length > 3")


def first_divergence_cut(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", "us", "value")
    cut = series.until_divergence(rows, by=["user_id"], order="us", time="us", position=["value"], most_speed=0.05, most_step=150.0)
    return cut.groupBy("user_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_id"))


def rolling_turn_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", "us", "value")
    return series.rolling_sum(rows, by=["user_id"], order="us", value="value", reach=2).select("event_id", F.round("rolling", 6).alias("rolling"))


def rolling_heading(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", "us", (F.col("value") % 90).alias("deg"))
    return series.rolling_circular_mean(rows, by=["user_id"], order="us", degrees="deg", reach=3).select("event_id", F.round("smooth", 5).alias("smooth"))


def gap_fill_linear(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", "us", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return series.fill_linear(rows, by=["user_id"], order="us", value="value").select("event_id", F.round("value", 5).alias("value"))


def reintegrate(spark: SparkSession, d: str) -> DataFrame:
    turn = F.radians(F.col("user_id") % 360)
    rows = events(spark, d).select("user_id", "event_id", "us", "value")
    return series.reintegrated(rows, by=["user_id"], order="us", step={"px": F.col("value") * F.cos(turn), "py": F.col("value") * F.sin(turn)}).select("event_id", R("px", 4), R("py", 4))


def jaccard_consecutive(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select((F.expr("us div 86400000000")).alias("day"), "user_id")
    return series.set_distance(rows, seq="day", cell=["user_id"]).withColumn("distance", F.round("distance", 6))


def gap_clusters_1d(spark: SparkSession, d: str) -> DataFrame:
    return series.gap_clusters(table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 10), by=["k"], value="o_totalprice", most_gap=1500.0, least=5).select("k", "cluster", "n", R("low"), R("high"))


def histogram_blocks(spark: SparkSession, d: str) -> DataFrame:
    return series.histogram_blocks(table(spark, d, "events"), value="value", width=5.0, least=3)


def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("w"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return series.weighted_median(rows, by=["o_orderpriority"], value="o_totalprice", weight="w", tie="o_orderkey")


def weighted_mean_correction(spark: SparkSession, d: str) -> DataFrame:
    out = series.weighted_mean(table(spark, d, "lineitem"), by=["l_suppkey"], value=F.col("l_discount"), weight=F.col("l_quantity"))
    return out.select("l_suppkey", F.round("mean", 6).alias("correction"))


def keyframe_select(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "us", "value", (F.hour("ts") * 15.0).alias("heading"))
    out = series.keyframes(rows, by="user_id", order="us", position=["value"], heading="heading", least_step=60.0, least_turn=90.0)
    return out.where("keyframe = 1").select("user_id", "us")


def heading_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "us", (F.hour("ts") * 15.0).alias("heading"), "value")
    out = series.heading_segments(rows, by="user_id", order="us", heading="heading", length="value", limit=60.0, least_length=5.0)
    out = series.merge_short(out, by="user_id", segment="segment", heading="heading", length="value", least=120.0)
    return out.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


def median_consensus_spread(spark: SparkSession, d: str) -> DataFrame:
    """Median of the values of a pixel over frames, where they agree within a tolerance."""
    rows = events(spark, d).select("user_id", F.expr("us div 86400000000").alias("day"), "value")
    out = rows.groupBy("user_id", "day").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"), F.percentile("value", F.lit(0.5)).alias("m"))
    return out.select("user_id", "day", "n", F.coalesce(F.when(F.col("spread") <= 80.0, F.round("m", 6)), F.lit(-1.0)).alias("consensus"))


def transmittance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax").distinct()
    t = thermal.transmittance(F.col("l_quantity") - 3, F.col("l_discount") * 1000, F.col("l_tax") * 400)
    return rows.select((F.col("l_quantity") + F.lit(0.0)).alias("l_quantity"), R("l_discount"), R("l_tax"), F.coalesce(F.round(t, 6), F.lit(-1.0)).alias("tau"))


def true_temperature(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_tax")
    t = thermal.true_temperature(F.col("l_quantity"), 0.7 + F.col("l_tax"), 0.8 + F.col("l_discount"), F.lit(20.0), F.lit(22.0))
    return rows.groupBy("l_suppkey").agg(F.round(F.avg(t), 4).alias("mean_c"), F.round(F.min(t), 4).alias("min_c"), F.count(t).alias("n"))


def plausible_candidate_retry(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier the first of ranked emissivities with which at least 99 percent of the temperatures are plausible."""
    tries = spark.createDataFrame([(0, "steel", 0.25), (1, "glass", 0.6), (2, "brick", 0.93)], "rank int, material string, eps double")
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity").crossJoin(F.broadcast(tries))  # three candidates
    t = thermal.true_temperature(F.col("l_quantity"), F.col("eps"), F.lit(0.95), F.lit(20.0), F.lit(22.0))
    per = rows.groupBy("l_suppkey", "rank", "material").agg(F.avg(F.coalesce(t.between(-20, 80), F.lit(False)).cast("double")).alias("share"))
    return vote.first_passing(per, "l_suppkey", "rank", F.col("share") >= 0.99, ["material"])


def u_value_flags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    kind = thermal.surface_type((F.col("p_size") % 7).cast("double"), (F.col("p_size") % 5).cast("double"), 1.0)
    p = p.withColumn("surface", kind).withColumn("ts", F.col("p_retailprice") / 50)
    u = thermal.u_value(F.col("ts"), F.lit(21.0), F.lit(5.0), thermal.film_coefficient(F.col("surface")))
    mark = thermal.flag(F.col("ts"), F.lit(21.0), F.lit(5.0), F.col("p_type"), ["ECONOMY"], ["SMALL"])
    return p.select("p_partkey", "surface", F.round(u, 6).alias("u"), mark.alias("flag"))


def sol_air_u(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "plane3_capture_window_perez").select("row_id", "ghi_w_m2", "dhi_w_m2")
    sa = thermal.sol_air(F.lit(5.0), F.lit(0.6), F.col("ghi_w_m2"), F.lit(25.0), F.lit(3.9))
    u = thermal.u_value_sol_air(F.lit(18.0), F.lit(21.0), sa, F.lit(7.7))
    return rows.select("row_id", F.coalesce(F.round(sa, 4), F.lit(-999.0)).alias("sol_air"), F.coalesce(F.round(u, 3), F.lit(-999.0)).alias("u"))


def insolation(spark: SparkSession, d: str) -> DataFrame:
    """Effective irradiance per capture: sum over minutes, and the greatest."""
    rows = table(spark, d, "plane3_capture_window_perez").where("poa_direct_w_m2 is not null")
    poa = thermal.plane_of_array(F.col("poa_direct_w_m2"), F.col("poa_diffuse_w_m2"), F.col("iam"))
    return rows.groupBy("capture_id").agg(F.round(F.sum(poa) / 60, 3).alias("wh_m2"), F.round(F.max(poa), 4).alias("peak"), F.count(poa).alias("n"))


def material_dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    dim = spark.createDataFrame([("ECONOMY", 0.92, 0.6), ("SMALL", 0.3, 0.2), ("STANDARD", 0.85, 0.7), ("PROMO", 0.95, 0.5)], "p_type string, eps double, alpha double")
    out = table(spark, d, "part").join(F.broadcast(dim), "p_type", "left")  # a vocabulary of materials
    return out.groupBy("p_type").agg(F.count("*").alias("n"), F.max(F.coalesce("eps", F.lit(-1.0))).alias("eps"), F.max(F.coalesce("alpha", F.lit(-1.0))).alias("alpha"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = rows.groupBy("l_suppkey", "p_type").agg(F.sum("l_quantity").alias("q"))
    total = rows.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("t"))
    return counts.join(total, "l_suppkey").select("l_suppkey", "p_type", (F.col("q") / F.col("t")).alias("share"), (F.col("l_suppkey") % 3).alias("zone"))


def zone_restrict_renormalise(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([(0, "ECONOMY"), (0, "SMALL"), (1, "PROMO"), (1, "LARGE")], "zone long, p_type string")
    return vote.restrict(_ranked(spark, d), "l_suppkey", "p_type", "share", allowed, "zone").select("l_suppkey", "p_type", F.round("share", 6).alias("share"))


def low_eps_gate(spark: SparkSession, d: str) -> DataFrame:
    out = vote.gate(_ranked(spark, d), "l_suppkey", "p_type", "share", F.col("p_type").isin("ECONOMY", "SMALL"), least=0.25, threshold=0.15)
    return out.select("l_suppkey", "p_type", F.round("share", 6).alias("share"), "gated")


def name_time_parse(spark: SparkSession, d: str) -> DataFrame:
    """Index and second of frames, from their file names and epochs."""
    rows = table(spark, d, "zed_frames").select("frame_id", "zed_file", "zed_epoch")
    number = F.regexp_extract("zed_file", r"_R?(\d+)\.\w+$", 1).try_cast("int")
    return rows.select("frame_id", F.coalesce(number, F.lit(-1)).alias("frame_no"), F.coalesce(F.floor("zed_epoch").cast("bigint"), (number / 10).cast("bigint")).alias("second"))


def frame_rate_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Measured frame rate of a session, and the offset that its last frame would have at that rate."""
    g = table(spark, d, "zed_frames").where("zed_epoch is not null").groupBy("session_id").agg(F.count("*").alias("n"), (F.max("zed_epoch") - F.min("zed_epoch")).alias("s"))
    fps = F.try_divide(F.col("n") - 1, F.col("s"))
    return g.where("n > 1").select("session_id", "n", F.round(fps, 3).alias("fps"), F.round(F.try_divide(F.col("n") - 1, fps), 2).alias("last_offset_s"))


QUERIES = {
    f.__name__: f
    for f in (
        nearest_time_triplets, nearest_time_tolerance, interpolate_onto_grid, interval_containment, rate_stats, rate_verdict, mad_segmentation, value_runs, first_divergence_cut, rolling_turn_sum,
        rolling_heading, gap_fill_linear, reintegrate, jaccard_consecutive, gap_clusters_1d, histogram_blocks, weighted_median, weighted_mean_correction, keyframe_select, heading_segments,
        median_consensus_spread, transmittance, true_temperature, plausible_candidate_retry, u_value_flags, sol_air_u, insolation, material_dimension_lookup, zone_restrict_renormalise, low_eps_gate,
        name_time_parse, frame_rate_offsets,
    )
}

_TAU = "least(greatest(1.9 * exp(-sqrt({d}) * (0.006569 - 0.002276 * sqrt({w}))) - 0.9 * exp(-sqrt({d}) * (0.01262 - 0.00667 * sqrt({w}))), 0), 1)"
_W = "(({h}) / 100.0 * exp(1.5587 + 0.06939 * ({t}) - 0.00027816 * power({t}, 2) + 0.00000068455 * power({t}, 3)))"
_TRUE = "case when {o} > 0 then power({o}, 0.25) - 273.15 end"
_OWN = "((power({a} + 273.15, 4) - (1 - ({e})) * ({tau}) * power(20.0 + 273.15, 4) - (1 - ({tau})) * power(22.0 + 273.15, 4)) / (({e}) * ({tau})))"
_NEAR = """(select l.*, r.id {n}_id, r.us + 1000 - l.us {n}_us, row_number() over (partition by l.event_id order by abs(r.us + 1000 - l.us), r.us) {n}_i
    from {left} l, (select event_id id, us from e where event_type = '{n}') r where r.us between l.us - 86400000000 and l.us + 86400000000)"""
_MAD = "m as (select event_type, quantile_cont(value, 0.5) med from events group by 1), d as (select event_type, med, quantile_cont(abs(value - med), 0.5) mad from events join m using (event_type) group by 1, 2)"
_RANKED = "r as (select l_suppkey, p_type, sum(l_quantity) / sum(sum(l_quantity)) over (partition by l_suppkey) share, l_suppkey % 3 zone_ from lineitem join part on l_partkey = p_partkey group by 1, 2)"

SQL = {
    "nearest_time_triplets": f"""with e as {EVENTS}, v as (select event_id, us from e where event_type = 'view'),
        a as (select * from {_NEAR.format(n='click', left='v')} where click_i = 1), b as (select * from {_NEAR.format(n='purchase', left='a')} where purchase_i = 1)
        select event_id, click_id, click_us, purchase_id, purchase_us, case when abs(click_us) > 600000000 or abs(purchase_us) > 600000000 then 'low_confidence' else 'ok' end status from b""",
    "nearest_time_tolerance": f"""with e as {EVENTS} select event_id, signup_id, delta_us from (
        select l.event_id, r.event_id signup_id, r.us - l.us delta_us, row_number() over (partition by l.event_id order by abs(r.us - l.us), r.us) i
        from e l, e r where l.event_type = 'error' and r.event_type = 'signup' and r.us between l.us - 300000000 and l.us + 300000000) where i = 1""",
    "interpolate_onto_grid": f"""with e as {EVENTS}, s as (select us, value from e where event_type = 'purchase'), g as (select event_id, us from e where event_type = 'view'),
        b as (select g.*, s.us t0, s.value v0 from g asof left join s on g.us >= s.us), c as (select b.*, s.us t1, s.value v1 from b asof left join s on b.us <= s.us)
        select event_id, coalesce(round(case when t0 is null then null when t1 is null then v0 when t1 = t0 then v0 else v0 + (v1 - v0) * ((us - t0)::double / (t1 - t0)) end, 6), -1.0) as "value" from c""",
    "interval_containment": f"""with e as {EVENTS} select w.event_id window_id, count(*) n, round(avg(e.value), 6) mean_value from e, e w
        where w.event_type = 'purchase' and e.us between w.us and w.us + 1800000000 group by 1""",
    "rate_stats": f"""with e as (select event_type, us, (us - lag(us) over (partition by event_type order by us)) / 1e6 d from {EVENTS}),
        b as (select event_type, count(*) n, (max(us) - min(us)) / 1e6 span_s, quantile_cont(d, 0.5) m, stddev_pop(d) * 1000 jitter_ms, max(d) max_gap_s from e group by 1)
        select event_type, any_value(n) n, round(any_value(span_s), 6) span_s, round((any_value(n) - 1) / any_value(span_s), 6) rate_hz, round(1 / any_value(m), 6) median_hz, round(any_value(jitter_ms), 6) jitter_ms,
        round(any_value(max_gap_s), 6) max_gap_s, count(case when d > 3 * m then 1 end) gaps, cast(sum(greatest(round_even(d / m, 0) - 1, 0)) as bigint) missing from e join b using (event_type) group by 1""",
    "rate_verdict": f"""select user_id, count(*) n, case when (count(*) - 1) / ((max(us) - min(us)) / 1e6) < (1 / 39000.0::double) * 0.9::double then 'LOW'
        when (count(*) - 1) / ((max(us) - min(us)) / 1e6) > (1 / 39000.0::double) * 1.1::double then 'HIGH' else 'OK' end verdict from {EVENTS} group by 1""",
    "mad_segmentation": f"""with {_MAD}, e as (select e.event_type, us, value > med + 1.5 * mad f, row_number() over (partition by e.event_type order by us) i from {EVENTS} e join d using (event_type)),
        g as (select *, i - row_number() over (partition by event_type, f order by us) k from e), r as (select event_type, f, k, min(us) a, max(us) b, count(*) n from g group by 1, 2, 3),
        s as (select *, f and n >= 2 mv, sum((f and n >= 2)::int) over (partition by event_type order by a) q from r)
        select event_type, min(a) as "first", max(b) as "last", cast(sum(n) as bigint) length from s where not mv group by event_type, q having sum(n) >= 10""",
    "value_runs": f"""with e as (select event_type, us, value > 60 flag, row_number() over (partition by event_type order by us) i from {EVENTS}), g as (select *, i - row_number() over (partition by event_type, flag order by us) k from e)
        select event_type, flag, min(us) as "first", max(us) as "last", count(*) length from g group by event_type, flag, k having count(*) > 3""",
    "first_divergence_cut": f"""with s as (select *, abs(value - lag(value) over w) p, greatest((us - lag(us) over w) / 1e6, 1e-6) dt from {EVENTS} window w as (partition by user_id order by us)),
        c as (select *, sum(coalesce((p / dt > 0.05 or p > 150.0)::int, 0)) over (partition by user_id order by us) cut from s) select user_id, count(*) kept, max(event_id) last_id from c where cut = 0 group by 1""",
    "rolling_turn_sum": "select event_id, round(sum(value) over (partition by user_id order by ts rows between 2 preceding and 2 following), 6) rolling from events",
    "rolling_heading": """with a as (select *, radians(value % 90) r from events) select event_id, round(((degrees(atan2(avg(sin(r)) over w, avg(cos(r)) over w)) % 360) + 360) % 360, 5) smooth from a
        window w as (partition by user_id order by ts rows between 3 preceding and 3 following)""",
    "gap_fill_linear": f"""with e as (select user_id, event_id, us, case when event_type <> 'error' then value end v from {EVENTS}), k as (select user_id, us, v from e where v is not null),
        b as (select e.*, k.us t0, k.v v0 from e asof left join k on e.user_id = k.user_id and e.us >= k.us), c as (select b.*, k.us t1, k.v v1 from b asof left join k on b.user_id = k.user_id and b.us <= k.us)
        select event_id, round(coalesce(v, v0 + (v1 - v0) * ((us - t0)::double / nullif(t1 - t0, 0)), v0, v1), 5) as "value" from c""",
    "reintegrate": """select event_id, round(sum(value * cos(radians(user_id % 360))) over w, 4) + 0.0 px, round(sum(value * sin(radians(user_id % 360))) over w, 4) + 0.0 py from events
        window w as (partition by user_id order by ts rows between unbounded preceding and current row)""",
    "jaccard_consecutive": f"""with c as (select distinct us // 86400000000 as d, user_id from {EVENTS}), s as (select d, count(*) n from c group by 1),
        b as (select x.d, count(*) k from c x join c y on x.d = y.d + 1 and x.user_id = y.user_id group by 1)
        select x.d as "day", round(1 - coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 6) distance from s x join s y on x.d = y.d + 1 left join b on b.d = x.d""",
    "gap_clusters_1d": """with o as (select o_custkey % 10 k, o_totalprice v, (o_totalprice - lag(o_totalprice) over (partition by o_custkey % 10 order by o_totalprice) > 1500)::int g from orders),
        c as (select k, v, sum(coalesce(g, 0)) over (partition by k order by v rows unbounded preceding) as cluster_ from o)
        select k, cast(cluster_ as bigint) as "cluster", count(*) n, round(min(v), 6) low, round(max(v), 6) high from c group by 1, 2 having count(*) >= 5""",
    "histogram_blocks": """with b as (select cast(floor(value / 5.0) as bigint) bin, count(*) n from events group by 1 having count(*) >= 3), g as (select *, bin - row_number() over (order by bin) k from b)
        select min(bin) first_bin, max(bin) last_bin, count(*) bins, cast(sum(n) as bigint) n from g group by k""",
    "weighted_median": """with w as (select l_orderkey, count(*) w from lineitem group by 1), o as (select o_orderpriority p, o_totalprice v, sum(w) over (partition by o_orderpriority order by o_totalprice, o_orderkey) c, sum(w) over (partition by o_orderpriority) t
        from orders join w on o_orderkey = l_orderkey) select p as o_orderpriority, min(v) as "median" from o where 2 * c >= t group by 1""",
    "weighted_mean_correction": "select l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) correction from lineitem group by 1",
    "keyframe_select": f"""with recursive e as (select user_id, us, value, hour(ts) * 15.0::double h, row_number() over (partition by user_id order by us) i from {EVENTS}),
        f as (select user_id, us, i, value kv, h kh, 1 as k from e where i = 1 union all
          select e.user_id, e.us, e.i, case when {{c}} then e.value else kv end, case when {{c}} then e.h else kh end, ({{c}})::int from f join e on e.user_id = f.user_id and e.i = f.i + 1)
        select user_id, us from f where k = 1""".format(c="abs(e.value - kv) >= 60.0 or abs((((e.h - kh + 180) % 360) + 360) % 360 - 180) >= 90.0"),
    "median_consensus_spread": f"""select user_id, us // 86400000000 as "day", count(*) n, coalesce(case when max(value) - min(value) <= 80.0 then round(quantile_cont(value, 0.5), 6) end, -1.0) consensus from {EVENTS} group by 1, 2""",
    "transmittance": f"""select distinct l_quantity + 0.0 l_quantity, round(l_discount, 6) + 0.0 l_discount, round(l_tax, 6) + 0.0 l_tax,
        coalesce(case when l_quantity > 3 then round({_TAU.format(d='greatest(l_quantity - 3, 0)', w=_W.format(h='l_discount * 1000', t='l_tax * 400'))}, 6) end, -1.0) tau from lineitem""",
    "true_temperature": f"""with t as (select l_suppkey, {_OWN.format(a='l_quantity', e='0.7::double + l_tax', tau='0.8::double + l_discount')} o from lineitem), u as (select l_suppkey, {_TRUE.format(o='o')} c from t)
        select l_suppkey, round(avg(c), 4) mean_c, round(min(c), 4) min_c, count(c) n from u group by 1""",
    "plausible_candidate_retry": f"""with k as (select * from (values (0, 'steel', 0.25::double), (1, 'glass', 0.6::double), (2, 'brick', 0.93::double)) k(rnk, material, eps)),
        t as (select l_suppkey, rnk, material, {_OWN.format(a='l_quantity', e='eps', tau='0.95::double')} o from lineitem, k), u as (select l_suppkey, rnk, material, avg(coalesce(({_TRUE.format(o='o')} between -20 and 80)::int, 0)) >= 0.99 ok from t group by 1, 2, 3)
        select l_suppkey, ok accepted, rnk as "rank", material from (select *, row_number() over (partition by l_suppkey order by (not ok)::int, rnk) i from u) where i = 1""",
    "u_value_flags": """with p as (select p_partkey, p_type, p_retailprice / 50 ts, case when p_size % 7 <= 1 and p_size % 7 <= p_size % 5 then 'floor' when p_size % 5 <= 1 then 'ceiling' else 'wall' end surface from part)
        select p_partkey, surface, round(case surface when 'floor' then 5.9::double when 'ceiling' then 10.0::double else 7.7::double end * (21.0 - ts) / 16.0, 6) u,
        case when ts between 5 and 21 then '' when p_type = 'ECONOMY' then 'solar_suspected' when p_type = 'SMALL' then 'solar_possible' else 'implausible' end flag from p""",
    "sol_air_u": """with s as (select row_id, 5.0::double + (0.6::double * ghi_w_m2 - 3.9::double) / 25.0::double a from plane3_capture_window_perez)
        select row_id, coalesce(round(a, 4), -999.0) sol_air, coalesce(round(case when abs(21.0 - a) >= 1e-6 then 7.7::double * 3.0 / (21.0::double - a) end, 3), -999.0) u from s""",
    "insolation": """with r as (select capture_id, greatest(poa_direct_w_m2, 0.0::double) * coalesce(least(greatest(iam, 0.0::double), 1.0::double), 0.0::double) + greatest(poa_diffuse_w_m2, 0.0::double) p from plane3_capture_window_perez where poa_direct_w_m2 is not null)
        select capture_id, round(sum(p) / 60, 3) wh_m2, round(max(p), 4) peak, count(p) n from r group by 1""",
    "material_dimension_lookup": """select p_type, count(*) n, max(coalesce(eps, -1.0::double)) eps, max(coalesce(alpha, -1.0::double)) alpha from part left join
        (values ('ECONOMY', 0.92::double, 0.6::double), ('SMALL', 0.3::double, 0.2::double), ('STANDARD', 0.85::double, 0.7::double), ('PROMO', 0.95::double, 0.5::double)) k(p_type, eps, alpha) using (p_type) group by 1""",
    "zone_restrict_renormalise": f"""with {_RANKED}, k as (select * from (values (0, 'ECONOMY'), (0, 'SMALL'), (1, 'PROMO'), (1, 'LARGE')) k(z, t)), m as (select r.*, t is not null ok, bool_or(t is not null) over (partition by l_suppkey) anyok from r left join k on z = zone_ and t = p_type)
        select l_suppkey, p_type, round(share / sum(share) over (partition by l_suppkey), 6) share from m where ok or not anyok""",
    "low_eps_gate": f"""with {_RANKED}, s as (select *, p_type in ('ECONOMY', 'SMALL') bad from r), a as (select *, row_number() over (partition by l_suppkey order by share desc, p_type) i from s),
        b as (select *, row_number() over (partition by l_suppkey order by share desc, p_type) i from s where not bad and share >= 0.15)
        select a.l_suppkey, case when a.bad and a.share < 0.25 and b.p_type is not null then b.p_type else a.p_type end p_type, round(case when a.bad and a.share < 0.25 and b.p_type is not null then b.share else a.share end, 6) share,
        a.bad and a.share < 0.25 and b.p_type is not null gated from (select * from a where i = 1) a left join (select * from b where i = 1) b on a.l_suppkey = b.l_suppkey""",
    "name_time_parse": """with n as (select frame_id, zed_epoch, try_cast(regexp_extract(zed_file, '_R?(\\d+)\\.\\w+$', 1) as int) k from zed_frames)
        select frame_id, coalesce(k, -1) frame_no, coalesce(cast(floor(zed_epoch) as bigint), cast(trunc(k / 10) as bigint)) as "second" from n""",
    "frame_rate_offsets": """with g as (select session_id, count(*) n, max(zed_epoch) - min(zed_epoch) s from zed_frames where zed_epoch is not null group by 1)
        select session_id, n, round((n - 1) / s, 3) fps, round((n - 1) / ((n - 1) / s), 2) last_offset_s from g where n > 1""",
}
