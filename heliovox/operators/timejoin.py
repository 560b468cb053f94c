"""Joins of streams by time: nearest in time, interpolated, contained in an interval.

The nearest joins cut time into bins. Within a bin, a union of both sides sorted by time carries the neighbours along;
across bins only one summary row per bin is gathered, so a key with most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BIN_US = 3_600_000_000


def neighbours(left: DataFrame, right: DataFrame, *, time: str, keys: Sequence[str] = (), payload: Sequence[str], bin_us: int = BIN_US) -> DataFrame:
    """`left` with `before` and `after`: structs of `time` and `payload` of the last right row at or before, and the first at or after.

    Times are microseconds. Of right rows at the same instant, the least payload stands for all. Left rows with a null time, and right
    rows with one, have no neighbours; every left row comes out once. Keys match null-safely.
    """
    keys = list(keys)
    bin_of = F.floor(F.col(time) / F.lit(bin_us)).cast("bigint")
    r = right.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.min(F.struct(*payload)).alias("_p"))
    r = r.select(*keys, F.col(time).alias("_t"), F.struct(F.col(time), *[F.col("_p")[c].alias(c) for c in payload]).alias("_r")).withColumn("_bin", F.floor(F.col("_t") / F.lit(bin_us)).cast("bigint"))
    lefts = left.select(*keys, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l")).withColumn("_bin", F.floor(F.col("_t") / F.lit(bin_us)).cast("bigint"))
    both = lefts.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_bin")
    # Right rows come first among equals, for both directions.
    both = both.withColumns(
        {
            "_b": F.last("_r", ignorenulls=True).over(within.orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)),
            "_a": F.last("_r", ignorenulls=True).over(within.orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    bins = r.groupBy(*keys, "_bin").agg(F.min("_r").alias("first"), F.max("_r").alias("last")).unionByName(lefts.select(*keys, "_bin").distinct(), allowMissingColumns=True)
    bins = bins.groupBy(*keys, "_bin").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    order = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.select(
        *[F.col(k).alias("_k_" + k) for k in keys], F.col("_bin").alias("_k_bin"),
        F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    match = F.col("_bin").eqNullSafe(F.col("_k_bin"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col("_k_" + k))
    out = both.where("_side = 1").join(bins, match, "left")
    timed = F.col("_t").isNotNull()
    return out.select("_l.*", F.when(timed, F.coalesce("_b", "_earlier")).alias("before"), F.when(timed, F.coalesce("_a", "_later")).alias("after"))


def nearest(left: DataFrame, right: DataFrame, *, time: str, keys: Sequence[str] = (), payload: Sequence[str], tolerance_us: int | None = None, offset_us: int = 0, bin_us: int = BIN_US) -> DataFrame:
    """`left` with `nearest`, a struct of `time` and `payload` of the right row nearest in time, and `delta_us` (right minus left).

    offset_us is added to the right clock. Of equally near rows the earlier one counts. Beyond the tolerance both are null.
    """
    shifted = right.withColumn(time, F.col(time) + F.lit(offset_us)) if offset_us else right
    out = neighbours(left, shifted, time=time, keys=keys, payload=payload, bin_us=bin_us)
    back, ahead = F.col(time) - F.col("before")[time], F.col("after")[time] - F.col(time)
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    out = out.withColumn("nearest", pick).drop("before", "after").withColumn("delta_us", F.col("nearest")[time] - F.col(time))
    if tolerance_us is None:
        return out
    near = F.abs("delta_us") <= tolerance_us
    return out.withColumns({"nearest": F.when(near, F.col("nearest")), "delta_us": F.when(near, F.col("delta_us"))})


def interpolated(grid: DataFrame, samples: DataFrame, *, time: str, value: str, keys: Sequence[str] = (), hold_last: bool = True, bin_us: int = BIN_US) -> DataFrame:
    """`grid` with `value`, linear between the samples around; null before the first, the last one's value after it (or null)."""
    out = neighbours(grid, samples, time=time, keys=keys, payload=[value], bin_us=bin_us)
    a, b = F.col("before"), F.col("after")
    share = F.try_divide((F.col(time) - a[time]).cast("double"), (b[time] - a[time]).cast("double"))
    line = F.when(b[time] == a[time], a[value]).otherwise(a[value] + (b[value] - a[value]) * share)
    return out.withColumn(value, F.when(a.isNull(), None).when(b.isNull(), a[value] if hold_last else None).otherwise(line)).drop("before", "after")


def contained(rows: DataFrame, intervals: DataFrame, *, time: str, start: str, end: str, bin_us: int = BIN_US) -> DataFrame:
    """Rows with every interval that contains their time, both ends included.

    An equi-join on time bins: an interval stands in each bin it touches; the exact bounds are checked after. Null bounds and
    times match nothing.
    """
    low, high = F.floor(F.col(start) / F.lit(bin_us)).cast("bigint"), F.floor(F.col(end) / F.lit(bin_us)).cast("bigint")
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(low, high)))
    binned = rows.withColumn("_bin", F.floor(F.col(time) / F.lit(bin_us)).cast("bigint"))
    return binned.join(spread, "_bin").where(F.col(time).between(F.col(start), F.col(end))).drop("_bin")
