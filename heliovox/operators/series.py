"""Ordered operators on series: rates, runs, steps, rolling sums, gaps, clusters, weighted medians, stateful folds.

`by` names the series; a window runs over one series. For one series of very many rows, cut it by time first
(see `timejoin`, `regrid`); the folds here, whose next step depends on all before, cannot be split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def rate_stats(stamps: DataFrame, *, by: Sequence[str], time: str, span_s: float | None = None) -> DataFrame:
    """`by, n, span_s, rate_hz, median_hz, jitter_ms, max_gap_s, gaps, missing` of microsecond stamps.

    rate_hz: (n - 1) / span, or n / span_s of a given window. A gap is a step of over 3 medians; each step is taken to
    miss round(step / median) - 1 stamps, halves to even. One stamp has no steps: what needs them is null.
    """
    keys = list(by)
    step = (F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))) / 1e6
    d = stamps.where(F.col(time).isNotNull()).withColumn("_d", step)
    base = d.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.max(time) - F.min(time)) / 1e6).alias("span_s"), F.percentile("_d", F.lit(0.5)).alias("_m"), (F.stddev_pop("_d") * 1000).alias("jitter_ms"), F.max("_d").alias("max_gap_s")
    )
    more = d.join(base.select(*keys, "_m"), keys).groupBy(*keys).agg(
        F.count(F.when(F.col("_d") > 3 * F.col("_m"), 1)).alias("gaps"), F.sum(F.greatest(F.rint(F.try_divide("_d", "_m")) - 1, F.lit(0.0))).cast("bigint").alias("missing")
    )
    rate = F.try_divide(F.col("n") - 1, F.col("span_s")) if span_s is None else F.col("n") / F.lit(float(span_s))
    return base.join(more, keys).select(*keys, "n", "span_s", rate.alias("rate_hz"), F.try_divide(F.lit(1.0), "_m").alias("median_hz"), "jitter_ms", "max_gap_s", "gaps", "missing")


def verdict(rate: Column, expected: float, tolerance: float) -> Column:
    return F.when(rate < expected * (1 - tolerance), "LOW").when(rate > expected * (1 + tolerance), "HIGH").otherwise("OK")


def runs(rows: DataFrame, *, by: Sequence[str], order: str, flag: Column) -> DataFrame:
    """`by, flag, first, last, length`: maximal stretches of equal flags, by `order`."""
    keys = list(by)
    w = Window.partitionBy(*keys).orderBy(order)
    d = rows.select(*keys, order, flag.alias("flag")).withColumn("_i", F.row_number().over(w))
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "flag").orderBy(order)))
    return d.groupBy(*keys, "flag", "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_g")


def segments(rows: DataFrame, *, by: Sequence[str], order: str, value: str, threshold: Column, least_move: int, least_rest: int) -> DataFrame:
    """`by, first, last, length`: rests of at least `least_rest` rows between moves, which are runs over the threshold of at least `least_move`."""
    keys = list(by)
    r = runs(rows, by=keys, order=order, flag=F.col(value) > threshold)
    # Short moves belong to the rest around them.
    moving = F.col("flag") & (F.col("length") >= least_move)
    w = Window.partitionBy(*keys).orderBy("first")
    r = r.withColumn("_m", moving).withColumn("_g", F.sum(F.col("_m").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rests = r.where("not _m").groupBy(*keys, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"))
    return rests.where(F.col("length") >= least_rest).drop("_g")


def median_and_mad(rows: DataFrame, *, by: Sequence[str], value: str) -> DataFrame:
    keys = list(by)
    m = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return rows.join(m, keys).groupBy(*keys, "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))


def until_divergence(rows: DataFrame, *, by: Sequence[str], order: str, time: str, position: Sequence[str], most_speed: float, most_step: float) -> DataFrame:
    """Rows up to the one before the first step that is too fast or too long; time steps that aren't positive count as a microsecond."""
    keys = list(by)
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), F.lit(2.0)) for c in position), F.lit(0.0)))
    dt = F.greatest((F.col(time) - F.lag(time).over(w)) / 1e6, F.lit(1e-6))
    bad = F.coalesce((step / dt > most_speed) | (step > most_step), F.lit(False)).cast("int")
    return rows.withColumn("_bad", bad).withColumn("_cut", F.sum("_bad").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_bad", "_cut")


def rolling_sum(rows: DataFrame, *, by: Sequence[str], order: str, value: str, reach: int, name: str = "rolling") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn(name, F.sum(value).over(w))


def rolling_circular_mean(rows: DataFrame, *, by: Sequence[str], order: str, degrees: str, reach: int, name: str = "smooth") -> DataFrame:
    """Centred mean of angles, in degrees from 0 to 360, missing ones left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    a = F.radians(degrees)
    return rows.withColumn(name, F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)).over(w), F.avg(F.cos(a)).over(w))), F.lit(360.0)))


def fill_linear(rows: DataFrame, *, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Missing values from the line between the nearest ones on both sides, at the ends from the nearest one. `order` is numeric."""
    w = Window.partitionBy(*by).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = rows.withColumns({"_a": a, "_b": b})
    share = F.try_divide((F.col(order) - F.col("_a.o")).cast("double"), (F.col("_b.o") - F.col("_a.o")).cast("double"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    return d.withColumn(value, F.coalesce(F.col(value), line, "_a.v", "_b.v")).drop("_a", "_b")


def reintegrated(rows: DataFrame, *, by: Sequence[str], order: str, step: dict[str, Column]) -> DataFrame:
    """Positions as running sums of corrected steps; the first row's steps, if null, are 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(F.coalesce(s, F.lit(0.0))).over(w) for name, s in step.items()})


def gap_clusters(rows: DataFrame, *, by: Sequence[str], value: str, most_gap: float, least: int) -> DataFrame:
    """`by, cluster, n, low, high`: clusters of sorted values between gaps over `most_gap`, of at least `least` members."""
    keys = list(by)
    w = Window.partitionBy(*keys).orderBy(value)
    d = rows.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_n", F.coalesce((F.col(value) - F.lag(value).over(w) > most_gap).cast("int"), F.lit(0)))
    d = d.withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).where(F.col("n") >= least)


BIN_BLOCK = 4096


def histogram_blocks(rows: DataFrame, *, value: str, width: float, least: int) -> DataFrame:
    """`first_bin, last_bin, bins, n`: stretches of neighbouring bins with at least `least` values each.

    Values are counted per bin map-side. A stretch begins where the bin before is missing; every bin finds the last beginning at or before it within a block of
    bins, and of blocks only one row each is ordered as a whole.
    """
    bins = rows.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    before = bins.select((F.col("bin") + 1).alias("bin"), F.lit(False).alias("_begins"))
    marked = bins.join(before, "bin", "left").withColumn("_start", F.when(F.col("_begins").isNull(), F.col("bin"))).withColumn("_block", F.floor(F.col("bin") / BIN_BLOCK))
    within = marked.withColumn("_g", F.last("_start", ignorenulls=True).over(Window.partitionBy("_block").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = marked.groupBy("_block").agg(F.max("_start").alias("_last"))
    carried = blocks.select("_block", F.last("_last", ignorenulls=True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    d = within.join(carried, "_block").withColumn("_g", F.coalesce("_g", "_carried"))
    return d.groupBy("_g").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("bins"), F.sum("n").alias("n")).drop("_g")


def weighted_mean(rows: DataFrame, *, by: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """`by, n, mean`: mean of values by weight, null where the weights sum to 0; rows with a null value or weight don't count."""
    d = rows.select(*by, value.alias("_v"), weight.alias("_w")).where("_v is not null and _w is not null")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")).alias("mean"))


def consensus(rows: DataFrame, *, by: Sequence[str], value: str, weight: str, tie: str, reach: float) -> DataFrame:
    """`by, median, n, correction`: the weighted median of each group, and the weighted mean step towards it of the values within `reach` of it."""
    middle = weighted_median(rows, by=by, value=value, weight=weight, tie=tie)
    near = rows.join(middle, list(by)).where(F.abs(F.col(value) - F.col("median")) <= reach)
    out = weighted_mean(near, by=[*by, "median"], value=F.col("median") - F.col(value), weight=F.col(weight))
    return out.withColumnRenamed("mean", "correction")


def weighted_median(rows: DataFrame, *, by: Sequence[str], value: str, weight: str, tie: str) -> DataFrame:
    """`by, median`: the first value, in order, at which half of the weight is reached."""
    keys = list(by)
    w = Window.partitionBy(*keys)
    d = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("_c", F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("_t", F.sum(weight).over(w)).where("2 * _c >= _t").groupBy(*keys).agg(F.min(value).alias("median"))


def set_distance(rows: DataFrame, *, seq: str, cell: Sequence[str]) -> DataFrame:
    """`seq, distance`: Jaccard distance of the cells of each scan to those of the scan numbered one less."""
    cells = rows.select(seq, *cell).distinct()
    sizes = cells.groupBy(seq).agg(F.count("*").alias("n"))
    shared = cells.join(cells.withColumn(seq, F.col(seq) + 1), [seq, *cell]).groupBy(seq).agg(F.count("*").alias("both"))
    before = sizes.select((F.col(seq) + 1).alias(seq), F.col("n").alias("m"))
    both = F.coalesce("both", F.lit(0))
    return sizes.join(before, seq).join(shared, seq, "left").select(seq, (1 - both / (F.col("n") + F.col("m") - both)).alias("distance"))


def _folded(rows: DataFrame, by: str, order: str, columns: Sequence[str], step, result: str) -> DataFrame:
    """Rows with `result`, a fold over each series in order; streamed batch by batch, with only the fold's state held."""
    kind = dict(rows.dtypes)
    d = rows.select(by, order, *columns).repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = object(), None
        for batch in batches:
            out = []
            for key, *values in zip(batch[by], *(batch[c] for c in columns)):
                if key != series:
                    series, state = key, None
                state, value = step(state, values)
                out.append(value)
            yield batch.assign(**{result: out})

    return d.mapInPandas(run, ", ".join(f"`{c}` {kind[c]}" for c in (by, order, *columns)) + f", {result} int")


def keyframes(rows: DataFrame, *, by: str, order: str, position: Sequence[str], heading: str, least_step: float, least_turn: float) -> DataFrame:
    """Rows with `keyframe`: 1 for the first, and whenever the distance or turn (degrees) since the last one reaches its limit."""

    def step(last, values):
        *p, h = values
        if last is not None:
            turn = abs((h - last[1] + 180) % 360 - 180)
            if math.dist(p, last[0]) < least_step and turn < least_turn:
                return last, 0
        return (p, h), 1

    return _folded(rows, by, order, [*position, heading], step, "keyframe")


def heading_segments(rows: DataFrame, *, by: str, order: str, heading: str, length: str, limit: float, least_length: float) -> DataFrame:
    """Rows with `segment`, numbered from 0: a new one when a heading departs by over `limit` degrees from the length-weighted circular
    mean of its segment so far. Steps shorter than `least_length` stay in the segment."""

    def step(state, values):
        h, l = values
        number, s, c = state if state is not None else (0, 0.0, 0.0)
        if l >= least_length:
            mean = math.degrees(math.atan2(s, c))
            if (s or c) and abs((h - mean + 180) % 360 - 180) > limit:
                number, s, c = number + 1, 0.0, 0.0
            s, c = s + l * math.sin(math.radians(h)), c + l * math.cos(math.radians(h))
        return (number, s, c), number

    return _folded(rows, by, order, [heading, length], step, "segment")


def merge_short(rows: DataFrame, *, by: str, segment: str, heading: str, length: str, least: float) -> DataFrame:
    """Rows with `segment` numbered anew from 0 after short segments were merged, the shortest first, the earlier of equal ones, until none
    is shorter than `least` or one is left: into the neighbour whose length-weighted mean heading is nearer, the earlier of equal ones.

    What a task holds is one row per segment of a series.
    """
    a = F.radians(heading)
    sums = rows.groupBy(by, segment).agg(F.sum(length).alias("l"), F.sum(F.col(length) * F.sin(a)).alias("s"), F.sum(F.col(length) * F.cos(a)).alias("c"))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(segment)
        parts = [[[n], l, s, c] for n, l, s, c in part[[segment, "l", "s", "c"]].itertuples(index=False)]
        while len(parts) > 1:
            k = min(range(len(parts)), key=lambda i: (parts[i][1], i))
            if parts[k][1] >= least:
                break
            mean = lambda p: math.atan2(p[2], p[3])
            turn = lambda i: abs(math.remainder(mean(parts[i]) - mean(parts[k]), 2 * math.pi))
            into = min((i for i in (k - 1, k + 1) if 0 <= i < len(parts)), key=lambda i: (round(turn(i), 12), i))
            first, last = sorted((k, into))
            parts[first : last + 1] = [[x + y for x, y in zip(parts[first], parts[last])]]
        return pd.DataFrame([(part[by].iloc[0], n, i) for i, p in enumerate(parts) for n in p[0]], columns=[by, segment, "_merged"])

    kind = dict(rows.dtypes)
    numbers = sums.groupBy(by).applyInPandas(merge, f"`{by}` {kind[by]}, `{segment}` {kind[segment]}, _merged int")
    return rows.join(numbers, [by, segment]).withColumn(segment, F.col("_merged")).drop("_merged")
