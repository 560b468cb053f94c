"""Irregular readings onto a regular grid of periods per source.

Every reading holds from its instant to the next reading, at most for one period: a step function in intervals.
The intervals are intersected with the periods, which gives time-weighted means and the covered share of each.
Readings are shuffled once, by source and stretch of `CHUNK` periods, so that a busy source is spread over many
tasks. Only one summary row per stretch is gathered by source, to find the holes between stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CHUNK = 512


def _chunked(rows: DataFrame, source: str, time_us: str, value: str, step_s: str) -> DataFrame:
    """A row per source and stretch: first and last occupied period, and a map of its periods' sums."""
    step = F.col(step_s).cast("bigint") * 1_000_000
    readings = rows.select(F.col(source).alias("source"), F.col(time_us).alias("t"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v"), step.alias("step"))
    readings = readings.where("t >= 0 and v is not null and step > 0").withColumn("slot", F.expr("t div step")).withColumn("home", F.expr(f"slot div {CHUNK}"))
    # A reading in the first or last period of a stretch also matters to the neighbouring stretch.
    place = F.expr(f"slot - home * {CHUNK}")
    readings = readings.withColumn(
        "chunk", F.explode(F.array_compact(F.array(F.col("home"), F.when(place == 0, F.col("home") - 1), F.when(place == CHUNK - 1, F.col("home") + 1))))
    ).repartition("source", "chunk")
    ordered = Window.partitionBy("source", "chunk", "step").orderBy("t", "v")
    cells = (
        readings.withColumn("till", F.expr("t + step")).withColumn("till", F.least("till", F.coalesce(F.lead("t").over(ordered), "till")))
        .withColumn("cell", F.explode(F.expr("if(till > t and (till - 1) div step > slot, array(slot, slot + 1), array(slot))")))
        .where(f"cell between chunk * {CHUNK} and (chunk + 1) * {CHUNK}")
        .withColumn("held", F.expr("greatest(0L, least(till, (cell + 1) * step) - greatest(t, cell * step))"))
        .groupBy("source", "chunk", "step", "cell")
        .agg(F.sum(F.expr("if(cell = slot and home = chunk, 1L, 0L)")).alias("n"), F.sum("held").alias("held"), F.sum(F.expr("v * held")).alias("area"))
    )
    grouped = cells.groupBy("source", "chunk", "step").agg(
        F.min(F.expr("if(n > 0, cell, null)")).alias("first"),
        F.max(F.expr("if(n > 0, cell, null)")).alias("last"),
        F.collect_list(F.struct("cell", F.struct("n", "held", "area").alias("s"))).alias("cells"),
    )
    return grouped.where("first is not null")


def regrid(rows: DataFrame, *, source: str, time_us: str, value: str, step_s: str) -> DataFrame:
    """`source, slot_us, n_readings, mean, coverage, status` for every period from a source's first reading to its last.

    Periods start at UTC multiples of `step_s` since 1970. `mean` is time-weighted; `status` is `observed`, `held`
    (no reading, but the one before it still holds for a part) or `empty` (mean null, coverage 0). Rows with a null or negative
    time, a null or NaN value, or no positive step don't count. Readings at the same instant all count as readings; of
    their values the highest holds. A null source is a source of its own. An empty table gives an empty result.
    """
    chunks = _chunked(rows, source, time_us, value, step_s)
    within = chunks.select("source", "step", F.map_from_entries("cells").alias("known"), F.explode(F.sequence("first", "last")).alias("slot"))
    within = within.select("source", "step", "slot", F.expr("try_element_at(known, slot)").alias("s"))
    # Between stretches: from the last period of one to the first of the next, in pieces of bounded length. The last
    # reading may hold into the period after its own.
    edges = chunks.select("source", "step", "chunk", "first", "last", F.expr("get(filter(cells, c -> c.cell = last + 1), 0).s").alias("spill"))
    ordered = Window.partitionBy("source", "step").orderBy("chunk")
    holes = edges.select("source", "step", "first", F.lag("last").over(ordered).alias("before"), F.lag("spill").over(ordered).alias("spill"))
    holes = holes.where("before + 1 < first").withColumn("from", F.explode(F.expr(f"sequence(before + 1, first - 1, {CHUNK}L)")))
    holes = holes.withColumn("slot", F.explode(F.expr(f"sequence(from, least(from + {CHUNK - 1}, first - 1))")))
    between = holes.select("source", "step", "slot", F.expr("if(slot = before + 1, spill, null)").alias("s"))
    held = F.coalesce(F.col("s.held"), F.lit(0))
    n = F.coalesce(F.col("s.n"), F.lit(0))
    return within.unionByName(between).select(
        F.col("source").alias(source),
        (F.col("slot") * F.col("step")).alias("slot_us"),
        n.alias("n_readings"),
        F.try_divide(F.col("s.area"), held.cast("double")).alias("mean"),
        (held / F.col("step")).alias("coverage"),
        F.when(n > 0, "observed").when(held > 0, "held").otherwise("empty").alias("status"),
    )
