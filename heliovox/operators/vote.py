"""Votes for labels: weighted by confidence and depth, pooled over cells, in two levels; gates on ranked candidates.

Equal weights go to the smallest label. All sums combine map-side; rankings run over one row per group and label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _winner(votes: DataFrame, group: Sequence[str], label: str, weight: str) -> DataFrame:
    """Winner and its share of the group's weight."""
    all_of = Window.partitionBy(*group)
    best = all_of.orderBy(F.desc(weight), F.asc(label))
    ranked = votes.withColumn("_total", F.sum(weight).over(all_of)).withColumn("_r", F.row_number().over(best))
    return ranked.where("_r = 1").withColumn("_share", F.try_divide(F.col(weight), F.col("_total"))).drop("_r", "_total")


def weighted(rows: DataFrame, group: Sequence[str], label: str, *, conf: str, depth: str | None = None, power: float = 0.0, floor: float | None = None) -> DataFrame:
    """`group, label, weight, share`: per group the label of the greatest sum of conf * (1 / max(1, depth))^power.

    Votes below the confidence floor, with a null label or a null confidence, don't count.
    """
    w = F.col(conf).cast("double")
    if depth is not None:
        w = w * F.pow(1 / F.greatest(F.lit(1.0), F.col(depth)), F.lit(power))
    kept = rows.where(F.col(label).isNotNull() & F.col(conf).isNotNull() & (F.col(conf) >= floor if floor is not None else F.lit(True)))
    sums = kept.groupBy(*group, label).agg(F.sum(w).alias("weight"))
    return _winner(sums, group, label, "weight").withColumnRenamed("_share", "share")


def masses(rows: DataFrame, group: Sequence[str], label: str, *, conf: str) -> DataFrame:
    """`group, label, mass`: each label's share of the group's confidence."""
    sums = rows.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.sum(F.col(conf).cast("double")).alias("w"))
    return sums.withColumn("mass", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(*group)))).drop("w")


def pool(hits: DataFrame, votes: DataFrame, segment: str, group: Sequence[str], label: str, allowed: DataFrame | None = None) -> DataFrame:
    """`segment, label, mass, agreement`: the label of the greatest vote mass over all cells a segment hits.

    allowed: label names to which the choice is restricted; a segment for which none is left keeps all of its labels.
    """
    sums = hits.join(votes, list(group)).groupBy(segment, label).agg(F.sum(F.col("hits") * F.col("mass")).alias("mass"))
    if allowed is not None:
        marked = sums.join(F.broadcast(allowed.select(label).distinct().withColumn("_ok", F.lit(1))), label, "left")
        any_ok = F.max("_ok").over(Window.partitionBy(segment))
        sums = marked.withColumn("_any", any_ok).where("_ok is not null or _any is null").drop("_ok", "_any")
    return _winner(sums, [segment], label, "mass").withColumnRenamed("_share", "agreement")


def two_level(rows: DataFrame, point: str, cell: str, label: str) -> DataFrame:
    """`cell, label, n, confidence`: the majority of the points' own majorities in each cell."""
    first = rows.where(F.col(label).isNotNull()).groupBy(cell, point, label).agg(F.count("*").alias("votes"))
    # The least of (-votes, label) is the winner; a combinable aggregate instead of a sort.
    per_point = first.groupBy(cell, point).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(label).alias("l"))).alias("_best")).select(cell, F.col("_best.l").alias(label))
    second = per_point.groupBy(cell, label).agg(F.count("*").alias("n"))
    return _winner(second, [cell], label, "n").withColumnRenamed("_share", "confidence")


def shares(rows: DataFrame, label: str) -> DataFrame:
    """`label, n, share` of all rows; a null label is a label of its own."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col("n"), F.col("_all"))).drop("_all")


def vocabulary(rows: DataFrame, label: str, order: str) -> DataFrame:
    """`label, id`: labels numbered from 0 in the order in which they are first seen."""
    firsts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("_o"))
    return firsts.withColumn("id", F.row_number().over(Window.orderBy("_o", label)) - 1).drop("_o")


def restrict(ranked: DataFrame, item: str, label: str, share: str, allowed: DataFrame, zone: str) -> DataFrame:
    """`ranked` kept to the labels allowed in each row's zone, shares made to add up to 1 again.

    Items for which nothing is left keep their labels. `allowed` holds `zone` and `label`, both from fixed vocabularies.
    """
    marked = ranked.join(F.broadcast(allowed.select(zone, label).distinct().withColumn("_ok", F.lit(1))), [zone, label], "left")
    one = Window.partitionBy(item)
    kept = marked.withColumn("_any", F.max("_ok").over(one)).where("_ok is not null or _any is null").drop("_ok", "_any")
    return kept.withColumn(share, F.try_divide(F.col(share), F.sum(share).over(one)))


def gate(ranked: DataFrame, item: str, label: str, share: str, suspect: Column, *, least: float, threshold: float) -> DataFrame:
    """`item, label, share, gated`: the top label, unless it is suspect with less than `least`; then the best label that isn't suspect with at
    least `threshold`, if there is one."""
    scored = ranked.withColumn("_s", suspect)
    key = F.struct((-F.col(share)).alias("v"), F.col(label).alias("l"), F.col("_s").alias("s"))
    best = scored.groupBy(item).agg(F.min(key).alias("top"), F.min(F.when(~F.col("_s") & (F.col(share) >= threshold), key)).alias("other"))
    swap = F.col("top.s") & (-F.col("top.v") < least) & F.col("other").isNotNull()
    pick = F.when(swap, F.col("other")).otherwise(F.col("top"))
    return best.select(item, pick["l"].alias(label), (-pick["v"]).alias(share), swap.alias("gated"))


def first_passing(candidates: DataFrame, item: str, rank: str, passes: Column, keep: Sequence[str]) -> DataFrame:
    """Per item the candidate of the lowest rank that passes, else the one of the lowest rank, with `accepted`."""
    scored = candidates.withColumn("_ok", F.coalesce(passes, F.lit(False)))
    pick = F.min(F.struct((~F.col("_ok")).alias("bad"), F.col(rank).alias(rank), *keep))
    return scored.groupBy(item).agg(pick.alias("_pick")).select(item, (~F.col("_pick.bad")).alias("accepted"), F.col("_pick")[rank].alias(rank), *[F.col("_pick")[c].alias(c) for c in keep])
