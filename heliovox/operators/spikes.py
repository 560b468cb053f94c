"""Implausible values per source: spikes, stuck values and physically impossible readings.

Spikes. A source's daily profile, as value over clear-sky scale, is cut into overlapping windows of consecutive
readings, the rows of a matrix. Robust principal components, by alternating projections, part it into a low-rank
course, which takes in day, weather and lasting changes, and a sparse rest. Readings in the sparse rest, beyond a
threshold of the source's own, are the spikes; of these an exact check of their edges keeps those where one reading, or
two in succession, lie on the same side of both neighbours. Whole days as rows of the matrix leave the weather in
the sparse rest, where a spike under broken cloud is lost; so windows of a day are its rows. Runs of equal readings and
physical limits are tested separately.

Sources are cut into blocks of time with an overlap, so a task never holds more than one block of one source,
however many rows that source has; rows sent again are merged, map-side first, before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from heliovox.session import checkpointed

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Rule:
    """When a reading of the sparse rest is a jump.

    sparse: so many times the usual residual put a reading in the sparse rest.
    usual: at least so many times the source's usual step. up, down: at least this share of the expected value.
    floor: share of the expected value that is added to the usual step, for sources with next to none.
    slopes: also take a reading that departs from the straight course of both sides on a slope, for sources that run smoothly.
    """

    sparse: float = 6.0
    usual: float = 7.5
    up: float = 0.028
    down: float = 0.028
    floor: float = 0.002
    slopes: bool = False


@dataclass(frozen=True)
class Blocks:
    days: int = 64
    overlap_days: int = 4


def _large(gap: np.ndarray) -> np.ndarray:
    size = np.abs(gap)
    return np.where(size > max(3 * 1.4826 * float(np.median(size)), 1e-3), gap, 0.0)


def low_rank(m: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """The low-rank part of `m` by alternating projections onto low-rank and sparse matrices, rank by rank.

    The first sparse part is what departs from row and column medians; else one large spike would be a component itself.
    """
    middle = m - np.median(m, axis=1, keepdims=True)
    sparse = _large(middle - np.median(middle, axis=0, keepdims=True))
    low = m
    flip = m.shape[0] > m.shape[1]
    for r in range(1, rank + 1):
        for _ in range(rounds):
            rest = (m - sparse).T if flip else m - sparse
            _, vectors = np.linalg.eigh(rest @ rest.T)
            top = vectors[:, -r:]
            low = top @ (top.T @ rest)
            low = low.T if flip else low
            sparse = _large(m - low)
    return low


def residuals(level: np.ndarray, width: int = 5, rank: int = 2) -> np.ndarray:
    """Of one source's levels in order of time: what the low-rank part of the windows of its profile leaves unexplained."""
    n = len(level)
    width = min(width, max(3, n // 2))
    if n < width:
        return np.zeros(n)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(level, width))
    low = low_rank(windows, min(rank, width // 2))
    # A reading stands in as many windows as these are wide; its course is the middle one of what they say.
    said = np.full((n, width), np.nan)
    for k in range(width):
        said[k : k + len(low), k] = low[:, k]
    return level - np.nanmedian(said, axis=1)


def sparse_rest(level: np.ndarray, lit: np.ndarray, rule: Rule) -> np.ndarray:
    """True where a reading belongs to the sparse part. lit: where readings vary at all; what is usual is measured there, and in the dark, where only
    limits tell, nothing is sparse."""
    size = np.abs(residuals(level))
    seen = size[lit] if lit.sum() >= 5 else size
    return (size > rule.sparse * max(1.4826 * float(np.median(seen)), 1e-3)) & lit


def jumps(t: np.ndarray, value: np.ndarray, scale: np.ndarray, rule: Rule, sparse: np.ndarray | None = None, rounds: int = 6) -> np.ndarray:
    """True for one or two readings in succession beyond both neighbours, of the sparse rest if that is given; all arrays in order of time.

    The plainest jump of a neighbourhood is taken out first, lest it make its neighbours look like jumps.
    """
    out = np.zeros(len(t), bool)
    sparse = np.ones(len(t), bool) if sparse is None else sparse
    if len(t) < 5 or not sparse.any():
        return out
    k = value / scale
    w = (t[1:-1] - t[:-2]) / np.maximum(t[2:] - t[:-2], 1)
    usual = 1.4826 * np.median(np.abs(k[1:-1] - k[:-2] * (1 - w) - k[2:] * w))

    def score(least: np.ndarray, most: np.ndarray, before: np.ndarray, after: np.ndarray, slope: np.ndarray, course: np.ndarray) -> np.ndarray:
        high, low = np.maximum(before, after), np.minimum(before, after)
        up = least > high
        margin = np.where(up, least - high, np.where(most < low, low - most, 0.0))
        base = np.abs(np.where(up, high, low))
        # A plain reading between two jumps departs from both neighbours, but not from the wider course.
        margin = np.where(np.where(up, least - course, course - most) >= margin / 2, margin, 0.0)
        return margin / np.maximum(np.maximum(rule.usual * (usual + rule.floor * base) + slope, np.where(up, rule.up, rule.down) * base), 1e-9)

    left = np.arange(len(t))
    for _ in range(rounds):
        x = k[left]
        n = len(x)
        if n < 5:
            break
        one, two = np.zeros(n + 6), np.zeros(n + 6)  # three empty places on either side
        # The bottom of a valley has steep sides as well; a jump stands out from sides that are level, one at least.
        steep = np.r_[0.0, np.abs(np.diff(x)), 0.0]
        course = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, min(5, n - 1), mode="reflect"), 2 * min(5, n - 1) + 1), axis=1)
        one[4 : n + 2] = score(x[1:-1], x[1:-1], x[:-2], x[2:], np.minimum(steep[: n - 2], steep[3:]), course[1:-1])
        two[4 : n + 1] = score(np.minimum(x[1:-2], x[2:-1]), np.maximum(x[1:-2], x[2:-1]), x[:-3], x[3:], np.minimum(steep[: n - 3], steep[4:]), (course[1:-2] + course[2:-1]) / 2)
        if rule.slopes and n >= 7:
            # Both sides drawn on straight must miss the reading in the same direction, by more than they bend elsewhere.
            bend = np.abs(x[:-2] - 2 * x[1:-1] + x[2:])
            left_miss, right_miss = x[3:-3] - 2 * x[2:-4] + x[1:-5], x[3:-3] - 2 * x[4:-2] + x[5:-1]
            miss = np.where(left_miss * right_miss > 0, np.minimum(np.abs(left_miss), np.abs(right_miss)), 0.0)
            mid = np.abs(x[2:-4] + x[4:-2]) / 2
            limit = np.maximum(2 * rule.usual * (usual + rule.floor * mid) + 3 * np.maximum(bend[: n - 6], bend[4:]), np.where(left_miss > 0, rule.up, rule.down) * mid)
            one[6:n] = np.maximum(one[6:n], miss / np.maximum(limit, 1e-9))
        most = np.maximum(one, np.maximum(two, np.r_[0, two[:-1]]))
        around = np.max([most[3 + d : 3 + d + n] for d in (-2, -1, 0, 1, 2)], axis=0)
        single = (one[3 : n + 3] > 1) & (one[3 : n + 3] >= around)
        first = (two[3 : n + 3] > 1) & (two[3 : n + 3] >= around) & ~single
        hit = (single | first | np.r_[False, first[:-1]]) & sparse[left]
        if not hit.any():
            break
        out[left[hit]] = True
        left = left[~hit]
    # What peels off three or more in a row is a course of its own, not a jump.
    edges = np.flatnonzero(np.diff(np.r_[False, out, False]))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a > 2:
            out[a:b] = False
    return out


def _stuck(value: np.ndarray, least: int) -> np.ndarray:
    """True in runs of at least `least` equal values other than zero."""
    edges = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True])
    size = np.diff(edges)
    return np.repeat((size >= least) & (value[edges[:-1]] != 0), size)


def _same_reading(t: np.ndarray, grain: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the index of the row it repeats (itself if none): equal values, time cut to a coarser grain. `t` is in order."""
    same = np.arange(len(t))
    if not (grain > 1).any():
        return same
    key = np.unique(np.column_stack([np.nan_to_num(values, nan=np.inf), np.isnan(values)]), axis=0, return_inverse=True)[1].ravel().astype(np.int64)
    instants, at = np.unique(t, return_inverse=True)
    for g in np.unique(grain[grain > 1]):
        coarse, finer = np.flatnonzero(grain == g), np.flatnonzero(grain < g)
        if not len(finer):
            continue
        # The first finer row of the same values, from the coarse row's time on.
        place = key[finer] * len(instants) + at[finer]
        order = np.argsort(place, kind="stable")
        found = np.searchsorted(place[order], key[coarse] * len(instants) + at[coarse])
        there = found < len(finer)
        coarse, other = coarse[there], finer[order[found[there]]]
        fits = (key[other] == key[coarse]) & (t[other] < t[coarse] + g * 1_000_000)
        same[coarse[fits]] = other[fits]
    return same


def _one_source(g: dict[str, np.ndarray], fields: list[str], rule: Rule, offset: float, least_run: int) -> dict[str, np.ndarray]:
    """The reason per field for each distinct reading of one block of one source ('' if plausible)."""
    n = len(g["t"])
    t = g["t"].copy()
    timeless = t < 0
    if timeless.any() and (~timeless).sum() > 1 and np.isfinite(g["hint"]).all():
        known = np.argsort(g["hint"][~timeless], kind="stable")
        t[timeless] = np.interp(g["hint"][timeless], g["hint"][~timeless][known], np.sort(t[~timeless])).astype(np.int64)
        timeless[:] = False
    # A coarse time is taken for the middle of what it may mean, but only to order rows.
    order = np.lexsort((g["first_id"], t, timeless))
    values = np.column_stack([g[f] for f in fields])
    known = order[~timeless[order]]
    same = np.arange(n)
    same[known] = known[_same_reading(t[known], g["grain"][known], values[known])] if len(known) else known
    own = known[same[known] == known]
    out = {}
    for f in fields:
        value, high = g[f], g["high_" + f]
        impossible = (value < -5) | (value > high)
        reason = np.where(impossible, "impossible", "").astype(object)
        here = own[np.isfinite(value[own])]
        if len(here):
            stuck = _stuck(value[here], least_run)
            reason[here[stuck]] = "stuck"
            reason[impossible] = "impossible"
            calm = here[~stuck & ~impossible[here]]
            if len(calm) >= 5:
                scale = g["scale"][calm] + offset
                shifted = value[calm] + offset
                sparse = sparse_rest(shifted / scale, g["scale"][calm] > offset, rule)
                spike = jumps(t[calm], shifted, scale, rule, sparse)
                reason[calm[spike]] = "spike"
        out[f] = reason[same]
    return out


def flag(
    rows: DataFrame, *, source: str, row_id: str, time_us: str, fields: dict[str, Column], scale: Column | None = None, rule: Rule = Rule(), offset: float = 5.0,
    grain_s: str | None = None, hint: Column | None = None, near_us: Column | None = None, blocks: Blocks = Blocks(), least_run: int = 4,
) -> DataFrame:
    """`source, t, value_0 ..., first_id, last_id, copies, field, reason`: one row per implausible distinct reading.

    fields: value columns, each with the highest value that is physically possible. scale: expected daily course, 1 if
    none; `offset` is added to values and scale, for ratios near zero. grain_s: seconds to which the time was cut when
    sent; a row equal to a finer one within its grain is the same reading. hint: a quantity that grows with time within
    a source, by which rows without a time (-1 or null) are placed; near_us: an instant near their time. Without a hint
    such rows are only tested against limits. Rows with a null source are a source of their own; null values are never
    cases and don't interrupt a run; NaN counts as null. Readings further apart than the blocks' overlap aren't neighbours
    across a block's edge. An empty table gives an empty result.
    """
    # Inside, fields go by number, so that they may have any name.
    values = {f"value_{n}": f for n, f in enumerate(fields)}
    names, highs = list(values), dict(zip(values, fields.values()))
    wide = blocks.days * DAY_US
    at = F.coalesce(F.col(time_us), F.lit(-1))
    base = rows.select(
        F.col(source).alias("source"), F.col(row_id).alias("id"), at.alias("t"),
        (F.col(grain_s) if grain_s else F.lit(1)).cast("bigint").alias("grain"),
        (hint if hint is not None else F.lit(None)).cast("double").alias("hint"),
        (near_us if near_us is not None else at).cast("bigint").alias("near"),
        (scale if scale is not None else F.lit(1.0)).cast("double").alias("scale"),
        *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(v) for v, f in values.items()], *[high.cast("double").alias("high_" + v) for v, high in highs.items()],
    )
    base = base.where(" or ".join(f"`{f}` is not null" for f in names))
    firsts = [F.first(c).alias(c) for c in ("hint", "near", "scale", *["high_" + f for f in names])]
    home = F.floor(F.when(F.col("t") >= 0, F.col("t")).otherwise(F.col("near")) / F.lit(wide)).cast("int")
    readings = base.withColumn("home", home).groupBy("source", "home", "t", "grain", *names).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("copies"), *firsts)
    edge = F.when(F.col("t") >= 0, F.col("t")).otherwise(F.col("near")) - F.col("home") * F.lit(wide)
    reach = blocks.overlap_days * DAY_US
    readings = readings.withColumn(
        "block", F.explode(F.array_compact(F.array(F.col("home"), F.when(edge < reach, F.col("home") - 1), F.when(edge >= wide - reach, F.col("home") + 1))))
    )
    readings = readings.repartition("source", "block").sortWithinPartitions("source", "block", "t", "first_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finish(part: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            columns = {c: part[c].to_numpy() for c in part.columns}
            reasons = {f: np.full(len(part), "", dtype=object) for f in names}
            for a, b in zip(cuts[:-1], cuts[1:]):
                found = _one_source({c: x[a:b] for c, x in columns.items()}, names, rule, offset, least_run)
                for f in names:
                    reasons[f][a:b] = found[f]
            home_rows = columns["home"] == columns["block"]
            kept = []
            for f in names:
                hit = (reasons[f] != "") & home_rows
                kept.append(part.loc[hit, ["source", "t", *names, "first_id", "last_id", "copies"]].assign(field=values[f], reason=reasons[f][hit]))
            return pd.concat(kept)

        def group_of(row: pd.Series) -> tuple:
            return None if pd.isna(row["source"]) else row["source"], row["block"]

        # Rows come sorted; a group that goes on over many batches is put together once, at its end.
        held: list[pd.DataFrame] = []
        for batch in batches:
            if held and len(batch) and group_of(batch.iloc[-1]) == group_of(held[-1].iloc[-1]):
                held.append(batch)
                continue
            part = pd.concat([*held, batch], ignore_index=True) if held else batch
            if not len(part):
                continue
            source, block = pd.factorize(part["source"])[0], part["block"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (block[1:] != block[:-1])])
            held = [part.iloc[cuts[-1] :].reset_index(drop=True)]
            if len(cuts) > 1:
                yield finish(part.iloc[: cuts[-1]], cuts)
        if held:
            last = pd.concat(held, ignore_index=True)
            yield finish(last, np.array([0, len(last)]))

    kind = dict(base.dtypes)
    schema = ", ".join([f"source {kind['source']}", "t bigint", *[f"`{f}` double" for f in names], f"first_id {kind['id']}", f"last_id {kind['id']}", "copies bigint", "field string", "reason string"])
    return readings.mapInPandas(scan, schema)


def rows_of(flagged: DataFrame, rows: DataFrame, source: str, row_id: str, names: list[str], times) -> DataFrame:
    """`row_id, field, reason` of every row that holds a flagged reading.

    Readings sent once or twice name their rows themselves. For those sent more often, the rows with the same source and
    values are read again, whose times come by `times(rows)`, which adds `utc_us`; each such row meets its own reading only.
    """
    flagged = checkpointed(flagged)
    named = flagged.select(F.explode(F.array_distinct(F.array("first_id", "last_id"))).alias(row_id), "field", "reason")
    cells = [f"value_{n}" for n in range(len(names))]
    often = flagged.where("copies > 2").select(F.col("source").alias("_hit_source"), F.col("t").alias("_hit_t"), F.col("field").alias("_hit_field"), F.col("reason").alias("_hit_reason"), *[F.col(c).alias(f"_hit_{c}") for c in cells])
    # A stuck value is one key, however many readings hold it; its rows are spread over so many parts.
    parts = 16
    keys = often.select("_hit_source", *[f"_hit_{c}" for c in cells]).distinct().withColumn("_hit_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    number = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None))
    alike = F.col(source).eqNullSafe(F.col("_hit_source"))
    for c, f in zip(cells, names):
        alike = alike & number(f).eqNullSafe(F.col(f"_hit_{c}"))
    again = times(rows.join(keys, alike & (F.pmod(F.xxhash64(row_id), F.lit(parts)) == F.col("_hit_part")), "left_semi"))
    more = again.join(often, alike & (F.coalesce("utc_us", F.lit(-1)) == F.col("_hit_t"))).select(row_id, F.col("_hit_field").alias("field"), F.col("_hit_reason").alias("reason"))
    return named.unionByName(more).distinct()
