import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliovox.operators import spikes as S

DAY, HOUR = S.DAY_US, 3_600_000_000


def course(days=6, step=HOUR // 2, seed=1):
    rng = random.Random(seed)
    t = np.arange(0, days * DAY, step)
    scale = np.array([max(0.0, math.sin(math.pi * ((x % DAY) / DAY - 0.25) * 2)) * 900 for x in t])
    value = np.array([round(s * 0.7 * (1 + 0.03 * rng.gauss(0, 1)) - rng.random(), 3) for s in scale])
    return t, scale, value


RULE = S.Rule(usual=3.0, up=0.55, down=0.73, floor=0.02)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, source string, t long, v double, scale double, grain int").selectExpr("*", "1 as home", "2 as block", "3 as copies", "'x' as reason")
    out = S.flag(df, source="source", row_id="id", time_us="t", fields={"v": F.lit(1500.0)}, scale=F.col("scale"), rule=RULE, offset=20.0, grain_s="grain", **kw)
    return {(r["first_id"], r["reason"]) for r in out.collect()}, df, out


@pytest.mark.parametrize("days", [1, 6, 80])
def test_planted_values_are_found_and_nothing_else(spark, days):
    t, scale, value = course(days)
    noon = [i for i, x in enumerate(t) if x % DAY == 12 * HOUR]
    i = noon[len(noon) // 2]
    value[i] *= 2.1  # one reading
    value[i + 4 : i + 6] = value[i + 4 : i + 6] * 1.9  # two readings
    night = i - 20
    value[night] = -300.0
    value[night - 4 : night] = -0.4
    last = noon[-1] if days > 1 else None
    if last:
        value[last] = 3.0
        value[last + 3] = 99999.0
    rows = [(n, "a", int(x), float(v), float(s), 1) for n, (x, v, s) in enumerate(zip(t, value, scale))]
    got, _, _ = run(spark, rows)
    expected = {(i, "spike"), (i + 4, "spike"), (i + 5, "spike"), (night, "impossible"), *[(n, "stuck") for n in range(night - 4, night)]}
    if last:
        expected |= {(last, "spike"), (last + 3, "impossible")}
    assert got == expected


def test_lasting_changes_and_weather_are_kept(spark):
    t, scale, value = course(6)
    value[100:200] *= 0.4  # a change of level
    rows = [(n, "a", int(x), float(v), float(s), 1) for n, (x, v, s) in enumerate(zip(t, value, scale))]
    got, _, _ = run(spark, rows)
    assert {r for _, r in got} <= {"spike"} and len(got) <= 1


def test_edge_cases(spark):
    t, scale, value = course(3)
    rows = [(n, "a", int(x), float(v), float(s), 1) for n, (x, v, s) in enumerate(zip(t, value, scale))]
    spike = next(r for r in rows if r[4] > 800)
    bad = (spike[0], "a", spike[2], 1400.0, spike[4], 1)
    rows[spike[0]] = bad
    rows += [(1000, *bad[1:]), (1001, *bad[1:])]  # sent again, twice
    rows += [(1002, "a", bad[2] // 60_000_000 * 60_000_000, 1400.0, bad[4], 3600)]  # and with a coarser time
    rows += [(1003, None, 0, 5000.0, 1.0, 1), (1004, "b", None, -50.0, 1.0, 1), (1005, "b", 5, None, 1.0, 1), (1006, "b", 6, float("nan"), 1.0, 1), (1007, "c", -1, 3.0, 1.0, 1)]
    got, df, out = run(spark, rows)
    assert (1003, "impossible") in got and (1004, "impossible") in got
    assert (spike[0], "spike") in got and (1002, "spike") in got
    found = S.rows_of(out, df, "source", "id", ["v"], lambda some: some.withColumn("utc_us", F.coalesce(df["t"], F.lit(-1))))
    assert {r["id"] for r in found.collect() if r["reason"] == "spike"} == {spike[0], 1000, 1001, 1002}
    assert S.flag(df.limit(0), source="source", row_id="id", time_us="t", fields={"v": F.lit(1.0)}).count() == 0


def test_low_rank_part_leaves_sparse_spikes():
    rng = np.random.default_rng(0)
    m = np.outer(rng.uniform(1, 2, 20), np.sin(np.linspace(0, 3, 48))) + 0.001 * rng.standard_normal((20, 48))
    truth = rng.random(m.shape) < 0.02
    gap = np.abs(m + 3 * truth - S.low_rank(m + 3 * truth, 1))
    assert gap[truth].min() > 2.5 and gap[~truth].max() < 0.2


def test_plain_reading_between_two_jumps():
    t, scale, value = course(4)
    i = [k for k, x in enumerate(t) if x % DAY == 12 * HOUR][1]
    value[i - 1], value[i + 1] = 5.0, 9.0
    found = np.flatnonzero(S.jumps(t, value + 20, scale + 20, RULE))
    assert found.tolist() == [i - 1, i + 1]


def test_null_numbers_as_sources_are_one_source(spark):
    t, scale, value = course(3)
    value[50:54] = 123.0
    rows = [(n, None if n % 2 else 1, int(x), 123.0 if 50 <= n < 60 else float(v), float(s), 1) for n, (x, v, s) in enumerate(zip(t, value, scale))]
    df = spark.createDataFrame(rows, "id long, source long, t long, v double, scale double, grain int")
    out = S.flag(df.withColumnRenamed("v", "copies"), source="source", row_id="id", time_us="t", fields={"copies": F.lit(1500.0)}, scale=F.col("scale"), rule=RULE, offset=20.0)
    assert {r["first_id"] for r in out.where("reason = 'stuck'").collect()} == set(range(50, 60))


def test_jump_on_a_slope_and_a_plain_valley():
    rule = S.Rule(slopes=True)
    t = np.arange(60) * 60_000_000
    slope = 300 + 12.0 * np.arange(60)
    slope[30] += 90
    assert np.flatnonzero(S.jumps(t, slope, np.ones(60), rule)).tolist() == [30]
    valley = 400 - 150 * np.exp(-(((np.arange(60) - 30) / 4.0) ** 2))
    assert not S.jumps(t, valley, np.ones(60), rule).any()
    assert not S.jumps(t, np.where(np.arange(60) < 30, 200.0, 500.0), np.ones(60), rule).any()


def test_without_the_sparse_rest_there_are_no_spikes(spark, monkeypatch):
    t, scale, value = course(6)
    i = next(k for k, x in enumerate(t) if x % DAY == 12 * HOUR)
    value[i] *= 2.2
    rows = [(n, "a", int(x), float(v), float(s), 1) for n, (x, v, s) in enumerate(zip(t, value, scale))]
    assert (i, "spike") in run(spark, rows)[0]
    monkeypatch.setattr(S, "low_rank", lambda m, rank, rounds=3: m)
    assert not run(spark, rows)[0]


def test_sparse_rest_is_a_small_part_and_holds_spikes_under_weather():
    rng = np.random.default_rng(3)
    t, scale, value = course(30, seed=5)
    clouds = np.repeat(rng.uniform(0.3, 1.0, len(t) // 6 + 1), 6)[: len(t)]  # a cover that stays for three hours
    value = value * clouds
    at = [k for k in range(20, len(t) - 20, 53) if scale[k] > 400]
    value[at] *= 3.5
    sparse = S.sparse_rest((value + 20) / (scale + 20), scale > 20, RULE)
    assert sparse[at].mean() > 0.95 and sparse.mean() < 0.35


def test_many_texts_without_a_clock_time():
    rng = np.random.default_rng(1)
    n = 100_000
    t = np.sort(rng.integers(0, 40, n) * DAY + np.where(rng.random(n) < 0.5, 0, rng.integers(0, DAY, n)))
    grain = np.where(t % DAY == 0, 86400, 1)
    values = np.round(rng.random((n, 1)), 3)
    values[:50, 0] = np.nan
    same = S._same_reading(t, grain, values)
    for i in rng.integers(0, n, 300):
        j = next((j for j in range(int(np.searchsorted(t, t[i])), n if grain[i] > 1 else 0) if t[j] < t[i] + grain[i] * 1_000_000 and grain[j] < grain[i] and np.array_equal(values[j], values[i], equal_nan=True)), i)
        assert same[i] == j or (t[same[i]] == t[j] and values[same[i], 0] == values[j, 0])


def test_a_stuck_value_sent_three_times(spark):
    n = 20_000
    rows = spark.range(3 * n).selectExpr("id", "'a' as source", f"(id % {n}) * 60000000L as t", "7.5D as v", "1D as scale", "1 as grain")
    out = S.flag(rows, source="source", row_id="id", time_us="t", fields={"v": F.lit(1500.0)}, scale=F.col("scale"), rule=RULE, offset=20.0, grain_s="grain")
    found = S.rows_of(out, rows, "source", "id", ["v"], lambda some: some.withColumn("utc_us", F.col("t")))
    assert found.where("reason = 'stuck'").count() == found.count() == 3 * n
