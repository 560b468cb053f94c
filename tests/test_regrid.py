import random

import pytest

from heliovox.operators import regrid as R


def brute(rows, step):
    """Per source: period -> (readings, mean, coverage), from the definition."""
    out = {}
    for source in {r[0] for r in rows}:
        ours = sorted((t, v) for s, t, v in rows if s == source and t is not None and t >= 0 and v is not None and v == v)
        if not ours:
            continue
        cells = {}
        for k, (t, v) in enumerate(ours):
            end = min(t + step, ours[k + 1][0] if k + 1 < len(ours) else t + step)
            cells.setdefault(t // step, [0, 0, 0.0])[0] += 1
            for c in (t // step, t // step + 1):
                held = max(0, min(end, (c + 1) * step) - max(t, c * step))
                if held:
                    cell = cells.setdefault(c, [0, 0, 0.0])
                    cell[1] += held
                    cell[2] += v * held
        full = [c for c, x in cells.items() if x[0]]
        for c in range(min(full), max(full) + 1):
            n, held, area = cells.get(c, (0, 0, 0.0))
            out[source, c * step] = (n, round(area / held, 6) if held else None, round(held / step, 9))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_definition(spark, seed):
    rng = random.Random(seed)
    step = 60
    rows = []
    for s in (1, 2, 3, None):
        t = rng.randrange(10**15, 10**15 + 10**10)
        for _ in range(300):
            t += int(rng.choice([0, 5, 30, 61, 60, 200, 60 * 600]) * 1e6 * rng.random()) if rng.random() > 0.01 else 60_000_000 * R.CHUNK * 3
            rows.append((s, t, rng.choice([None, float("nan"), 1.0, 2.5, -3.0])))
    rows += [(1, None, 4.0), (1, -1, 4.0), (9, 5, None)]
    df = spark.createDataFrame([(*r, step) for r in rows], "k int, t long, v double, step int").selectExpr("*", "1 as slot", "2 as chunk", "3 as cells")
    got = {(r["k"], r["slot_us"]): (r["n_readings"], None if r["mean"] is None else round(r["mean"], 6), round(r["coverage"], 9)) for r in R.regrid(df, source="k", time_us="t", value="v", step_s="step").collect()}
    assert got == brute(rows, step * 1_000_000)


def test_status_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 60), (1, 59_000_000, 2.0, 60), (1, 300_000_000, 3.0, 60), (2, 7, 1.0, None), (2, 7, 1.0, 0)], "k int, t long, v double, step int")
    out = R.regrid(df, source="k", time_us="t", value="v", step_s="step")
    assert [r["status"] for r in out.orderBy("slot_us").collect()] == ["observed", "held", "empty", "empty", "empty", "observed"]
    assert R.regrid(df.limit(0), source="k", time_us="t", value="v", step_s="step").count() == 0
