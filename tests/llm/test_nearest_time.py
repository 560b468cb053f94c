import numpy as np
from hypothesis import given, settings, strategies as st

from heliovox.llm import nearest_time as N


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.lists(st.integers(0, 6000), min_size=1, max_size=40), st.integers(0, 900))
def test_trie_against_brute_force(times, queries, tolerance):
    leaves = np.unique(np.array(times, dtype=np.int64))
    ids = np.random.default_rng(len(times)).permutation(len(leaves))
    got = N.nearest(np.array(queries, dtype=np.int64), leaves, ids, tolerance)
    for q, place in zip(queries, got):
        near = [(abs(int(t) - q), int(i)) for t, i in zip(leaves, ids) if abs(int(t) - q) <= tolerance]
        assert (place == -1) == (not near)
        if near:
            assert (abs(int(leaves[place]) - q), int(ids[place])) == min(near)


def test_over_tables(spark):
    t0 = float(1 << N.BLOCK_BITS) * 13 / 1e6  # an edge between blocks
    left = spark.createDataFrame([(1, 7, t0), (2, 7, t0 - 0.01), (3, 7, None), (4, 7, float("nan")), (5, 8, t0), (6, 7, t0), (7, None, t0), (8, 7, t0 + 500.0)], "frame_id long, s int, t double").selectExpr("*", "1 as match_id", "2 as block")
    right = spark.createDataFrame([(30, 7, t0 - 0.1), (20, 7, t0 + 0.1), (10, 7, t0 + 0.1), (40, 7, None), (50, 9, t0)], "pose_id long, s int, t double")
    args = dict(entity="s", left_id="frame_id", left_time="t", right_id="pose_id", right_time="t")
    got = {(r["frame_id"], r["match_id"]) for r in N.match(left, right, **args, tolerance_s=0.15).collect()}
    assert got == {(1, 10), (6, 10), (2, 30)}
    assert {(r["frame_id"], r["match_id"]) for r in N.match(left, right, **args, tolerance_s=0.1).collect()} == {(1, 10), (6, 10), (2, 30)}
    assert N.match(left, right, **args, tolerance_s=0.05).count() == 0
    assert N.match(left.limit(0), right, **args, tolerance_s=1).count() == 0
    assert N.match(left, right.limit(0), **args, tolerance_s=1).count() == 0


def test_tolerance_beyond_a_block(spark):
    left = spark.createDataFrame([(1, 7, 10_000.0), (2, 7, 30_000.0)], "frame_id long, s int, t double")
    right = spark.createDataFrame([(10, 7, 10_400.0), (20, 7, 9_510.0), (30, 7, 30_501.0)], "pose_id long, s int, t double")
    got = N.match(left, right, entity="s", left_id="frame_id", left_time="t", right_id="pose_id", right_time="t", tolerance_s=500).collect()
    assert [(r["frame_id"], r["match_id"], r["delta_s"]) for r in got] == [(1, 10, 400.0)]
