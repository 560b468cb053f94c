"""Records of two tables paired with the nearest in time of the same entity, by x-fast tries.

The instants of an entity, as integers of microseconds, are leaves of a binary trie. Every prefix of their bits that
occurs stands in a hash table of its length, with the least and greatest leaf below it. For a query instant, a binary
search over prefix lengths finds the longest prefix that occurs: its leaves on the side that the query doesn't share
hold the predecessor or the successor, and the linked leaves give the other. The nearer one within the tolerance is
the match; of equal instants and of equal distances, the smallest id counts.

An entity's time is cut into blocks, at least as wide as the tolerance, each with the records of the other table up to the tolerance beyond its edges, so
that a busy entity is spread over many tasks, and each trie holds one block. Equal instants are merged before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BITS = 27  # 134 seconds, or more for a tolerance beyond that


class XFastTrie:
    """Sorted distinct integers of `bits` bits; prefixes of each length in hash tables (pandas indexes)."""

    def __init__(self, leaves: np.ndarray, bits: int) -> None:
        self.leaves, self.bits = leaves, bits
        self.tables: list[pd.Index] = []
        self.least: list[np.ndarray] = []
        self.most: list[np.ndarray] = []
        for length in range(bits + 1):
            prefix, first = np.unique(leaves >> (bits - length), return_index=True)
            self.tables.append(pd.Index(prefix))
            self.least.append(first)
            self.most.append(np.r_[first[1:], len(leaves)] - 1)

    def around(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of predecessor (the query itself included) and successor of each query, -1 and len(leaves) if none."""
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), self.bits, np.int64)
        node = np.zeros(len(queries), np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            for length in np.unique(middle[low < high]):
                at = np.flatnonzero((middle == length) & (low < high))
                place = self.tables[length].get_indexer(queries[at] >> (self.bits - length))
                there = place >= 0
                low[at[there]], node[at[there]] = length, place[there]
                high[at[~there]] = length - 1
        before, after = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
        for length in np.unique(low):
            at = np.flatnonzero(low == length)
            if length == self.bits:
                before[at] = node[at]
                after[at] = node[at] + 1
                continue
            # The next bit leads to a child that doesn't exist: all leaves lie on the other side of the query.
            one = (queries[at] >> (self.bits - length - 1)) & 1 == 1
            before[at] = np.where(one, self.most[length][node[at]], self.least[length][node[at]] - 1)
            after[at] = before[at] + 1
        return before, after


def nearest(queries: np.ndarray, leaves: np.ndarray, ids: np.ndarray, tolerance: int) -> np.ndarray:
    """Place in `leaves` (sorted, distinct) of the match of each query, -1 if none is within the tolerance."""
    if not len(leaves) or not len(queries):
        return np.full(len(queries), -1)
    base = min(int(leaves[0]), int(queries.min()))
    bits = max(1, int(max(leaves[-1], queries.max()) - base).bit_length())
    before, after = XFastTrie(leaves - base, bits).around(queries - base)
    far = np.iinfo(np.int64).max
    back = np.where(before >= 0, queries - leaves[np.maximum(before, 0)], far)
    ahead = np.where(after < len(leaves), leaves[np.minimum(after, len(leaves) - 1)] - queries, far)
    smaller = ids[np.maximum(before, 0)] <= ids[np.minimum(after, len(leaves) - 1)]
    first = (back < ahead) | ((back == ahead) & smaller)
    return np.where(np.minimum(back, ahead) <= tolerance, np.where(first, before, after), -1)


def micros(epoch: str) -> Column:
    """Epoch seconds, as a number or text, in whole microseconds; null for null, NaN and infinity."""
    seconds = F.col(epoch).try_cast("double")
    return F.when(F.abs(seconds) < 1e12, F.round(seconds * 1e6).cast("bigint"))


def match(left: DataFrame, right: DataFrame, *, entity: str, left_id: str, left_time: str, right_id: str, right_time: str, tolerance_s: float) -> DataFrame:
    """`left_id, match_id, delta_s` of every left row that has a right row of its entity within the tolerance, either side.

    Times are epoch seconds; `delta_s` is right minus left. Left rows with null or NaN times or entities have no match, nor
    have those whose entity has no right row near enough; every other left row, repeats included, comes out once. Clashing names don't
    matter. Empty tables give an empty result.
    """
    reach = round(tolerance_s * 1e6)
    bits = max(BLOCK_BITS, reach.bit_length())
    ask = left.select(F.col(entity).alias("entity"), F.col(left_id).alias("id"), micros(left_time).alias("t")).where("entity is not null and t is not null")
    have = right.select(F.col(entity).alias("entity"), F.col(right_id).alias("id"), micros(right_time).alias("t")).where("entity is not null and t is not null and id is not null")
    block = lambda t: F.shiftright(t, bits)
    # Each distinct instant once: queries are answered by instant, and of equal instants the smallest id counts.
    instants = ask.select("entity", "t").distinct().withColumn("block", block(F.col("t")))
    leaves = have.groupBy("entity", "t").agg(F.min("id").alias("id"))
    leaves = leaves.withColumn("block", F.explode(F.sequence(block(F.col("t") - reach), block(F.col("t") + reach))))
    kinds = dict(ask.dtypes), dict(have.dtypes)

    def answer(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("t", kind="stable")
        t, leaf, ids = asked["t"].to_numpy(), there["t"].to_numpy(), there["id"].to_numpy()
        place = nearest(t, leaf, ids, reach)
        hit = place >= 0
        return pd.DataFrame({"entity": asked["entity"].to_numpy()[hit], "t": t[hit], "match_id": ids[place[hit]], "delta_s": (leaf[place[hit]] - t[hit]) / 1e6})

    schema = f"entity {kinds[0]['entity']}, t bigint, match_id {kinds[1]['id']}, delta_s double"
    answers = instants.groupBy("entity", "block").cogroup(leaves.groupBy("entity", "block")).applyInPandas(answer, schema)
    return ask.join(answers, ["entity", "t"]).select(F.col("id").alias(left_id), "match_id", "delta_s")
