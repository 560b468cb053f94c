"""Items of varying length into containers of fixed capacity, with a controlled mixture of sources.

Items longer than a container are cut into full containers and a rest. All are dealt over shards of bounded size, and
each shard fills its containers by deficit round-robin: the source that is furthest behind its target share of tokens
opens a container with its largest item, then sources give, in order of their deficits, the largest item that their
deficit pays for, and when little room is left, whichever source closes it best. Deficits carry over from container
to container, and from shard to shard: what shards before leave behind is known from their totals per source, so shards
are filled side by side and still continue each other. The emptiest containers of each shard are filled again
together, in rounds of ever fewer groups, with the deficits that the finished ones left, so that no shard ends in
half-empty ones.

Only ids, sizes and sources are read and moved. A shard is bounded in tokens, hence in rows, whatever the sources' sizes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from heliovox.session import checkpointed

CAPACITY = 2048
SHARD_TOKENS = 4_000_000
FAN_IN, TAIL = 256, 64
QUEUES = 256
# Shards whose totals are summed in one task.
SHARD_BLOCK = 1024
# Without a deficit that pays for more, a source may still give an item of this part of a container; a container with less than that other part free is just closed.
LEAST_TURN, CLOSING = 64, 8
NO_SOURCE, OTHERS = "\0", "\1"


class Stock:
    """The items of one source by size, as stacks, with a bit per size that has any."""

    def __init__(self) -> None:
        self.by_size: dict[int, list[int]] = {}
        self.bits = 0

    def add(self, size: int, item: int) -> None:
        self.by_size.setdefault(size, []).append(item)
        self.bits |= 1 << size

    def largest(self, room: int) -> int:
        """The largest size there is up to `room`, 0 if none."""
        return (self.bits & ((2 << room) - 1)).bit_length() - 1 if self.bits else 0

    def take(self, size: int) -> int:
        items = self.by_size[size]
        item = items.pop()
        if not items:
            self.bits ^= 1 << size
        return item


def fill(sizes: list[int], sources: list, targets: dict, behind: dict, capacity: int) -> list[int]:
    """The container of each item, numbered from 0. targets: share of tokens per source; behind: tokens it is behind at the start."""
    stocks: dict = {}
    for item in range(len(sizes) - 1, -1, -1):
        stocks.setdefault(sources[item], Stock()).add(sizes[item], item)
    owed = {s: float(behind.get(s, 0.0)) for s in stocks}
    out = [0] * len(sizes)
    container, room, left = 0, capacity, len(sizes)
    while left:
        best, size = None, 0
        if room > capacity // CLOSING:
            turns = sorted(owed, key=lambda s: (-owed[s], str(s)))
            if room < capacity:
                for s in turns:
                    if (size := stocks[s].largest(int(min(room, max(owed[s], capacity // LEAST_TURN))))) > 0:
                        best = s
                        break
            for s in turns if best is None else ():
                if (size := stocks[s].largest(room)) > 0:
                    best = s
                    break
        else:
            for s in stocks:
                k = stocks[s].largest(room)
                if k > 0 and (k > size or k == size and owed[s] > owed[best]):
                    best, size = s, k
        if best is None:
            container, room = container + 1, capacity
            continue
        out[stocks[best].take(size)] = container
        room -= size
        left -= 1
        for s in owed:
            owed[s] += targets.get(s, 0.0) * size
        owed[best] -= size
        if not stocks[best].bits:
            del stocks[best], owed[best]
    return out


def _pieces(items: DataFrame, item_id: str, size: str, source: str, capacity: int) -> DataFrame:
    n = F.col(size).cast("bigint")
    # The number tells apart containers of rows that share an id; it is the same whenever the same split is read.
    rows = items.select(F.col(item_id).alias("id"), n.alias("n"), F.col(source).cast("string").alias("source"), F.monotonically_increasing_id().alias("row")).where("n > 0")
    return rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})"))).select(
        "row", "id", F.col("piece").cast("int").alias("piece"), "source", F.expr(f"cast(least(n - piece * {capacity}, {capacity}) as int)").alias("size")
    )


def _left_behind(rows: DataFrame, key: str, names: list[str], targets: dict[str, float]) -> DataFrame:
    """Per `key`, an array of how many tokens each queue of `names` lacks to its target in these rows."""
    got = rows.groupBy(key, "queue").agg(F.sum("size").alias("got")).groupBy(key).agg(F.sum("got").alias("all"), F.map_from_entries(F.collect_list(F.struct("queue", "got"))).alias("got"))
    short = [F.col("all") * F.lit(targets[s]) - F.coalesce(F.try_element_at("got", F.lit(s)), F.lit(0)) for s in names]
    return got.select(key, F.array(*short).cast("array<double>").alias("short"))


def _before(shards: DataFrame, names: list[str]) -> DataFrame:
    """`shard, behind`: the sums of `short` over the shards before, in two levels, so that no task holds more than a block of shards."""
    sums = lambda c, over: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))).over(over), F.lit(0.0)) for i in range(len(names))])
    shards = shards.withColumn("block", F.floor(F.col("shard") / SHARD_BLOCK).cast("int"))
    whole = shards.groupBy("block").agg(F.array(*[F.sum(F.get("short", F.lit(i))) for i in range(len(names))]).alias("block_short"))
    so_far = whole.select("block", sums("block_short", Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("blocks_before"))
    within = shards.withColumn("in_block", sums("short", Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    return within.join(so_far, "block").select("shard", F.zip_with("in_block", "blocks_before", lambda a, b: a + b).alias("behind"))


def pack(items: DataFrame, *, item_id: str = "doc_id", size: str = "n_tokens", source: str = "source", capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, targets: dict[str | None, float] | None = None) -> DataFrame:
    """`item_id, piece, source, size, container`: the container of each item, or of each piece of longer ones.

    Every row with a positive size comes out exactly once, or once per piece; null, zero and negative sizes have
    nothing to place and are left out. No container exceeds the capacity. A null source is a source of its own. Rows with the same id are separate
    items. An empty table gives an empty result. targets: weights of sources in the mixture, the sources' own shares
    if not given; sources without a weight are placed when no other has anything that fits.
    """
    pieces = _pieces(items, item_id, size, source, capacity).withColumn("queue", F.coalesce("source", F.lit(NO_SOURCE)))
    sums = pieces.groupBy("queue").agg(F.sum("size").alias("n"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    per_queue = {r["queue"]: r["n"] for r in sums.orderBy(F.desc("n"), "queue").limit(QUEUES - 1).collect()}
    if sum(per_queue.values()) < total:
        # Sources beyond the largest share one queue; they are all placed, as a mixture of their own.
        pieces = pieces.withColumn("queue", F.when(F.col("queue").isin(*per_queue), F.col("queue")).otherwise(OTHERS))
        per_queue[OTHERS] = total - sum(per_queue.values())
    shards = max(1, -(-total // shard_tokens))
    if targets is None:
        shares = {s: n / total for s, n in per_queue.items()}
    else:
        asked = {NO_SOURCE if s is None else s: w for s, w in targets.items()}
        weights = {s: asked.get(s, 0.0) for s in per_queue} | ({OTHERS: sum(w for s, w in asked.items() if s not in per_queue)} if OTHERS in per_queue else {})
        shares = {s: w / (sum(weights.values()) or 1.0) for s, w in weights.items()}
    names = sorted(shares)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "id", "piece"), F.lit(shards)).cast("int")).drop("row")
    behind = _before(_left_behind(dealt, "shard", names, shares), names)

    def fill_shard(key: tuple, rows: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
        place = fill(rows["size"].tolist(), rows["queue"].tolist(), shares, dict(zip(names, carried["behind"].iloc[0])), capacity)
        return _keep_tail(rows.assign(container=[f"0-{key[0]}-{c}" for c in place]), capacity)

    kind = dict(dealt.dtypes)["id"]
    schema = f"id {kind}, piece int, source string, queue string, size int, shard int, container string, open boolean"
    done = dealt.groupBy("shard").cogroup(behind.withColumnRenamed("shard", "of").groupBy("of")).applyInPandas(fill_shard, schema)
    level = 1
    while True:
        done = checkpointed(done)
        group = F.expr(f"shard div {FAN_IN}").cast("int")
        closed = _left_behind(done.where("not open").withColumn("shard", group), "shard", names, shares)
        refilled = done.where("open").withColumn("shard", group).groupBy("shard").cogroup(closed.withColumnRenamed("shard", "of").groupBy("of")).applyInPandas(_refill(level, names, shares, capacity), schema)
        done = done.where("not open").withColumn("shard", group).unionByName(refilled)
        shards, level = -(-shards // FAN_IN), level + 1
        if shards <= 1:
            break
    return done.select("id", "piece", "source", "size", "container").withColumnRenamed("id", item_id)


def _refill(level: int, names: list[str], shares: dict[str, float], capacity: int):
    def refill(key: tuple, rows: pd.DataFrame, closed: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _keep_tail(rows.assign(container=[], open=[]), capacity)
        rows = rows.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
        behind = dict(zip(names, closed["short"].iloc[0])) if len(closed) else {}
        place = fill(rows["size"].tolist(), rows["queue"].tolist(), shares, behind, capacity)
        if max(place) + 1 < rows["container"].nunique():
            rows = rows.assign(container=[f"{level}-{key[0]}-{c}" for c in place])
        return _keep_tail(rows, capacity)

    return refill


def _keep_tail(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """`rows` with `open`, true in the emptiest containers, at most `TAIL` of them, which another round may fill better."""
    used = rows.groupby("container")["size"].sum()
    slack = used[used < capacity * 0.99].nsmallest(TAIL).index
    return rows.assign(open=rows["container"].isin(slack))[["id", "piece", "source", "queue", "size", "shard", "container", "open"]]


def report(packed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, the fewest there could be by size alone, and the share of room filled."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / F.lit(capacity)).alias("fewest"), F.try_divide(F.sum("used").cast("double"), F.count("*") * F.lit(float(capacity))).alias("filled"),
    )


def mixture(packed: DataFrame, *, source: str = "source", targets: dict[str | None, float] | None = None, windows: tuple[int, ...] = (1, 16, 256)) -> DataFrame:
    """`window_size, windows, mean_distance, p90_distance, mean_least`: how far windows of containers are from the targets.

    A window is so many containers that were filled in succession. Its distance is half the sum of differences between
    shares of tokens and targets, 0 for the very mixture and 1 for none of it. `mean_least` is the least mean that the
    largest item of each container leaves possible, for windows of one container, null for wider ones. targets as in
    `pack`. Empty tables give no rows.
    """
    rows = packed.select(F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("queue"), "size", F.regexp_extract("container", "^(.*)-[0-9]+$", 1).alias("run"), F.regexp_extract("container", "([0-9]+)$", 1).cast("bigint").alias("n"))
    if targets is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
        wanted = rows.groupBy("queue").agg((F.sum("size") / F.lit(total)).alias("target"))
    else:
        whole = sum(targets.values()) or 1.0
        wanted = packed.sparkSession.createDataFrame([(NO_SOURCE if s is None else s, float(w / whole)) for s, w in targets.items()], "queue string, target double")
    parts = rows.groupBy("run", "n", "queue").agg(F.sum("size").alias("size"), F.max("size").alias("largest"))
    parts = parts.withColumn("window_size", F.explode(F.array(*[F.lit(w) for w in windows]))).withColumn("window", F.floor(F.col("n") / F.col("window_size")))
    per = parts.groupBy("window_size", "run", "window", "queue").agg(F.sum("size").alias("size"), F.max("largest").alias("largest")).join(wanted, "queue", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    key = ["window_size", "run", "window"]
    top = F.max_by("target", "largest")
    each = per.groupBy(*key).agg(F.sum("size").alias("all"), F.collect_list(F.struct("size", "target")).alias("x"), F.max("largest").alias("largest"), top.alias("top"))
    # Of sources that a window lacks, the whole target is missing.
    distance = F.expr("(aggregate(x, 0D, (s, y) -> s + abs(y.size / all - y.target) - y.target) + 1) / 2")
    least = F.when(F.col("window_size") == 1, F.greatest(F.lit(0.0), F.col("largest") / F.col("all") - F.col("top")))
    each = each.select("window_size", distance.alias("d"), least.alias("least"))
    return each.groupBy("window_size").agg(F.count("*").alias("windows"), F.avg("d").alias("mean_distance"), F.percentile_approx("d", 0.9, 10_000).alias("p90_distance"), F.avg("least").alias("mean_least"))
