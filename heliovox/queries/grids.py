"""Lattice and voting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliovox.operators import lattice, vote
from heliovox.queries.base import EVENT_POINTS, POINTS, event_points, events, points
from heliovox.session import table

_CELLS = "cast(floor(x / {s}) as bigint) i, cast(floor(y / {s}) as bigint) j, cast(floor(z / {s}) as bigint) k"


def _cells(size: str, source: str = POINTS) -> str:
    return f"(select *, {_CELLS.format(s=size)} from {source})"


def voxel_thermal_map(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of a measured value, with the majority class, per cell."""
    p = event_points(spark, d)
    stats = lattice.cell_stats(p, 10.0, value="value")
    classes = lattice.voxels(p, 10.0, label="event_type").select("i", "j", "k", F.col("label").alias("event_type"))
    return stats.join(classes, ["i", "j", "k"]).select("i", "j", "k", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "event_type")


def voxel_group_majority(spark: SparkSession, d: str) -> DataFrame:
    return lattice.voxels(points(spark, d), 0.1, label="label", least=2, classes=19).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "cz")})


def voxel_distinct(spark: SparkSession, d: str) -> DataFrame:
    return lattice.distinct_cells(points(spark, d), 0.05)


def voxel_first_point(spark: SparkSession, d: str) -> DataFrame:
    return lattice.first_per_cell(event_points(spark, d), 20.0, order="event_id", keep=["value"])


def voxel_grid_average(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
    return lattice.grid_average(rows, 5.0).withColumns({a: F.round(a, 6) + F.lit(0.0) for a in "xyz"})


def voxel_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return lattice.cell_stats(event_points(spark, d), 25.0, value="value").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def voxel_two_scale(spark: SparkSession, d: str) -> DataFrame:
    return lattice.two_scale(event_points(spark, d), 50.0, 10.0, value="value").withColumn("mean", F.round("mean", 6))


def voxel_packed_key(spark: SparkSession, d: str) -> DataFrame:
    cells = lattice.distinct_cells(points(spark, d), 0.1)
    return cells.select("i", "j", "k", lattice.packed(F.col("i"), F.col("j"), F.col("k")).alias("key"))


def octree_voxels(spark: SparkSession, d: str) -> DataFrame:
    return lattice.octree_voxels(points(spark, d), 4, label="label")


def octree_level_counts(spark: SparkSession, d: str) -> DataFrame:
    return lattice.level_counts(points(spark, d), 5)


def coarse_to_fine_broadcast(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    coarse = lattice.voxels(p.where("label < 5"), 0.2, label="label").select("i", "j", "k", F.col("label").alias("coarse_label"), F.col("n").alias("coarse_n"))
    return lattice.onto_grid(lattice.distinct_cells(p, 0.1), coarse, 2, ["coarse_label", "coarse_n"]).fillna(-1)


def grid_join_unmatched(spark: SparkSession, d: str) -> DataFrame:
    p = lattice.with_cells(event_points(spark, d), 10.0)
    return lattice.join_report(p.where("event_id % 2 = 1"), p.where("event_id % 2 = 0"))


def grid_difference(spark: SparkSession, d: str) -> DataFrame:
    """Cells that one class occupies and another doesn't."""
    p = lattice.with_cells(event_points(spark, d), 20.0)
    return p.where("event_type = 'view'").select("i", "j", "k").subtract(p.where("event_type = 'error'").select("i", "j", "k"))


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select((F.col("user_id") % 20).alias("cell"), F.col("event_type").alias("material"), (F.col("value") / 500).alias("conf"), (F.hour("ts") / 4.0).alias("depth"))
    return vote.weighted(rows, ["cell"], "material", conf="conf", depth="depth", power=2.0, floor=0.02).withColumns({c: F.round(c, 6) for c in ("weight", "share")})


def vote_mass_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.col("user_id").alias("segment"), (F.col("event_id") % 40).alias("cell"), F.col("event_type").alias("material"), (F.col("value") / 500).alias("conf"))
    votes = vote.masses(rows, ["cell"], "material", conf="conf")
    hits = rows.groupBy("segment", "cell").agg(F.count("*").alias("hits"))
    return vote.pool(hits, votes, "segment", ["cell"], "material").withColumns({c: F.round(c, 6) for c in ("mass", "agreement")})


def two_level_majority(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return vote.two_level(rows, "l_partkey", "l_suppkey", "l_returnflag").withColumn("confidence", F.round("confidence", 6))


def votes_per_voxel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_shipdate")
    per = rows.groupBy("l_partkey").agg(F.count_distinct("l_shipdate").alias("k"))
    return per.agg(F.round(F.avg("k"), 6).alias("mean_k"), F.max("k").alias("max_k"), F.round(F.avg((F.col("k") > 1).cast("double")), 6).alias("share_mixed"))


def class_share(spark: SparkSession, d: str) -> DataFrame:
    return vote.shares(table(spark, d, "part"), "p_type").withColumn("share", F.round("share", 6))


def vocabulary_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return vote.vocabulary(events(spark, d), "event_type", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        voxel_thermal_map, voxel_group_majority, voxel_distinct, voxel_first_point, voxel_grid_average, voxel_mean_std, voxel_two_scale, voxel_packed_key, octree_voxels,
        octree_level_counts, coarse_to_fine_broadcast, grid_join_unmatched, grid_difference, weighted_vote, vote_mass_pool, two_level_majority, votes_per_voxel, class_share,
        vocabulary_first_seen,
    )
}

_OCT = f"""
b as (select min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from {POINTS}),
c as (select *, greatest(hx - lx, hy - ly, hz - lz) e from b),
o as (select p.*, least(greatest(cast(floor((x - ((lx + hx) / 2 - e / 2)) / (e / {{n}}.0)) as bigint), 0), {{n}} - 1) i,
  least(greatest(cast(floor((y - ((ly + hy) / 2 - e / 2)) / (e / {{n}}.0)) as bigint), 0), {{n}} - 1) j,
  least(greatest(cast(floor((z - ((lz + hz) / 2 - e / 2)) / (e / {{n}}.0)) as bigint), 0), {{n}} - 1) k from {POINTS} p, c)"""
_WINNER = "select i, j, k, {label} from (select *, row_number() over (partition by i, j, k order by v desc, {label}) r from (select i, j, k, {label}, count(*) v from {src} group by all)) where r = 1"

SQL = {
    "voxel_thermal_map": f"""with c as {_cells('10.0', EVENT_POINTS)}, s as (select i, j, k, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std from c group by 1, 2, 3)
        select s.*, w.event_type from s join ({_WINNER.format(label='event_type', src='c')}) w using (i, j, k)""",
    "voxel_group_majority": f"""with c as (select * replace (least(greatest(label, 0), 18) as label) from {_cells('0.1')}), s as (select i, j, k, count(*) n from c group by 1, 2, 3)
        select i, j, k, round((i + 0.5) * 0.1::double, 6) cx, round((j + 0.5) * 0.1::double, 6) cy, round((k + 0.5) * 0.1::double, 6) cz, n, label
        from s join ({_WINNER.format(label='label', src='c')}) using (i, j, k) where n >= 2""",
    "voxel_distinct": f"select distinct i, j, k from {_cells('0.05')}",
    "voxel_first_point": f"select i, j, k, event_id, value from (select *, row_number() over (partition by i, j, k order by event_id) r from {_cells('20.0', EVENT_POINTS)}) where r = 1",
    "voxel_grid_average": f"""select i, j, k, round(avg(x), 6) + 0.0 x, round(avg(y), 6) + 0.0 y, round(avg(z), 6) + 0.0 z, count(*) n
        from {_cells('5.0', '(select l_quantity x, l_extendedprice / 1000 y, l_discount * 100 z from lineitem)')} group by i, j, k""",
    "voxel_mean_std": f"select i, j, k, count(*) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std from {_cells('25.0', EVENT_POINTS)} group by 1, 2, 3",
    "voxel_two_scale": f"""with b as (select *, floor(x / 50) a1, floor(y / 50) a2, floor(z / 50) a3 from {EVENT_POINTS}), m as (select *, avg(value) over (partition by a1, a2, a3) mv from b)
        select i, j, k, round(avg(mv), 6) mean, count(*) n from {_cells('10.0', 'm')} group by 1, 2, 3""",
    "voxel_packed_key": f"select distinct i, j, k, (i & 1048575) * 1099511627776 + (j & 1048575) * 1048576 + (k & 1048575) as key from {_cells('0.1')}",
    "octree_voxels": f"with {_OCT.format(n=16)}, s as (select i, j, k, count(*) n from o group by 1, 2, 3) select i, j, k, n, label from s join ({_WINNER.format(label='label', src='o')}) using (i, j, k)",
    "octree_level_counts": f"with {_OCT.format(n=32)} select d as depth, count(distinct (i >> (5 - d), j >> (5 - d), k >> (5 - d))) nodes from o, (select unnest(range(6))::int d) group by d",
    "coarse_to_fine_broadcast": f"""with c as (select * from {_cells('0.2')} where label < 5), s as (select i, j, k, count(*) n from c group by 1, 2, 3),
        w as (select i pi, j pj, k pk, n coarse_n, label coarse_label from s join ({_WINNER.format(label='label', src='c')}) using (i, j, k)),
        f as (select distinct i, j, k from {_cells('0.1')})
        select i, j, k, coalesce(coarse_label, -1) coarse_label, coalesce(coarse_n, -1) coarse_n from f left join w on pi = floor(i / 2.0) and pj = floor(j / 2.0) and pk = floor(k / 2.0)""",
    "grid_join_unmatched": f"""with c as {_cells('10.0', EVENT_POINTS)}, g as (select distinct i, j, k, 1 hit from c where event_id % 2 = 0)
        select count(hit) matched, count(*) - count(hit) unmatched from (select * from c where event_id % 2 = 1) left join g using (i, j, k)""",
    "grid_difference": f"with c as {_cells('20.0', EVENT_POINTS)} select i, j, k from c where event_type = 'view' except select i, j, k from c where event_type = 'error'",
    "weighted_vote": """with r as (select user_id % 20 cell, event_type material, value / 500 conf, hour(ts) / 4.0 depth from events where value / 500 >= 0.02),
        w as (select cell, material, sum(conf * power(1 / greatest(1.0, depth), 2.0)) weight from r group by 1, 2)
        select cell, material, round(weight, 6) weight, round(weight / total, 6) share from
        (select *, sum(weight) over (partition by cell) total, row_number() over (partition by cell order by weight desc, material) i from w) where i = 1""",
    "vote_mass_pool": """with r as (select user_id segment, event_id % 40 cell, event_type material, value / 500 conf from events),
        w as (select cell, material, sum(conf) / sum(sum(conf)) over (partition by cell) m from r group by 1, 2), h as (select segment, cell, count(*) hits from r group by 1, 2),
        p as (select segment, material, sum(hits * m) mass from h join w using (cell) group by 1, 2)
        select segment, material, round(mass, 6) mass, round(mass / total, 6) agreement from
        (select *, sum(mass) over (partition by segment) total, row_number() over (partition by segment order by mass desc, material) i from p) where i = 1""",
    "two_level_majority": """with a as (select l_partkey, l_suppkey, l_returnflag, count(*) n from lineitem group by 1, 2, 3),
        b as (select l_partkey, l_suppkey, l_returnflag from (select *, row_number() over (partition by l_partkey, l_suppkey order by n desc, l_returnflag) i from a) where i = 1),
        c as (select l_suppkey, l_returnflag, count(*) n from b group by 1, 2)
        select l_suppkey, l_returnflag, n, round(n / total, 6) confidence from
        (select *, sum(n) over (partition by l_suppkey) total, row_number() over (partition by l_suppkey order by n desc, l_returnflag) i from c) where i = 1""",
    "votes_per_voxel": """with p as (select l_partkey, count(distinct l_shipdate) k from lineitem group by 1)
        select round(avg(k), 6) mean_k, max(k) max_k, round(avg((k > 1)::int::double), 6) share_mixed from p""",
    "class_share": "select p_type, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from part group by 1",
    "vocabulary_first_seen": "select event_type, row_number() over (order by min(event_id)) - 1 as id from events group by 1",
}
