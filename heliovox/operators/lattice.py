"""Points on a lattice of cubic cells: indices, group-bys by cell, depths of an octree, joins of grids.

Cells are three BIGINT columns `i, j, k`; their centre is `(index + 0.5) * size + origin`. All group-bys combine map-side, so a cell
that holds many points is one row per task before the shuffle. Null coordinates give null indices; such rows form
no cell and are left out of group-bys. NaN coordinates count as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

AXES, CELL = ("x", "y", "z"), ("i", "j", "k")
# Cell columns of operators that give back the points themselves, whose own columns may be called i, j or k.
INNER = ("_cell_i", "_cell_j", "_cell_k")


def clean(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def index(value: Column, size: float, origin: Column | float = 0.0, depth: int | None = None) -> Column:
    """The cell of a coordinate; with a depth, clipped to the 2^depth cells of the root cube."""
    cell = F.floor((value - origin) / F.lit(float(size)))
    return cell if depth is None else F.least(F.greatest(cell, F.lit(0)), F.lit((1 << depth) - 1))


def index_of_centre(centre: Column, size: float, origin: float = 0.0) -> Column:
    return F.rint((centre - origin) / F.lit(float(size)) - 0.5).cast("bigint")


def centre(cell: Column, size: float, origin: float = 0.0) -> Column:
    return (cell + 0.5) * F.lit(float(size)) + origin


def packed(i: Column, j: Column, k: Column, bits: int = 20) -> Column:
    """One BIGINT of three indices of `bits` bits each, two's complement."""
    mask = F.lit((1 << bits) - 1)
    field = lambda c: c.bitwiseAND(mask)
    return F.shiftleft(field(i), 2 * bits) + F.shiftleft(field(j), bits) + field(k)


def with_cells(points: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0), names: Sequence[str] = CELL) -> DataFrame:
    return points.withColumns({c: index(clean(a), size, o) for c, a, o in zip(names, AXES, origin)}).where(" and ".join(f"{c} is not null" for c in names))


def majority(counts: DataFrame, group: Sequence[str], label: str, weight: str) -> DataFrame:
    """Per group the label of the greatest weight, the smallest label of equal ones; input is one row per group and label."""
    best = Window.partitionBy(*group).orderBy(F.desc(weight), F.asc(label))
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def voxels(points: DataFrame, size: float, *, label: str, least: int = 1, classes: int | None = None) -> DataFrame:
    """`i, j, k, cx, cy, cz, n, label`: points and majority label per cell of at least `least` points.

    With `classes`, labels are clipped to 0 .. classes - 1. Null labels count as points but don't vote.
    """
    value = F.col(label) if classes is None else F.least(F.greatest(F.col(label), F.lit(0)), F.lit(classes - 1))
    per_label = with_cells(points, size).groupBy(*CELL, value.alias("label")).agg(F.count("*").alias("votes"))
    # Count and winner in one pass, without a join back: the least of (-votes, label).
    ranked = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("votes")).alias("v"), F.col("label").alias("l"))))
    out = per_label.groupBy(*CELL).agg(F.sum("votes").alias("n"), ranked.alias("best")).where(F.col("n") >= least)
    return out.select(*CELL, *[centre(F.col(c), size).alias("c" + a) for c, a in zip(CELL, AXES)], "n", F.col("best.l").alias("label"))


def distinct_cells(points: DataFrame, size: float) -> DataFrame:
    return with_cells(points, size).select(*CELL).distinct()


def first_per_cell(points: DataFrame, size: float, *, order: str, keep: Sequence[str]) -> DataFrame:
    """Per cell the row that comes first by `order`."""
    first = F.min_by(F.struct(order, *keep), order)
    return with_cells(points, size).groupBy(*CELL).agg(first.alias("f")).select(*CELL, "f.*")


def grid_average(points: DataFrame, size: float) -> DataFrame:
    """Mean of the points of each cell."""
    cells = with_cells(points, size)
    return cells.groupBy(*CELL).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n"))


def cell_stats(points: DataFrame, size: float, *, value: str) -> DataFrame:
    """Count, mean and population standard deviation of a value per cell."""
    v = clean(value)
    return with_cells(points, size).groupBy(*CELL).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def two_scale(points: DataFrame, coarse: float, fine: float, *, value: str) -> DataFrame:
    """Means on a coarse lattice, averaged again on a fine one over the points in it."""
    big = points.withColumns({"c" + c: index(clean(a), coarse) for c, a in zip(CELL, AXES)})
    means = big.groupBy("ci", "cj", "ck").agg(F.avg(clean(value)).alias("_mean"))
    joined = big.join(means, ["ci", "cj", "ck"])
    return with_cells(joined, fine).groupBy(*CELL).agg(F.avg("_mean").alias("mean"), F.count("*").alias("n"))


def root_cube(points: DataFrame) -> DataFrame:
    """One row `ox, oy, oz, extent`: the centred cube that holds all points."""
    b = points.agg(*[f(clean(a)).alias(n + a) for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    extent = F.greatest(*[F.col("hi" + a) - F.col("lo" + a) for a in AXES])
    return b.select(*[((F.col("lo" + a) + F.col("hi" + a)) / 2 - extent / 2).alias("o" + a) for a in AXES], extent.alias("extent"))


def octree_cells(points: DataFrame, depth: int) -> DataFrame:
    """Points with their cell at `depth` of the root cube; points on the far faces belong to the last cells."""
    cube = F.broadcast(root_cube(points))  # one row
    size = F.col("extent") / F.lit(float(1 << depth))
    cells = {c: F.least(F.greatest(F.coalesce(F.floor(F.try_divide(clean(a) - F.col("o" + a), size)), F.lit(0)), F.lit(0)), F.lit((1 << depth) - 1)) for c, a in zip(CELL, AXES)}
    present = " and ".join(f"{a} is not null and not isnan({a})" for a in AXES)
    return points.where(present).crossJoin(cube).withColumns(cells).drop("ox", "oy", "oz", "extent")


def octree_voxels(points: DataFrame, depth: int, *, label: str) -> DataFrame:
    per_label = octree_cells(points, depth).groupBy(*CELL, F.col(label).alias("label")).agg(F.count("*").alias("votes"))
    ranked = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("votes")).alias("v"), F.col("label").alias("l"))))
    return per_label.groupBy(*CELL).agg(F.sum("votes").alias("n"), ranked.alias("best")).select(*CELL, "n", F.col("best.l").alias("label"))


def level_counts(points: DataFrame, depth: int) -> DataFrame:
    """`depth, nodes`: occupied cells at every depth; cells are made distinct at the finest depth before they are shifted."""
    leaves = octree_cells(points, depth).select(*CELL).distinct()
    up = leaves.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shift = f"{depth} - d"
    nodes = up.select("d", *[F.expr(f"shiftright({c}, cast({shift} as int))").alias(c) for c in CELL]).distinct()
    return nodes.groupBy(F.col("d").alias("depth")).agg(F.count("*").alias("nodes"))


def onto_grid(fine: DataFrame, coarse: DataFrame, ratio: int, attributes: Sequence[str]) -> DataFrame:
    """Cells of a fine grid with the attributes of the coarse cell around them, null where there is none."""
    parent = {"p" + c: F.floor(F.col(c) / ratio) for c in CELL}
    named = coarse.select(*[F.col(c).alias("p" + c) for c in CELL], *attributes)
    return fine.withColumns(parent).join(named, ["pi", "pj", "pk"], "left").drop("pi", "pj", "pk")


def join_report(points: DataFrame, grid: DataFrame) -> DataFrame:
    """One row: points that fall into a cell of the grid, and points that don't."""
    hit = points.join(grid.select(*CELL).distinct().withColumn("_in", F.lit(1)), list(CELL), "left")
    return hit.agg(F.count("_in").alias("matched"), F.sum(F.when(F.col("_in").isNull(), 1).otherwise(0)).cast("bigint").alias("unmatched"))
