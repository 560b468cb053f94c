"""Connected components, by alternating large and small stars, and what is built on them: largest parts, enclosed holes.

Each round is two joins and aggregations over the edges; lineage is cut by a checkpoint in the shared folder. Nodes of very many
edges are no hot spot: minima are combined map-side, and skewed joins are split at run time. Rounds grow with the logarithm of
the number of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from heliovox.session import checkpointed


def components(edges: DataFrame, *, src: str = "src", dst: str = "dst", most_rounds: int = 50) -> DataFrame:
    """`node, component`: the least node reachable from each. Nodes without an edge to another must come as an edge to themselves."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = checkpointed(e.select(F.col("u").alias("node")).union(e.select("v")).distinct())
    e = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # Large star: every node links its larger neighbours to the least of its neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every node links itself and its smaller neighbours to the least of them.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def half_neighbourhood(dimensions: int, corners: bool) -> list[tuple[int, ...]]:
    """One offset of each opposite pair of neighbours."""
    steps = [d for d in product((-1, 0, 1), repeat=dimensions) if any(d) and (corners or sum(map(abs, d)) == 1)]
    return [d for d in steps if d > tuple(-x for x in d)]


def cell_components(cells: DataFrame, axes: Sequence[str], *, corners: bool = True) -> DataFrame:
    """Distinct cells with `component`, numbered by its least cell in order of the axes: the number is the cell packed into a BIGINT.

    Indices must lie within 20 bits for three axes, 31 for two.
    """
    axes = list(axes)
    bits = 20 if len(axes) == 3 else 31
    half = 1 << (bits - 1)
    key = lambda columns: sum(((c + half) * (1 << bits * (len(axes) - 1 - n)) for n, c in enumerate(columns)), F.lit(0)).cast("bigint")
    own = checkpointed(cells.select(*axes).distinct().withColumn("node", key([F.col(a) for a in axes])))
    offsets = F.array(*[F.lit(sum(d << bits * (len(axes) - 1 - n) for n, d in enumerate(step))) for step in half_neighbourhood(len(axes), corners)])
    near = own.select("node", F.explode(offsets).alias("step")).select("node", (F.col("node") + F.col("step")).alias("other"))
    edges = near.join(own.select(F.col("node").alias("other")), "other", "left_semi").select(F.col("node").alias("src"), F.col("other").alias("dst"))
    every = edges.unionByName(own.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    return own.join(components(every), "node").drop("node")


def largest_component(cells: DataFrame, axes: Sequence[str], *, weight: str | None = None, corners: bool = True) -> DataFrame:
    """The cells of the component with the greatest weight (or the most cells); of equal ones that of the least number."""
    labelled = cell_components(cells, axes, corners=corners)
    weighed = labelled if weight is None else labelled.join(cells.groupBy(*axes).agg(F.sum(weight).alias("_w")), list(axes))
    sums = weighed.groupBy("component").agg((F.count("*") if weight is None else F.sum("_w")).alias("w"))
    best = sums.agg(F.min(F.struct((-F.col("w")).alias("w"), "component")).alias("b")).select(F.col("b.component").alias("component"))
    return labelled.join(F.broadcast(best), "component", "left_semi").drop("component")  # one row


def without_small(cells: DataFrame, axes: Sequence[str], *, least_side: int, corners: bool = True) -> DataFrame:
    """Distinct cells of the components whose longest side is of at least so many cells."""
    labelled = cell_components(cells, axes, corners=corners)
    sides = labelled.groupBy("component").agg(F.greatest(*[F.max(a) - F.min(a) + 1 for a in axes]).alias("_side"))
    return labelled.join(sides.where(F.col("_side") >= least_side), "component", "left_semi").select(*axes)


def fill_enclosed(raster: DataFrame, *, rows: int, cols: int, unknown: int = 18) -> DataFrame:
    """`row, col, label, filled`: the raster's cells (missing ones are empty), with empty regions that don't touch the border filled.

    A region takes the one label around it, or `unknown` if there are several. Regions are connected by edges, not corners.
    """
    spark = raster.sparkSession
    grid = spark.range(rows).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).withColumn("col", F.col("col").cast("bigint"))
    known = raster.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "label").where("label >= 0")
    empty = grid.join(known, ["row", "col"], "left_anti")
    regions = cell_components(empty, ["row", "col"], corners=False)
    open_ = regions.groupBy("component").agg(F.max(((F.col("row") == 0) | (F.col("row") == rows - 1) | (F.col("col") == 0) | (F.col("col") == cols - 1)).cast("int")).alias("open"))
    around = regions.withColumn("_s", F.explode(F.expr("array(struct(-1 as r, 0 as c), struct(1 as r, 0 as c), struct(0 as r, -1 as c), struct(0 as r, 1 as c))")))
    around = around.select("component", (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col")).join(known, ["row", "col"])
    labels = around.groupBy("component").agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(F.lit(unknown)).alias("label"))
    inside = regions.join(open_.where("open = 0"), "component", "left_semi").join(labels, "component")
    return known.select("row", "col", "label", F.lit(False).alias("filled")).unionByName(inside.select("row", "col", "label", F.lit(True).alias("filled")))


def dilated(cells: DataFrame, axes: Sequence[str], *, corners: bool = True) -> DataFrame:
    """Distinct cells with all their neighbours."""
    steps = [d for d in product((-1, 0, 1), repeat=len(axes)) if corners or sum(map(abs, d)) <= 1]
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"_{a}") for x, a in zip(d, axes)]) for d in steps])
    return cells.select(*axes, F.explode(moves).alias("_d")).select(*[(F.col(a) + F.col(f"_d._{a}")).alias(a) for a in axes]).distinct()


def eroded(cells: DataFrame, axes: Sequence[str], *, corners: bool = True) -> DataFrame:
    """The cells all of whose neighbours are there; a cell is counted once for each neighbour that names it."""
    steps = [d for d in product((-1, 0, 1), repeat=len(axes)) if corners or sum(map(abs, d)) <= 1]
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"_{a}") for x, a in zip(d, axes)]) for d in steps])
    named = cells.select(*axes).distinct().select(*axes, F.explode(moves).alias("_d")).select(*[(F.col(a) + F.col(f"_d._{a}")).alias(a) for a in axes])
    return named.groupBy(*axes).agg(F.count("*").alias("_n")).where(F.col("_n") == len(steps)).select(*axes)


def closed(cells: DataFrame, axes: Sequence[str], *, corners: bool = True) -> DataFrame:
    return eroded(dilated(cells, axes, corners=corners), axes, corners=corners)


def opened(cells: DataFrame, axes: Sequence[str], *, corners: bool = True) -> DataFrame:
    return dilated(eroded(cells, axes, corners=corners), axes, corners=corners)


def wall_holes(cells: DataFrame, *, rows: int, cols: int, least: int, most: int, floor_row: int | None = None) -> DataFrame:
    """`hole, cells, r0, c0, r1, c1`: empty regions of a wall (`row, col`), after its gaps of one cell are closed, that touch neither the border nor the floor row,
    of `least` to `most` cells."""
    walls = closed(cells, ["row", "col"]).where(f"row between 0 and {rows - 1} and col between 0 and {cols - 1}")
    marked = fill_enclosed(walls.withColumn("label", F.lit(0)), rows=rows, cols=cols, unknown=0).where("filled")
    parts = cell_components(marked, ["row", "col"], corners=False).groupBy("component").agg(F.count("*").alias("cells"), F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    kept = parts.where(F.col("cells").between(least, most))
    return (kept if floor_row is None else kept.where(F.col("r0") > floor_row)).withColumnRenamed("component", "hole")


def inferred_holes(occupied: DataFrame, *, rows: int, cols: int, refine: int = 2) -> DataFrame:
    """`row, col` on a grid `refine` times finer: the cells of a wall's grid that nothing occupies, each cut into refine x refine."""
    spark = occupied.sparkSession
    grid = spark.range(rows).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint"))))
    free = grid.join(occupied.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")), ["row", "col"], "left_anti")
    part = F.sequence(F.lit(0).cast("bigint"), F.lit(refine - 1).cast("bigint"))
    return free.withColumn("_r", F.explode(part)).withColumn("_c", F.explode(part)).select((F.col("row") * refine + F.col("_r")).alias("row"), (F.col("col") * refine + F.col("_c")).alias("col"))


def footprints(boxes: DataFrame, size: float) -> DataFrame:
    """Boxes with every cell (`row, col`) that their extent `u0, u1, v0, v1` touches."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("bigint"), F.floor(F.col(b) / size).cast("bigint"))
    return boxes.where("u0 <= u1 and v0 <= v1").withColumn("row", F.explode(span("v0", "v1"))).withColumn("col", F.explode(span("u0", "u1")))


def declutter(points: DataFrame, gap: float, *, least: int | None = None) -> DataFrame:
    """Points of the largest component of occupied cells of size `gap`, or, with `least`, of every component of so many points."""
    from heliovox.operators import lattice

    cells = lattice.with_cells(points, gap, names=lattice.INNER)
    counts = cells.groupBy(*lattice.INNER).agg(F.count("*").alias("_n"))
    if least is None:
        return cells.join(largest_component(counts, lattice.INNER, weight="_n"), list(lattice.INNER), "left_semi").drop(*lattice.INNER)
    labelled = cell_components(counts, lattice.INNER).join(counts, list(lattice.INNER))
    big = labelled.groupBy("component").agg(F.sum("_n").alias("w")).where(F.col("w") >= least)
    return cells.join(labelled.join(big, "component", "left_semi").select(*lattice.INNER), list(lattice.INNER), "left_semi").drop(*lattice.INNER)


def _mask(rows: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(rows["row"].min()), int(rows["col"].min())
    mask = np.zeros((int(rows["row"].max()) - r0 + 1, int(rows["col"].max()) - c0 + 1), bool)
    mask[rows["row"].to_numpy() - r0, rows["col"].to_numpy() - c0] = True
    return mask, r0, c0


def _around(mask: np.ndarray, corners: bool) -> np.ndarray:
    """Cells of a mask with all their neighbours, within its bounds."""
    wide = np.pad(mask, 1)
    steps = [(a, b) for a in (0, 1, 2) for b in (0, 1, 2) if corners or a == 1 or b == 1]
    return np.logical_or.reduce([wide[a : a + mask.shape[0], b : b + mask.shape[1]] for a, b in steps])


def closed_mask(mask: np.ndarray) -> np.ndarray:
    """A mask with its gaps of one cell closed; beyond its bounds nothing is filled."""
    wide = np.pad(mask, 2)
    return ~_around(~_around(wide, True), True)[2:-2, 2:-2]


def filled(mask: np.ndarray) -> np.ndarray:
    """A mask with the empty regions filled that don't reach its border; regions are connected by edges."""
    empty = np.pad(~mask, 1, constant_values=True)
    outside = np.zeros_like(empty)
    outside[0, 0] = True
    while True:
        more = _around(outside, False) & empty
        if (more == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = more


def cover(mask: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rectangles (first row, first column, last row, last column) that cover a mask without overlap: in reading order, as wide as can be, then as deep."""
    open_ = mask.copy()
    while open_.any():
        r0, c0 = np.unravel_index(int(open_.argmax()), open_.shape)
        stop = np.flatnonzero(~open_[r0, c0:])
        c1 = c0 + (int(stop[0]) if len(stop) else open_.shape[1] - c0) - 1
        full = open_[r0:, c0 : c1 + 1].all(axis=1)
        stop = np.flatnonzero(~full)
        r1 = r0 + (int(stop[0]) if len(stop) else len(full)) - 1
        open_[r0 : r1 + 1, c0 : c1 + 1] = False
        yield int(r0), int(c0), int(r1), int(c1)


def rectangles(cells: DataFrame, *, by: str) -> DataFrame:
    """`by, r0, c0, r1, c1`: a cover of the cells (`row, col`) of each surface by rectangles. A task holds one surface's raster."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask, r, c = _mask(rows)
        return pd.DataFrame([(rows[by].iloc[0], a + r, b + c, x + r, y + c) for a, b, x, y in cover(mask)], columns=[by, "r0", "c0", "r1", "c1"])

    return cells.groupBy(by).applyInPandas(run, f"`{by}` {dict(cells.dtypes)[by]}, r0 int, c0 int, r1 int, c1 int")


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int, int]:
    """(area, first row, first column, last row, last column) of the largest rectangle within a mask; of equal ones the one that ends first.

    The widest rectangle with a cell at its foot and all of the filled cells above it reaches left and right as far as every line of it
    does; line by line, whole lines at a time, height and reach follow from those of the line above.
    """
    rows, cols = mask.shape
    at = np.arange(cols)
    height, left, right = np.zeros(cols, int), np.zeros(cols, int), np.full(cols, cols)
    best = (0, 0, 0, -1, -1)
    for r in range(rows):
        line = mask[r]
        begins = np.maximum.accumulate(np.where(line, 0, at + 1))
        ends = np.minimum.accumulate(np.where(line, cols, at)[::-1])[::-1]
        height = (height + 1) * line
        left = np.where(line, np.maximum(left, begins), 0)
        right = np.where(line, np.minimum(right, ends), cols)
        area = height * (right - left)
        c = int(area.argmax())
        if area[c] > best[0]:
            best = (int(area[c]), r - int(height[c]) + 1, int(left[c]), r, int(right[c]) - 1)
    return best


def inscribed(cells: DataFrame, *, by: str) -> DataFrame:
    """`by, area, r0, c0, r1, c1`: the largest rectangle within the cells of each surface."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask, r, c = _mask(rows)
        area, a, b, x, y = largest_rectangle(mask)
        return pd.DataFrame([(rows[by].iloc[0], area, a + r, b + c, x + r, y + c)], columns=[by, "area", "r0", "c0", "r1", "c1"])

    return cells.groupBy(by).applyInPandas(run, f"`{by}` {dict(cells.dtypes)[by]}, area int, r0 int, c0 int, r1 int, c1 int")


def merged(rectangles: list[tuple[int, int, int, int]], gate: float = 0.9) -> list[tuple[int, int, int, int]]:
    """Rectangles (first row, first column, last row, last column; inclusive) that touch along an edge, merged: into their bounding box if they cover at
    least `gate` of it, else into the largest rectangle within them and those of the rest that don't overlap it."""
    rest, out = [tuple(map(int, r)) for r in rectangles], []
    while rest:
        group, queue = [], [rest.pop(0)]
        while queue:
            a = queue.pop()
            group.append(a)
            near = [b for b in rest if (a[0] <= b[2] + 1 and b[0] <= a[2] + 1 and a[1] <= b[3] and b[1] <= a[3]) or (a[1] <= b[3] + 1 and b[1] <= a[3] + 1 and a[0] <= b[2] and b[0] <= a[2])]
            rest = [b for b in rest if b not in near]
            queue += near
        r0, c0, r1, c1 = (f(g[k] for g in group) for k, f in enumerate((min, min, max, max)))
        mask = np.zeros((r1 - r0 + 1, c1 - c0 + 1), bool)
        for a in group:
            mask[a[0] - r0 : a[2] - r0 + 1, a[1] - c0 : a[3] - c0 + 1] = True
        if mask.mean() >= gate:
            out.append((r0, c0, r1, c1))
            continue
        _, a, b, x, y = largest_rectangle(mask)
        mask[a : x + 1, b : y + 1] = False
        out.append((a + r0, b + c0, x + r0, y + c0))
        out += [(p + r0, q + c0, u + r0, v + c0) for p, q, u, v in cover(mask)]
    return sorted(out)


def merged_rectangles(rectangles: DataFrame, *, by: str, gate: float = 0.9) -> DataFrame:
    """`by, r0, c0, r1, c1`: the merged rectangles of each surface. A task holds one surface's rectangles."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = merged(list(rows[["r0", "c0", "r1", "c1"]].itertuples(index=False, name=None)), gate)
        return pd.DataFrame([(rows[by].iloc[0], *r) for r in found], columns=[by, "r0", "c0", "r1", "c1"])

    return rectangles.groupBy(by).applyInPandas(run, f"`{by}` {dict(rectangles.dtypes)[by]}, r0 int, c0 int, r1 int, c1 int")


# The neighbours of a cell, going round.
_RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def thinned(mask: np.ndarray) -> np.ndarray:
    """The skeleton of a mask, one cell wide: border cells are taken off in turns from two opposite corners, as long as their removal parts nothing (Zhang and Suen)."""
    m = np.pad(mask, 1).astype(np.uint8)
    h, w = mask.shape
    while True:
        before = m.sum()
        for turn in (0, 1):
            near = np.stack([m[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a, b in _RING])
            filled_, rises = near.sum(axis=0), ((near == 0) & (np.roll(near, -1, axis=0) == 1)).sum(axis=0)
            n, e, s, o = near[0], near[2], near[4], near[6]
            free = (n * e * s == 0) & (e * s * o == 0) if turn == 0 else (n * e * o == 0) & (n * s * o == 0)
            m[1:-1, 1:-1] &= ~((filled_ >= 2) & (filled_ <= 6) & (rises == 1) & free).astype(np.uint8) & 1
        if m.sum() == before:
            return m[1:-1, 1:-1].astype(bool)


def _parts(cells: set[tuple[int, int]], crossings: set[tuple[int, int]] = frozenset()) -> list[set[tuple[int, int]]]:
    """Cells that touch, corners included unless a crossing lies beside that corner, part by part."""
    left, out = set(cells), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            r, c = todo.pop()
            if (r, c) in left:
                left.discard((r, c))
                part.add((r, c))
                todo += [(r + a, c + b) for a, b in _RING if not (a and b and ((r + a, c) in crossings or (r, c + b) in crossings))]
        out.append(part)
    return out


def branches(skeleton: np.ndarray, least_spur: int = 0) -> list[tuple[int, int, int, int, float]]:
    """(first row, first column, last row, last column, length) of the branches of a skeleton between its ends and crossings.

    Branches with a free end and fewer than `least_spur` cells are taken off, the shortest first, as long as a crossing holds them. Steps to a corner count the root of two.
    """
    cells = set(zip(*map(list, np.nonzero(skeleton))))
    near = lambda c: [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (c[0] + a, c[1] + b) in cells]
    # Going round a cell, each run of neighbours is one arm.
    around = lambda c: [(c[0] + a, c[1] + b) in cells for a, b in _RING]
    arms = lambda c: sum(y and not x for x, y in pairwise([*around(c)[-1:], *around(c)]))
    while True:
        crossings = {c for c in cells if arms(c) > 2}
        paths = _parts(cells - crossings, crossings)
        spurs = [p for p in paths if len(p) < least_spur and any(arms(c) <= 1 for c in p) and any(q in crossings for c in p for q in near(c))]
        if not spurs:
            break
        cells -= min(spurs, key=lambda p: (len(p), min(p)))
    out = []
    for p in paths:
        straight = sum((r + a, c + b) in p for r, c in p for a, b in ((0, 1), (1, 0)))
        slant = sum((r + 1, c + b) in p and (r + 1, c) not in p and (r, c + b) not in p for r, c in p for b in (-1, 1))
        rows, cols = [c[0] for c in p], [c[1] for c in p]
        out.append((int(min(rows)), int(min(cols)), int(max(rows)), int(max(cols)), straight + slant * 2**0.5))
    return sorted(out)


def skeletons(cells: DataFrame, *, by: str, least_spur: int) -> DataFrame:
    """`by, r0, c0, r1, c1, length`: the branches of the skeleton of each surface's cells (`row, col`). A task holds one surface's raster."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask, r, c = _mask(rows)
        found = branches(thinned(mask), least_spur)
        return pd.DataFrame([(rows[by].iloc[0], a + r, b + c, x + r, y + c, l) for a, b, x, y, l in found], columns=[by, "r0", "c0", "r1", "c1", "length"])

    return cells.groupBy(by).applyInPandas(run, f"`{by}` {dict(cells.dtypes)[by]}, r0 int, c0 int, r1 int, c1 int, length double")
