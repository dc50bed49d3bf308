"""Operators on cell tables (row, col, value...): shifts, morphology, blocks, downsampling, profiles.

Structuring elements are offsets that cells are exploded by; the counts of the results are pre-aggregated. Windows over
neighbourhoods are in tiles.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_id(size: int, blocks_across: Column | int, row: str = "row", col: str = "col") -> Column:
    across = F.lit(blocks_across) if isinstance(blocks_across, int) else blocks_across
    return (F.floor(F.col(row) / size) * across + F.floor(F.col(col) / size)).cast("long")


def toroidal_shift(cells: DataFrame, dx: Column | int, dy: Column | int, nx: int, ny: int) -> DataFrame:
    """Cells moved by (dx, dy) on a grid of nx x ny that wraps around."""
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    return cells.withColumns({"col": F.pmod(F.col("col") + as_col(dx), F.lit(nx)).cast("long"), "row": F.pmod(F.col("row") + as_col(dy), F.lit(ny)).cast("long")})


def mirrored(cells: DataFrame, radius: int, nx: int, ny: int) -> DataFrame:
    """The grid with a margin in which it is reflected at its edges (the edge cells twice)."""
    def reflect(c: str, n: int) -> Column:
        x = F.col(c)
        places = F.array(x, -x - 1, F.lit(2 * n - 1) - x).cast("array<bigint>")
        return F.explode(F.filter(places, lambda v: (v >= -radius) & (v < n + radius)))

    out = cells.withColumn("__c", reflect("col", nx)).withColumn("__r", reflect("row", ny))
    return out.drop("col", "row").withColumnsRenamed({"__c": "col", "__r": "row"})


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in square(radius) if dx * dx + dy * dy <= radius * radius]


def moved(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell once for each offset."""
    steps = F.array([F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    out = cells.withColumn("__o", F.explode(steps))
    return out.withColumns({"row": F.col("row") + F.col("__o.dy"), "col": F.col("col") + F.col("__o.dx")}).drop("__o")


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], grid: DataFrame | None = None) -> DataFrame:
    """(row, col) of all cells within the element of a cell of the mask; of the grid only, if given."""
    out = moved(mask.select("row", "col"), offsets).distinct()
    return out.join(grid.select("row", "col"), ["row", "col"], "left_semi") if grid is not None else out


def erode(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells whose whole neighbourhood is in the mask; outside the grid is not."""
    back = [(-dy, -dx) for dy, dx in offsets]
    hits = moved(mask.select("row", "col"), back).groupBy("row", "col").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(offsets)).select("row", "col").join(mask.select("row", "col"), ["row", "col"], "left_semi")


def opened(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(mask, offsets), offsets)


def closed(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The mask with gaps filled that the element does not fit into; a mask is not closed over the grid's edge."""
    return erode(dilate(mask, offsets).union(mask.select("row", "col")).distinct(), offsets)


def top_hat(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells of the mask that its opening loses: isolated dots."""
    return mask.select("row", "col").join(opened(mask, offsets), ["row", "col"], "left_anti")


def integral(cells: DataFrame, value: str, name: str = "sat") -> DataFrame:
    """Summed-area table: the sum of all cells above and to the left."""
    along = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("__r", F.sum(value).over(along)).withColumn(name, F.sum("__r").over(down)).drop("__r")


def rectangle_sums(sat: DataFrame, boxes: DataFrame, name: str = "sat") -> DataFrame:
    """`boxes` (id, r0, c0, r1, c1, inclusive) with their sums: four corners of the table, joined as one."""
    corner = lambda r, c, s: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"), F.lit(s).alias("sign"))
    r0, c0, r1, c1 = (F.col(x) for x in ("r0", "c0", "r1", "c1"))
    corners = boxes.select("id", F.explode(F.array(corner(r1, c1, 1), corner(r0 - 1, c1, -1), corner(r1, c0 - 1, -1), corner(r0 - 1, c0 - 1, 1))).alias("k")).select("id", "k.*")
    return corners.join(sat.select("row", "col", name), ["row", "col"], "left").groupBy("id").agg(F.sum(F.col("sign") * F.coalesce(name, F.lit(0))).alias("total"))


def mode_downsample(cells: DataFrame, value: str, k: int) -> DataFrame:
    """The most frequent value of each k x k block, the lowest of equally frequent ones."""
    counts = cells.groupBy(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    best = counts.groupBy("row", "col").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
    return best.select("row", "col", F.col("b.v").alias(value))


def first_nonzero(cells: DataFrame, value: str, k: int = 2) -> DataFrame:
    """The first non-zero value of each k x k block in row order, else 0."""
    block = [F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")]
    at = F.struct("row", "col")
    return cells.groupBy(*block).agg(F.coalesce(F.min_by(F.col(value), F.when(F.col(value) != 0, at)), F.lit(0)).alias(value))


def nearest_resample(cells: DataFrame, target: DataFrame, scale_row: float, scale_col: float) -> DataFrame:
    """Values for the target's (row, col) from the cell that each falls into: floor(row * scale)."""
    placed = target.select(F.col("row").alias("t_row"), F.col("col").alias("t_col"), F.floor(F.col("row") * scale_row).alias("row"), F.floor(F.col("col") * scale_col).alias("col"))
    return placed.join(cells, ["row", "col"], "left").drop("row", "col").withColumnsRenamed({"t_row": "row", "t_col": "col"})


def pyramid(cells: DataFrame, value: str, levels: int) -> DataFrame:
    """(z, row, col, n, mean) for overviews by 2, 4, ... 2**levels."""
    z = F.explode(F.sequence(F.lit(1), F.lit(levels)))
    at = lambda c: F.expr(f"{c} div cast(pow(2, z) as bigint)")
    zoomed = cells.withColumn("z", z)
    return zoomed.groupBy("z", at("row").alias("row"), at("col").alias("col")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def profile(cells: DataFrame, by: str, flag: Column) -> DataFrame:
    """Share of flagged cells in each line of the grid."""
    return cells.groupBy(by).agg(F.avg(flag.cast("double")).alias("share"))


def profile_walk(line: DataFrame, by: str, position: str, value: str, threshold: float, sustain: int, limit: int | None = None) -> DataFrame:
    """(by, edge): for each profile, the first position after a high band from which the value stays low for `sustain` positions.

    High is above the threshold. Positions before the first high one don't count; null if there is none (within the limit).
    """
    along = Window.partitionBy(by).orderBy(position)
    ahead = along.rowsBetween(0, sustain - 1)
    high = F.col(value) > threshold
    walked = line.withColumns({
        "__seen": F.max(high.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)),
        "__ahead": F.max(high.cast("int")).over(ahead),
        "__n": F.count("*").over(ahead),
        "__at": F.row_number().over(along) - 1,
    })
    ok = (F.col("__seen") == 1) & (F.col("__ahead") == 0) & (F.col("__n") == sustain)
    if limit is not None:
        ok = ok & (F.col("__at") <= limit)
    return walked.groupBy(by).agg(F.min(F.when(ok, F.col(position))).alias("edge"))


def dissolve(cells: DataFrame, code: str) -> DataFrame:
    """(code, area, perimeter, row_min, col_min, row_max, col_max): the cells of each code as one shape.

    The perimeter counts the sides of cells whose other side is not of the same code: four a cell, less two for each pair of
    equal neighbours, which are met along rows and along columns.
    """
    known = cells.select("row", "col", code)

    def joined(line: str, along: str) -> Column:
        w = Window.partitionBy(line).orderBy(along)
        return ((F.lag(along).over(w) == F.col(along) - 1) & F.lag(code).over(w).eqNullSafe(F.col(code))).cast("int")

    met = known.withColumn("__a", F.coalesce(joined("row", "col"), F.lit(0))).withColumn("__b", F.coalesce(joined("col", "row"), F.lit(0)))
    box = [f(c).alias(f"{c}_{n}") for n, f in (("min", F.min), ("max", F.max)) for c in ("row", "col")]
    return met.groupBy(code).agg(F.count("*").alias("area"), (4 * F.count("*") - 2 * F.sum(F.col("__a") + F.col("__b"))).alias("perimeter"), *box)


def spans(cells: DataFrame, *values: str) -> DataFrame:
    """Runs of equal values along rows: (row, col_start, col_end, values...), the compact form of a class raster."""
    along = Window.partitionBy("row").orderBy("col")
    key = F.struct("col", *values)
    prev = F.lag(key).over(along)
    same = F.lit(True)
    for v in values:
        same = same & prev[v].eqNullSafe(F.col(v))
    new = F.when(prev.isNull() | ~same | (prev["col"] != F.col("col") - 1), 1).otherwise(0)
    runs = cells.select("row", "col", *values, new.alias("__new")).withColumn("__run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "__run", *values).agg(F.min("col").alias("col_start"), F.max("col").alias("col_end")).drop("__run")
