"""Connected components, hole filling and geodesic growth on cell masks.

Components are labelled inside tiles of cells with array operations, one shuffle for the grid. What crosses the tiles' borders is
a graph of one node for each component of a tile that touches a border, some hundredths of the cells; least labels flow over its
links, jumping to their label's label, until nothing changes. Every round is written to the shared folder, so lineage stays short
and a lost executor costs a round at most.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import moved, square
from .tiles import SIZE

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [o for o in square(1) if o != (0, 0)]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/plotwise-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The frame, written and read again."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flow(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): least node of each component; nodes without edges keep their own."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(nodes.select("node", F.col("node").alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels = stored(near.join(far, near.label == far.via).select("node", "old", F.least("label", "far").alias("label")))
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("old")


def labels_of(value: np.ndarray, eight: bool) -> np.ndarray:
    """For each cell of a dense tile the place of the first cell of its component, in row order; value 0 is no cell.

    Runs of equal cells along rows are linked to those that they touch in the row below; the least place flows over the links.
    """
    side = value.shape[1]
    flat = value.ravel()
    new = np.ones(flat.shape, dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[::side] = True
    run = np.cumsum(new) - 1
    links = []
    for shift in (-1, 0, 1) if eight else (0,):
        lo, hi = max(0, -shift), side - max(0, shift)
        up, down = value[:-1, lo:hi], value[1:, lo + shift : hi + shift]
        hit = (up == down) & (up != 0)
        at = run.reshape(value.shape)
        links.append(np.column_stack([at[:-1, lo:hi][hit], at[1:, lo + shift : hi + shift][hit]]))
    a, b = np.unique(np.concatenate(links), axis=0).T if links else (np.zeros(0, dtype=int),) * 2
    label = np.arange(run[-1] + 1)
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(label, old):
            return np.flatnonzero(new)[label][run].reshape(value.shape)


def components(mask: DataFrame, nx: int, eight: bool = True, value: str | None = None, size: int = SIZE) -> DataFrame:
    """(row, col, comp, and the value if given): comp is row * nx + col of the component's first cell in row order.

    With `value` (codes from 0), only cells of one value are connected. A component of several tiles has the least of their comps.
    """
    code = F.col(value).cast("long") + 1 if value else F.lit(1).cast("long")
    dealt = mask.select("row", "col", code.alias("code"), F.floor(F.col("row") / size).alias("tr"), F.floor(F.col("col") / size).alias("tc"))

    def run(key, rows):  # no type hints: Spark reads them
        top, left = key[0].as_py() * size, key[1].as_py() * size
        r, c = rows.column("row").to_numpy() - top, rows.column("col").to_numpy() - left
        dense = np.zeros((size, size), dtype=np.int64)
        dense[r, c] = rows.column("code").to_numpy()
        first = labels_of(dense, eight)[r, c]
        own = (first // size + top) * nx + first % size + left
        return pa.table([rows.column("row"), rows.column("col"), rows.column("code"), pa.array(own)], names=["row", "col", "code", "own"])

    tiles = stored(dealt.groupBy("tr", "tc").applyInArrow(run, "row long, col long, code long, own long"))
    edge = lambda c: F.pmod(F.col(c), F.lit(size))
    border = tiles.where(edge("row").isin(0, size - 1) | edge("col").isin(0, size - 1))
    near = moved(border.select("row", "col", F.col("code").alias("near_code"), F.col("own").alias("near")), [(1, 0), (0, 1), (1, 1), (1, -1)] if eight else [(1, 0), (0, 1)])
    links = border.join(near, ["row", "col"]).where("code = near_code AND own <> near").select(F.col("own").alias("a"), F.col("near").alias("b")).distinct()
    links = stored(links)
    back = [(F.col("code") - 1).alias(value)] if value else []
    if links.isEmpty():
        return tiles.select("row", "col", F.col("own").alias("comp"), *back)
    known = flow(links, links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    return tiles.join(known, tiles.own == known.node, "left").select("row", "col", F.coalesce("label", "own").alias("comp"), *back)


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("comp").agg(F.count("*").alias("size"))


def largest_component(labelled: DataFrame) -> DataFrame:
    """Cells of the component with most cells; of equally large ones the first."""
    best = component_sizes(labelled).agg(F.min(F.struct((-F.col("size")).alias("n"), "comp")).alias("b")).select(F.col("b.comp").alias("comp"))
    return labelled.join(F.broadcast(best), "comp", "left_semi")  # one row


def fill_holes(mask: DataFrame, grid: DataFrame, nx: int, ny: int, most: int, eight: bool = False) -> DataFrame:
    """The mask with background components of up to `most` cells that don't touch the grid's border."""
    background = grid.select("row", "col").join(mask.select("row", "col"), ["row", "col"], "left_anti")
    labelled = components(background, nx, eight)
    border = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == ny - 1) | (F.col("col") == nx - 1)
    holes = labelled.groupBy("comp").agg(F.count("*").alias("n"), F.max(border.cast("int")).alias("b")).where((F.col("n") <= most) & (F.col("b") == 0))
    return mask.select("row", "col").union(labelled.join(holes.select("comp"), "comp", "left_semi").select("row", "col"))


def sieve(cells: DataFrame, value: str, nx: int, least: int) -> DataFrame:
    """Cells with the value of components (4-connected, of one value) below `least` cells replaced by that of their largest neighbour."""
    known = stored(components(cells, nx, eight=False, value=value))
    sizes = known.groupBy("comp", value).agg(F.count("*").alias("size"))
    tagged = stored(known.join(sizes, ["comp", value]))
    near = moved(tagged.select("row", "col", F.col("comp").alias("o_comp"), F.col(value).alias("o_value"), F.col("size").alias("o_size")), FOUR)
    small = tagged.where(F.col("size") < least)
    met = small.join(near, ["row", "col"]).where((F.col("comp") != F.col("o_comp")) & (F.col("o_size") >= F.col("size")))
    best = met.groupBy("comp", value).agg(F.max(F.struct("o_size", (-F.col("o_comp")).alias("c"), "o_value")).alias("b")).select("comp", value, F.col("b.o_value").alias("__new"))
    return tagged.join(best, ["comp", value], "left").select("row", "col", F.coalesce("__new", value).alias(value))


def geodesic_growth(seeds: DataFrame, allowed: DataFrame, steps: int, offsets: list[tuple[int, int]] = FOUR) -> DataFrame:
    """(row, col, ring): cells reached from the seeds through allowed cells, up to `steps` rings; seeds have ring 0. Stops early."""
    reached = stored(seeds.select("row", "col").distinct().withColumn("ring", F.lit(0)))
    edge = reached
    room = stored(allowed.select("row", "col").distinct())
    for ring in range(1, steps + 1):
        next_ = moved(edge.select("row", "col"), offsets).distinct().join(room, ["row", "col"], "left_semi").join(reached, ["row", "col"], "left_anti")
        edge = stored(next_.withColumn("ring", F.lit(ring)))
        if edge.isEmpty():
            break
        reached = reached.unionByName(edge)
    return reached


def revert_components(labelled: DataFrame, features: DataFrame, rejected: str, new: str, old: str) -> DataFrame:
    """Cells with `old` instead of `new` where their component's features meet the condition `rejected`."""
    bad = features.select("comp", F.expr(rejected).alias("__bad"))
    return labelled.join(bad, "comp", "left").withColumn("value", F.when(F.col("__bad"), F.col(old)).otherwise(F.col(new))).drop("__bad")


def outlines(labelled: DataFrame, comp: str = "comp") -> DataFrame:
    """(comp, hole, ring): the closed outlines of each component's cells, corners only, at (col, row); its cells lie to the right of the line.

    Sides between cells of a component cancel where they are met, so only the component's outline reaches the task that traces it.
    """
    cell = labelled.select(comp, "row", "col")
    side = lambda x, y, dx, dy: F.struct(x.alias("x"), y.alias("y"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    sides = cell.select(comp, F.explode(F.array(side(c, r, 1, 0), side(c + 1, r, 0, 1), side(c + 1, r + 1, -1, 0), side(c, r + 1, 0, -1))).alias("s"))
    # a side and the same side of the neighbour, which runs the other way, have one place
    low = sides.select(comp, "s.*").withColumns({"px": F.col("x") + F.least("dx", F.lit(0)), "py": F.col("y") + F.least("dy", F.lit(0)), "flat": F.col("dy") == 0})
    open_ = low.groupBy(comp, "px", "py", "flat").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.min("dx").alias("dx"), F.min("dy").alias("dy")).where("n = 1")
    kind = labelled.schema[comp].dataType.simpleString()

    def run(key, rows):  # no type hints: Spark reads them
        x, y, dx, dy = (rows.column(n).to_numpy() for n in ("x", "y", "dx", "dy"))
        ahead: dict[tuple, list[tuple]] = {}
        for a in zip(x.tolist(), y.tolist(), dx.tolist(), dy.tolist(), strict=True):
            ahead.setdefault(a[:2], []).append(a[2:])
        rings = []
        while ahead:
            start = min(ahead)
            at, step, ring = start, None, []
            while not ring or at != start:
                ways = ahead[at]
                # where two outlines meet at a corner, the sharper right turn keeps them apart
                way = ways[0] if step is None or len(ways) == 1 else next(w for w in ways if w == (-step[1], step[0]))
                ways.remove(way)
                if not ways:
                    del ahead[at]
                if way != step:
                    ring.append(at)
                at, step = (at[0] + way[0], at[1] + way[1]), way
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            rings.append((area < 0, [{"x": float(a), "y": float(b)} for a, b in ring]))
        point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table({comp: pa.array([key[0].as_py()] * len(rings)), "hole": pa.array([h for h, _ in rings], pa.bool_()), "ring": pa.array([g for _, g in rings], point)})

    return open_.groupBy(comp).applyInArrow(run, f"{comp} {kind}, hole boolean, ring array<struct<x:double,y:double>>")
