"""Null model, distance decay, block bootstrap, sensitivity and sampling, with draws that any engine can repeat.

A draw is the first 32 bits of md5 of its names, so results don't depend on partitions or machines.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agreement import measures, percentages
from .crosstab import share, valid
from .grid import block_id


def draw(*names: Column) -> Column:
    """A number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[n.cast("string") for n in names])), 1, 8), 16, 10).cast("long")


def shift_vectors(spark, n: int, least: float, most: float, cell: float, seed: int) -> DataFrame:
    """(shift, dx, dy): random directions, distances uniform between the bounds, in cells; rounded half to even."""
    base = spark.range(n).withColumnRenamed("id", "shift")
    unit = lambda what: draw(F.lit(seed), F.lit(what), F.col("shift")) / F.lit(2.0**32)
    r = F.lit(least) + unit("r") * F.lit(most - least)
    angle = unit("a") * F.lit(2 * math.pi)
    return base.select("shift", F.bround(r * F.cos(angle) / cell).cast("long").alias("dx"), F.bround(r * F.sin(angle) / cell).cast("long").alias("dy"))


def decay_vectors(spark, most: float, step: float, directions: int, cell: float) -> DataFrame:
    """(distance, direction, dx, dy) for distances 0, step, ... most."""
    steps = spark.range(int(most / step) + 1).select((F.col("id") * step).alias("distance"))
    each = steps.withColumn("direction", F.explode(F.sequence(F.lit(0), F.lit(directions - 1))))
    angle = F.col("direction") * F.lit(2 * math.pi / directions)
    return each.select("distance", "direction", F.bround(F.col("distance") * F.cos(angle) / cell).cast("long").alias("dx"), F.bround(F.col("distance") * F.sin(angle) / cell).cast("long").alias("dy"))


#: Grids up to this size are given to all tasks whole, a byte a cell; rows of larger ones are joined.
GIVEN_BYTES = 64 << 20


def packed_rows(cells: DataFrame, value: Column, nx: int) -> DataFrame:
    """(row, line): a byte for each of the row's nx cells, 0 where there is none. `value` is a code from 0 to 255."""

    def run(key, rows):  # no type hints: Spark reads them
        line = np.zeros(nx, dtype=np.uint8)
        line[rows.column("col").to_numpy()] = rows.column("v").to_numpy()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "line": pa.array([line.tobytes()], pa.binary())})

    coded = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value.cast("int").alias("v")).where("v > 0")
    return coded.groupBy("row").applyInArrow(run, "row long, line binary")


def counts_schema(vectors: DataFrame, by: list[str]) -> tuple[str, pa.Schema]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    named = [(k, vectors.schema[k].dataType.simpleString()) for k in by]
    fields = pa.schema([*[(k, kinds[t]) for k, t in named], ("zone", pa.int32()), ("lu", pa.int32()), ("n", pa.int64())])
    return ", ".join([*[f"{k} {t}" for k, t in named], "zone int, lu int, n long"]), fields


def counted_rows(counts: dict[tuple, np.ndarray], fields: pa.Schema) -> pa.Table:
    """(by..., zone, lu, n) of counts by zone * 256 + use; no zone and no use count for nothing."""
    keys, width = list(counts), max(map(len, counts.values()), default=0)
    table = np.zeros((len(keys), width), dtype=np.int64)
    for row, n in zip(table, counts.values(), strict=True):
        row[: len(n)] = n
    table[:, :256] = 0
    table[:, ::256] = 0
    which, code = np.nonzero(table)
    named = [pa.array([k[i] for k in keys], f.type).take(pa.array(which)) for i, f in enumerate(list(fields)[:-3])]
    return pa.Table.from_arrays([*named, pa.array((code >> 8).astype(np.int32)), pa.array((code & 255).astype(np.int32)), pa.array(table[which, code])], schema=fields)


def shifted_counts(cells: DataFrame, vectors: DataFrame, nx: int, ny: int, by: list[str], given_bytes: int = GIVEN_BYTES) -> DataFrame:
    """(by..., zone, lu, n): the crosstab for each vector, zones moved on the torus, uses and extent fixed.

    Uses are packed, a byte a cell. Up to `given_bytes` all tasks have them whole, and a band of zones is counted for all vectors where
    it is; beyond, a row of zones meets the row of uses that a vector moves it to by a join of rows. Either way what leaves a task is
    at most zones x uses counts for each vector.
    """
    schema, fields = counts_schema(vectors, by)
    uses = packed_rows(cells, F.when(F.col("ext"), F.col("lu")), nx)
    if nx * ny > given_bytes:
        each = joined_counts(packed_rows(cells, F.col("zone"), nx), uses, vectors, ny, by, schema, fields)
        return each.groupBy(*by, "zone", "lu").agg(F.sum("n").alias("n"))
    grid = np.zeros((ny, nx), dtype=np.uint8)
    for r in uses.collect():  # given_bytes at most
        grid[r["row"]] = np.frombuffer(r["line"], dtype=np.uint8)
    shared = cells.sparkSession.sparkContext.broadcast(grid)
    steps = [(tuple(r[k] for k in by), r["dx"], r["dy"]) for r in vectors.collect()]  # a list of parameters
    band = max(32, min(256, -(-ny // 64)))

    def run(key, rows):  # no type hints: Spark reads them
        top = key[0].as_py() * band
        zone = np.zeros((min(band, ny - top), nx), dtype=np.uint16)
        zone[rows.column("row").to_numpy() - top, rows.column("col").to_numpy()] = rows.column("zone").to_numpy().astype(np.uint16) << 8
        at, counts = np.arange(top, top + len(zone)), {}
        for name, dx, dy in steps:
            use = np.roll(shared.value[(at + dy) % ny], -dx, axis=1)
            counts[name] = np.bincount((zone | use).ravel())
        return counted_rows(counts, fields)

    placed = cells.where("zone > 0").select("row", "col", F.col("zone").cast("int").alias("zone"), F.floor(F.col("row") / band).alias("band"))
    return placed.groupBy("band").applyInArrow(run, schema).groupBy(*by, "zone", "lu").agg(F.sum("n").alias("n"))


def joined_counts(zones: DataFrame, uses: DataFrame, vectors: DataFrame, ny: int, by: list[str], schema: str, fields: pa.Schema) -> DataFrame:
    """Counts of packed rows (row, line) of zones and of uses, met for each vector."""
    steps = F.broadcast(vectors.select(*by, "dx", "dy"))  # a list of parameters
    target = uses.withColumnsRenamed({"row": "at", "line": "uses"})
    met = zones.withColumnRenamed("line", "zones").crossJoin(steps).withColumn("at", F.pmod(F.col("row") + F.col("dy"), F.lit(ny))).join(target, "at").select(*by, "dx", "zones", "uses")

    def run(batches):
        for batch in batches:
            dx, z, u = (batch.column(len(by) + i) for i in range(3))
            counts: dict[tuple, np.ndarray] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)):
                n = counted(*(np.frombuffer(x[i].as_buffer(), dtype=np.uint8) for x in (z, u)), dx[i].as_py())
                if key in counts:
                    size = max(len(counts[key]), len(n))
                    n = np.pad(n, (0, size - len(n))) + np.pad(counts[key], (0, size - len(counts[key])))
                counts[key] = n
            yield from counted_rows(counts, fields).to_batches()

    return met.mapInArrow(run, schema)


def counted(zone: np.ndarray, use: np.ndarray, dx: int) -> np.ndarray:
    """How often each zone * 256 + use stands at a place, zones moved by dx around the line."""
    k = dx % len(zone)
    n = np.bincount((zone[: len(zone) - k].astype(np.uint16) << 8) | use[k:], minlength=1 << 12)
    if k:
        wrapped = np.bincount((zone[len(zone) - k :].astype(np.uint16) << 8) | use[:k], minlength=1 << 12)
        size = max(len(n), len(wrapped))
        n = np.pad(n, (0, size - len(n))) + np.pad(wrapped, (0, size - len(wrapped)))
    return n


def shifted_agreement(cells: DataFrame, xwalk: DataFrame, vectors: DataFrame, nx: int, ny: int, by: list[str]) -> DataFrame:
    """Percentages by group for each vector (by..., dx, dy) of a bounded list."""
    return percentages(measures(shifted_counts(cells, vectors, nx, ny, by), xwalk, *by, "grp"))


def null_summary(null: DataFrame, observed: DataFrame) -> DataFrame:
    """Mean, 95th percentile and one-sided p (share of shifts at or above what is observed) by group."""
    o = observed.select("grp", F.col("strict_pct").alias("o_strict"), F.col("cumulative_pct").alias("o_cumulative"))
    joined = null.join(F.broadcast(o), "grp")
    r = lambda c, name: F.round(c, 6).alias(name)
    p = lambda k: F.avg(F.when(F.col(f"{k}_pct") >= F.col(f"o_{k}"), 1.0).otherwise(0.0))
    return joined.groupBy("grp").agg(
        *[x for k in ("strict", "cumulative") for x in (r(F.avg(f"{k}_pct"), f"{k}_mean"), r(F.percentile(f"{k}_pct", F.lit(0.95)), f"{k}_p95"), r(p(k), f"{k}_p"))]
    )


def decay(shifted: DataFrame) -> DataFrame:
    return shifted.groupBy("distance", "grp").agg(F.round(F.avg("strict_pct"), 4).alias("strict_pct"))


def block_table(cells: DataFrame, size: int, across: int) -> DataFrame:
    """(block, zone, lu, n) of cells inside the extent: what the bootstrap needs of the grid."""
    return cells.where("ext").groupBy(block_id(size, across).alias("block"), "zone", "lu").agg(F.count("*").alias("n"))


def block_weights(spark, reps: int, blocks: int, seed: int) -> DataFrame:
    """(rep, block, times): how often each block is drawn; empty blocks are drawn, too. Dealt out by block, as what they meet is."""
    draws = spark.range(reps).select(F.col("id").alias("rep")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    drawn = draws.select("rep", (draw(F.lit(seed), F.col("rep"), F.col("i")) % blocks).alias("block"))
    return drawn.repartition("block").groupBy("rep", "block").agg(F.count("*").alias("times"))


def block_bootstrap(table: DataFrame, xwalk: DataFrame, weights: DataFrame) -> DataFrame:
    """Percentages by replicate and group, from the block table and the draws: the grid is not read again.

    The table is summed to a few numbers for each block and group before it meets the draws. Both are dealt out by block: Spark takes
    the draws for a table of `reps` rows, as it doesn't see that each makes `blocks` of them, and would send all to the driver.
    """
    sums = measures(table, xwalk, "block", "grp").hint("shuffle_hash")
    weighted = sums.join(weights, "block").groupBy("rep", "grp").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("denom", "strict_n", "cumulative_n")])
    return percentages(weighted)


def intervals(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile intervals by group; undefined replicates count for nothing."""
    tail = (1 - level) / 2
    out = []
    for k in ("strict", "cumulative"):
        for name, q in (("lo", tail), ("hi", 1 - tail)):
            out.append(F.round(F.percentile(f"{k}_pct", F.lit(round(q, 6))), 6).alias(f"{k}_{name}"))
    return replicates.groupBy("grp").agg(*out)


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each stratum, in an order that the seed gives.

    Each stratum's rows with the least hashes are found in lanes first, so a large stratum is not sorted in one task.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    hashed = rows.withColumn("__h", order).withColumn("__lane", F.pmod(F.xxhash64(key), F.lit(64)))
    first = Window.partitionBy(stratum, "__lane").orderBy("__h", key)
    some = hashed.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n)
    last = Window.partitionBy(stratum).orderBy("__h", key)
    return some.withColumn("draw", F.row_number().over(last)).where(F.col("draw") <= n).drop("__h", "__lane", "__r")


def capped(rows: DataFrame, key: str, most: int, seed: int, bins: int = 1 << 16) -> DataFrame:
    """All rows, or `most` of them at random: those with the least hashes of the key, equal ones by the key.

    The hash at which to cut is found in a histogram of `bins` counts; only rows of that bin are sorted.
    """
    hashed = rows.withColumn("__h", draw(F.lit(seed), F.col(key))).withColumn("__bin", F.floor(F.col("__h") / ((1 << 32) // bins)))
    upto, cut, room = 0, None, 0
    for r in sorted(hashed.groupBy("__bin").agg(F.count("*").alias("n")).collect(), key=lambda r: r["__bin"]):
        if upto + r["n"] > most:
            cut, room = r["__bin"], most - upto
            break
        upto += r["n"]
    if cut is None:
        return rows
    last = hashed.where(F.col("__bin") == cut).orderBy("__h", key).limit(room)
    return hashed.where(F.col("__bin") < cut).unionByName(last).drop("__h", "__bin")


def strata(rows: DataFrame, stratum: str) -> DataFrame:
    """Sizes and weights of strata."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    return sizes.withColumn("weight", F.col("size") / F.sum("size").over(Window.partitionBy()))


def sensitivity(variants: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Percentages by variant and group of the valid cells of all variants in one pass."""
    ct = valid(variants).groupBy("variant", "zone", "lu").agg(F.count("*").alias("n"))
    return percentages(measures(ct, xwalk, "variant", "grp"))


def rate(part: Column, whole: Column) -> Column:
    return share(part, whole, 1.0)
