"""The driver's tables as inputs of the operators: a grid of cells from orders, features from part, boxes from part and supplier.

Each binding comes as a DataFrame and as a common table expression for the SQL that the results are held against.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain

ACRES = 100.0 / 43560.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Columns and rows of the grid."""
    n = read(spark, sf_dir, "orders").count()
    nx = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return nx, -(-n // nx)


def blocks(spark: SparkSession, sf_dir: str, size: int) -> tuple[int, int]:
    """Blocks of `size` cells across and down that cover the grid."""
    nx, ny = width(spark, sf_dir)
    return -(-nx // size), -(-ny // size)


def block_sql(size: int) -> str:
    """The block of a cell, in `FROM cells, dim`."""
    return f"(row // {size}) * cast(ceil(nx / {size}.0) AS bigint) + col // {size}"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nx, _ = width(spark, sf_dir)
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.floor(F.col("o_orderkey") / nx).cast("long").alias("row"), (F.col("o_orderkey") % nx).alias("col"), (F.col("o_custkey") % 11).cast("int").alias("zone"),
        (F.floor("o_totalprice") % 12).cast("int").alias("lu"), (F.col("o_orderstatus") != "P").alias("ext"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("v"),
    )


def shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as a scan: patches of a tone with a fine grain, and rare bright dots."""
    tone = 40 + (F.floor(F.col("row") / 12) * 37 + F.floor(F.col("col") / 12) * 53) % 210
    grey = F.when(F.col("v") % 97 == 0, 230).otherwise(tone + F.col("v") % 6)
    return cells(spark, sf_dir).select("row", "col", grey.cast("double").alias("grey"))


SHADES_SQL = "shades AS (SELECT row, col, cast(CASE WHEN v % 97 = 0 THEN 230 ELSE 40 + ((row // 12) * 37 + (col // 12) * 53) % 210 + v % 6 END AS double) AS grey FROM cells)"


def around_sql(table: str, value: str, radius: int, bright: float = 1e9) -> str:
    """(row, col, v, mean, std, bright) of the square around each cell."""
    span = f"(SELECT unnest(range(-{radius}, {radius + 1})) AS {{}})"
    return f"""SELECT row, col, v, m AS mean, sqrt(greatest(q - m * m, 0.0::double)) AS std, bright FROM (SELECT a.row, a.col, any_value(a.{value}) AS v, avg(b.{value}) AS m, avg(b.{value} * b.{value}) AS q, avg((b.{value} > {bright})::int) AS bright
 FROM {table} a CROSS JOIN {span.format("y")} CROSS JOIN {span.format("x")} JOIN {table} b ON b.row = a.row + y AND b.col = a.col + x GROUP BY a.row, a.col)"""


CELLS_SQL = """
dim AS (SELECT cast(ceil(sqrt(count(*))) AS bigint) AS nx, cast(ceil(count(*) / ceil(sqrt(count(*)))) AS bigint) AS ny FROM orders),
cells AS (SELECT o_orderkey // nx AS row, o_orderkey % nx AS col, cast(o_custkey % 11 AS int) AS zone, cast(cast(floor(o_totalprice) AS bigint) % 12 AS int) AS lu,
  o_orderstatus <> 'P' AS ext, cast(floor(o_totalprice / 100) AS bigint) AS v FROM orders, dim)"""
XW = domain.crosswalk_sql()


def with_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def grid_sql(body: str, *ctes: str) -> str:
    return with_sql(body, CELLS_SQL, XW, *ctes)


# Features: clusters of equal names, a category each.
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("cluster"), F.col("p_type").alias("category"), F.col("p_type").isin("SMALL", "PROMO").alias("neutral"), F.col("p_size").cast("double").alias("area"), "p_name")


FEATURES_SQL = "features AS (SELECT p_partkey AS id, md5(p_name) AS cluster, p_type AS category, p_type IN ('SMALL', 'PROMO') AS neutral, cast(p_size AS double) AS area, p_name FROM part)"


# Boxes: parcels from part, zones from supplier.
def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") * 37 % 1000).cast("double"), (F.col("p_partkey") * 91 % 1000).cast("double")
    return p.select(F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size")).alias("x1"), (y + F.col("p_size")).alias("y1"), (F.col("p_partkey") % 11 + 1).cast("int").alias("lu"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    x, y = (F.col("s_suppkey") * 53 % 1000).cast("double"), (F.col("s_suppkey") * 29 % 1000).cast("double")
    return s.select(F.col("s_suppkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 40).alias("y1"), (F.col("s_suppkey") % 10 + 1).cast("int").alias("zone"))


BOXES_SQL = """
parcels AS (SELECT p_partkey AS id, cast(p_partkey * 37 % 1000 AS double) AS x0, cast(p_partkey * 91 % 1000 AS double) AS y0, cast(p_partkey * 37 % 1000 + p_size AS double) AS x1, cast(p_partkey * 91 % 1000 + p_size AS double) AS y1, cast(p_partkey % 11 + 1 AS int) AS lu FROM part),
zones AS (SELECT s_suppkey AS id, cast(s_suppkey * 53 % 1000 AS double) AS x0, cast(s_suppkey * 29 % 1000 AS double) AS y0, cast(s_suppkey * 53 % 1000 + 60 AS double) AS x1, cast(s_suppkey * 29 % 1000 + 40 AS double) AS y1, cast(s_suppkey % 10 + 1 AS int) AS zone FROM supplier)"""


# A sample of points: strata by priority, map and reference from derived codes.
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    pred = F.col("o_custkey") % 3
    ref = F.when(F.col("o_orderkey") % 7 < 5, pred).otherwise((pred + F.col("o_orderkey") % 3) % 4)
    return o.select(F.col("o_orderkey").alias("id"), pred.cast("string").alias("stratum"), pred.cast("string").alias("pred"), ref.cast("string").alias("ref"), (F.col("o_orderkey") % 5 < 3).cast("int").alias("x"), ((F.col("o_orderkey") % 5 < 3) & (F.col("o_custkey") % 4 < 2)).cast("int").alias("y"))


SAMPLE_SQL = """
sample AS (SELECT o_orderkey AS id, cast(o_custkey % 3 AS varchar) AS stratum, cast(o_custkey % 3 AS varchar) AS pred,
  cast(CASE WHEN o_orderkey % 7 < 5 THEN o_custkey % 3 ELSE (o_custkey % 3 + o_orderkey % 3) % 4 END AS varchar) AS ref,
  cast(o_orderkey % 5 < 3 AS int) AS x, cast(o_orderkey % 5 < 3 AND o_custkey % 4 < 2 AS int) AS y FROM orders),
design AS (SELECT stratum, 1000 * (1 + cast(stratum AS bigint)) AS size FROM (SELECT DISTINCT stratum FROM sample))"""


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, sf_dir).select("stratum").distinct().withColumn("size", 1000 * (1 + F.col("stratum").cast("long")))
