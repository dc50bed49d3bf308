"""Extracts and files: packed lookup grids, click lookups, reports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def packed_rows(cells: DataFrame, value: str) -> DataFrame:
    """(row, codes, n): each grid row's codes (0..255) as base64 of a byte a cell, in column order."""
    listed = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.col(value).alias("v")))).alias("c"))
    codes = F.unhex(F.array_join(F.transform("c", lambda x: F.lpad(F.hex(x["v"].cast("long")), 2, "0")), ""))
    return listed.select("row", F.regexp_replace(F.base64(codes), r"\r\n", "").alias("codes"), F.size("c").cast("long").alias("n"))


def code_at(codes: Column, col: Column) -> Column:
    """The code at a column of a packed row."""
    return F.conv(F.hex(F.substring(F.unbase64(codes), col.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def click_index(points: DataFrame, x0: float, y0: float, cell: float, nx: int, ny: int) -> DataFrame:
    """(id, idx): the cell, counted from the north-west corner, that a point lies in; null outside."""
    col, row = F.floor((F.col("x") - x0) / cell), F.floor((F.lit(y0) - F.col("y")) / cell)
    return points.select("id", F.when(col.between(0, nx - 1) & row.between(0, ny - 1), row * nx + col).alias("idx"))


def write_csv(df: DataFrame, path: str, digits: int | None = 1) -> None:
    """A table as CSV; numbers are formatted here and only here."""
    out = df if digits is None else df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def feature_collection(shapes: DataFrame) -> DataFrame:
    """GeoJSON features (one row each) of rings: a struct of properties and a ring of (x, y)."""
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return shapes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("properties"), geometry.alias("geometry"))).alias("feature"))


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check(df: DataFrame, condition: str, message: str) -> DataFrame:
    """The frame, failing on the first row that doesn't meet the condition."""
    return df.where(F.assert_true(F.expr(condition), message).isNull())


def event_crosstab(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key of a stream of events, with a watermark: what a live crosstab adds to."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
