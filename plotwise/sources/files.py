"""Sources in binary files: SQLite queries, GeoPackage layers, GeoTIFF rasters.

Files come through Spark's own binary reader, so they can be wherever Spark can read, and are parsed in the task that gets them; a
file is held whole by that task.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>"


def _opened(content: bytes) -> sqlite3.Connection:
    base = sqlite3.connect(":memory:")
    base.deserialize(content)
    return base


def read_sqlite(spark: SparkSession, paths: str | list[str], sql: str, schema: str) -> DataFrame:
    """The rows that a query gives in each SQLite file (tile archives are such files), by a schema in the order of its columns."""
    fields = spark.createDataFrame([], schema).schema
    kind = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = _opened(content.as_py()).execute(sql)
                while part := rows.fetchmany(4096):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(kind)], schema=kind)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, fields)


def read_layer(spark: SparkSession, paths: str | list[str], layer: str, fields: list[str]) -> DataFrame:
    """A layer of GeoPackage files: fid, the fields as text, and the rings of its polygons; rows without a geometry are left out."""
    base = spark.read.format("binaryFile").load(paths).select("content")
    quoted = lambda name: '"' + name.replace('"', '""') + '"'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        rings = pa.list_(pa.struct([("part", pa.int32()), ("hole", pa.bool_()), ("ring", pa.list_(point))]))
        for batch in batches:
            for content in batch.column(0):
                db = _opened(content.as_py())
                (shape,) = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                key = next((r[1] for r in db.execute(f"PRAGMA table_info({quoted(layer)})") if r[5]), "rowid")
                rows = db.execute(f"SELECT {quoted(key)}, {quoted(shape)}, {', '.join(f'CAST({quoted(f)} AS TEXT)' for f in fields) or 'NULL'} FROM {quoted(layer)} WHERE {quoted(shape)} IS NOT NULL")
                while part := rows.fetchmany(1024):
                    found = [polygons(package_body(r[1])) for r in part]
                    columns = [pa.array([r[i + 2] for r in part], pa.string()) for i in range(len(fields))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), *columns, pa.array(found, rings)], ["fid", *fields, "rings"])

    return base.mapInArrow(run, ", ".join(["fid long", *[f"`{f}` string" for f in fields], f"rings {RINGS}"]))


def package_body(blob: bytes) -> bytes:
    """The well-known binary in a GeoPackage geometry: after eight bytes and the envelope that the flags name."""
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
    return blob[8 + envelope :]


def polygons(body: bytes) -> list[dict]:
    """The rings (part, hole, ring without its repeated last point) of a polygon or of several in well-known binary; heights are dropped."""
    out: list[dict] = []
    at = 0

    def take(form: str):
        nonlocal at
        got = struct.unpack_from(order + form, body, at)
        at += struct.calcsize("<" + form)
        return got

    order = "<" if body[:1] == b"\x01" else ">"
    at = 1
    (kind,) = take("I")
    parts = 1
    if kind % 1000 == 6:
        (parts,) = take("I")
    for part in range(parts):
        if kind % 1000 == 6:
            order = "<" if body[at] == 1 else ">"
            at += 1
            (inner,) = take("I")
        else:
            inner = kind
        if inner % 1000 != 3:
            raise ValueError(f"geometry of type {inner}: only polygons are read")
        width = {0: 2, 1: 3, 2: 3, 3: 4}[inner // 1000 % 4]
        (n_rings,) = take("I")
        for k in range(n_rings):
            (n,) = take("I")
            flat = take(f"{n * width}d")
            points = [{"x": flat[i * width], "y": flat[i * width + 1]} for i in range(n)]
            out.append({"part": part, "hole": k > 0, "ring": points[:-1] if len(points) > 1 and points[0] == points[-1] else points})
    return out


def read_raster(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, row, col, x, y, value) of the first band of GeoTIFF files, x and y being the cell's middle; no cells where the value is
    the file's nodata. Strips or tiles, plain or deflated, of whole numbers or floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                tags = tiff_tags(data)
                (sx, sy), (i, j, _, x, y, _) = tags.get(33550, (1.0, 1.0))[:2], tags.get(33922, (0, 0, 0, 0.0, 0.0, 0))[:6]
                nodata = float(tags[42113].strip("\0 ")) if 42113 in tags else None
                for top, left, cells in tiff_blocks(data, tags):
                    r, c = np.nonzero(cells != nodata) if nodata is not None else np.indices(cells.shape).reshape(2, -1)
                    row, col = r + top, c + left
                    columns = [pa.array([path] * len(r)), pa.array(row), pa.array(col), pa.array(x + (col + 0.5 - i) * sx), pa.array(y - (row + 0.5 - j) * sy), pa.array(cells[r, c].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "row", "col", "x", "y", "value"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, row long, col long, x double, y double, value double")


def tiff_tags(data: bytes) -> dict:
    """The first directory's tags: tuples of numbers, or text."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    forms = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
    tags: dict = {0: order}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in forms:
            continue
        where = at + 10 + 12 * k
        size = struct.calcsize("<" + forms[kind]) * count
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        tags[tag] = data[where : where + size].decode("latin-1") if kind == 2 else struct.unpack_from(f"{order}{count}{forms[kind]}", data, where)
    return tags


def tiff_blocks(data: bytes, tags: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, col, cells) of each strip or tile."""
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bands = one(256), one(257), one(277, 1)
    kind = np.dtype(f"{tags[0]}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)] }{one(258, 8) // 8}")
    if one(259, 1) not in (1, 8, 32946) or one(317, 1) != 1:
        raise ValueError("only plain and deflated rasters without a predictor are read")
    tiled = 324 in tags
    wide, tall = (one(322), one(323)) if tiled else (width, one(278, height))
    across = -(-width // wide)
    for k, (at, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        raw = data[at : at + size]
        flat = np.frombuffer(zlib.decompress(raw) if one(259, 1) != 1 else raw, dtype=kind)
        planar = one(284, 1) == 2
        cells = flat.reshape(-1, wide) if planar or bands == 1 else flat.reshape(-1, wide, bands)[:, :, 0]
        top, left = k // across * tall, k % across * wide
        if top >= height:  # the next band of a file that has one after the other
            return
        yield top, left, cells[: height - top, : width - left]


def tile_archive(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a tile archive's metadata, and a row (zoom, z) for each zoom level that it has tiles of."""
    meta = read_sqlite(spark, path, "SELECT name, value FROM metadata", "name string, value string")
    zooms = read_sqlite(spark, path, "SELECT DISTINCT zoom_level FROM tiles", "z long").distinct()
    return meta.unionByName(zooms.select(F.lit("zoom").alias("name"), F.col("z").cast("string").alias("value")))
