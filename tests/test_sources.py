"""Sources, sinks and the live crosstab."""

import json
import sqlite3
import struct
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise import domain
from plotwise.operators import spatial
from plotwise.plans import bindings
from plotwise.plans.registry import QUERIES
from plotwise.sources import files
from plotwise.sources import tables as src
from plotwise.streaming import reports, sinks

SF = "/root/testdata/sf0.001"


def test_control_points(spark, tmp_path):
    path = tmp_path / "gcp.csv"
    path.write_text("pixel_x,pixel_y,lon,lat\n1,2,3,4\n5,6,7,8\n9,10,11,12\n")
    assert [tuple(r) for r in src.read_control_points(spark, str(path)).collect()][1] == ("1", 5.0, 6.0, 7.0, 8.0)
    path.write_text("pixel_x,pixel_y,lon,lat\n1,2,3,4\n")
    with pytest.raises(ValueError):
        src.read_control_points(spark, str(path))


def test_tokens(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("A B\nC\n")
    tokens = src.read_tokens(spark, str(path))
    rows = spark.createDataFrame([(3,), (1,), (2,)], "id int")
    assert [(r.id, r.token) for r in src.zip_positions(rows, "id", tokens).orderBy("id").collect()] == [(1, "A"), (2, "B"), (3, "C")]
    with pytest.raises(ValueError):
        src.zip_positions(rows.limit(2), "id", tokens)


def test_markdown():
    text = "# x\n| a | b | a |\n|---|---|---|\n| 1 | 2 | 3 |\n\n| c |\n|---|\n| 4 |\n"
    assert src.markdown_table(None, text, "b") == [{"a": "3", "b": "2"}]
    assert src.markdown_table(None, text, "zz") == []


def test_json_default(spark, tmp_path):
    assert src.read_json(spark, str(tmp_path / "none.json"), "a int", '{"a": 5}').first().a == 5


def test_paged_source(spark):
    calls = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            if len(calls) == 1:
                body = {"error": "busy"}
            elif self.path == "/ids":
                body = {"ids": [5, 3, 1, 4, 2]}
            else:
                body = {"features": [{"id": int(i), "kind": "x"} for i in self.path.split("=")[1].split(",")]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    reader = src.PagedReader({"ids_url": f"{at}/ids", "url": f"{at}/get?ids={{ids}}", "chunk": "2", "pause": "0.01"})
    parts = reader.partitions()
    assert [p.ids for p in parts] == [[1, 2], [3, 4], [5]]
    assert [i for p in parts for i, _ in reader.read(p)] == [1, 2, 3, 4, 5]
    spark.dataSource.register(src.PagedSource)
    df = spark.read.format("paged").option("ids", "7,8,9").option("url", f"{at}/get?ids={{ids}}").option("chunk", "2").load()
    assert sorted(r.id for r in df.collect()) == [7, 8, 9]
    server.shutdown()


def test_packed_rows(spark):
    cells = spark.createDataFrame([(0, c, v) for c, v in enumerate([0, 7, 255, 16])], "row long, col long, v int")
    packed = sinks.packed_rows(cells, "v")
    assert [packed.select(sinks.code_at(F.col("codes"), F.lit(c)).alias("v")).first().v for c in range(4)] == [0, 7, 255, 16]


def test_manifest_and_checks(spark, tmp_path):
    import hashlib

    path = tmp_path / "a.bin"
    path.write_bytes(b"abc")
    assert sinks.manifest(spark, [str(path)]).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([(57.8,)], "pct double")
    assert sinks.check(df, "abs(pct - 57.8) < 0.05", "strict").count() == 1
    with pytest.raises(Exception, match="strict"):
        sinks.check(df, "pct < 1", "strict").collect()
    sinks.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().pct == "57.8"


def test_features_as_geojson(spark):
    df = spark.sql("SELECT named_struct('id', 1) AS properties, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 0D, 'y', 1D)) AS ring")
    f = json.loads(sinks.feature_collection(df).first().feature)
    assert f["geometry"]["coordinates"] == [[[0, 0], [1, 0], [0, 1], [0, 0]]]


def test_live_crosstab(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sinks.event_crosstab(stream, "ts", "event_type", late="100 days").writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.s, r.event_type): r.n for r in spark.sql("SELECT window.start AS s, event_type, n FROM live").collect()}
    want = {(r.s, r.event_type): r.n for r in events.groupBy(F.date_trunc("hour", "ts").alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def wkb(rings, order="<", kind=3):
    body = struct.pack(order + "BII", order == "<", kind, len(rings))
    for ring in rings:
        body += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "dd", *p) for p in ring)
    return body


def test_sqlite_and_layers(spark, tmp_path):
    path = tmp_path / "a.mbtiles"
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE metadata (name TEXT, value TEXT); INSERT INTO metadata VALUES ('maxzoom', '12'), ('format', 'png'); CREATE TABLE tiles (zoom_level INT); INSERT INTO tiles VALUES (11), (12), (12);")
    db.commit()
    db.close()
    assert sorted(map(tuple, files.tile_archive(spark, str(path)).collect())) == [("format", "png"), ("maxzoom", "12"), ("zoom", "11"), ("zoom", "12")]

    path = tmp_path / "a.gpkg"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom')")
    db.execute("CREATE TABLE zones (fid INTEGER PRIMARY KEY, geom BLOB, code INT)")
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    hole = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)]
    head = b"GP\0" + bytes([1]) + struct.pack("<i", 2278)
    boxed = b"GP\0" + bytes([3]) + struct.pack("<i4d", 2278, 0, 2, 0, 2)
    both = struct.pack("<BII", 1, 6, 2) + wkb([square, hole]) + wkb([square], ">")
    db.executemany("INSERT INTO zones VALUES (?, ?, ?)", [(1, head + wkb([square, hole]), 7), (2, boxed + both, 8), (3, None, 9)])
    db.commit()
    db.close()
    got = files.read_layer(spark, str(path), "zones", ["code"]).orderBy("fid").collect()
    assert [(r.fid, r.code, [(x.part, x.hole, len(x.ring)) for x in r.rings]) for r in got] == [(1, "7", [(0, False, 4), (0, True, 3)]), (2, "8", [(0, False, 4), (0, True, 3), (1, False, 4)])]


@pytest.mark.parametrize("packed", [False, True])
def test_raster(spark, tmp_path, packed):
    cells = np.arange(5 * 7, dtype="<u2").reshape(5, 7)
    strips = [cells[i : i + 2].tobytes() for i in range(0, 5, 2)]
    strips = [zlib.compress(x) for x in strips] if packed else strips
    tags = [(256, 3, [7]), (257, 3, [5]), (258, 3, [16]), (259, 3, [8 if packed else 1]), (273, 4, None), (277, 3, [1]), (278, 3, [2]), (279, 4, [len(x) for x in strips]), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 500.0, 0.0]), (42113, 2, b"3\0")]
    form = {3: "H", 4: "I", 12: "d"}
    body, at, starts = b"".join(strips), 8, []
    for x in strips:
        starts.append(at)
        at += len(x)
    entries, extra = b"", b""
    extra_at = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = values if kind == 2 else struct.pack(f"<{len(values or starts)}{form[kind]}", *(values or starts))
        n = len(raw) if kind == 2 else len(values or starts)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, n, extra_at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
    path = tmp_path / "a.tif"
    path.write_bytes(b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra)
    got = files.read_raster(spark, str(path)).collect()
    assert {(r.row, r["col"]): r.value for r in got} == {(i, j): float(cells[i, j]) for i in range(5) for j in range(7) if cells[i, j] != 3}
    assert {(r.x, r.y) for r in got if (r.row, r["col"]) == (2, 4)} == {(145.0, 475.0)}


def test_csv_and_crosswalk_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2,\n")
    assert [tuple(r) for r in src.read_csv(spark, str(path), "a int, b string").collect()] == [(1, "x"), (2, None)]


def test_reports(spark, tmp_path):
    c, x = bindings.cells(spark, SF), domain.crosswalk(spark)
    detail = spark.createDataFrame([("b", 1.5), ("a", 20.25)], "detail string, acres double")
    reports.write_reports(spark, str(tmp_path), c, x, detail)
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / name)).collect()
    acres = {r.zone_name: r for r in read("crosstab_acres")}
    assert len(acres) == 15 and float(acres["Total"].Total) == pytest.approx(sum(float(acres[d].Total) for d in [*"ABCDEFGHIJ", "Unclassified"]), abs=0.6)
    assert all(float(r.Total) == 100 for r in read("crosstab_pct"))
    assert len(read("implementation")) == 13 and len(read("reverse_view")) == 44
    assert [r.detail for r in read("detail")] == ["a", "b"]
    summary, bundle = QUERIES["snk05_stats_summary"](spark, SF).cache(), QUERIES["snk10_results_bundle"](spark, SF).cache()
    reports.write_statistics(str(tmp_path), summary, bundle.where("part = 'accuracy'"), bundle)
    assert len(read("stats_summary")) == 3
    lines = [r.value for r in spark.read.text(str(tmp_path / "stats_report")).collect()]
    assert [x.split(":")[0] for x in lines] == ["Commercial", "Industrial", "Residential"]
    parts = {r.part: r.n for r in spark.read.json(str(tmp_path / "results")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert set(parts) == {"groups", "districts", "flows", "decay", "sensitivity", "accuracy"}
    own = {(r.distance, r.grp): r.strict_pct for r in QUERIES["st05_distance_decay"](spark, SF).collect()}
    assert {r["name"]: r.value for r in bundle.where("part = 'decay'").collect()} == {f"{g} @ {int(k)}": v for (k, g), v in own.items()}


def test_simplified_rings():
    ring = [(0, 0), (5, 0.2), (10, 0), (10, 10), (5, 14), (0, 10)]
    assert spatial.simplified(ring, 1.0) == [(0, 0), (10, 0), (10, 10), (5, 14), (0, 10)]
    assert spatial.simplified(ring, 0.1) == ring


def test_numbering(spark):
    rows = spark.range(1000).select(((F.col("id") * 377) % 1009).alias("k"))
    got = sorted((r.k, r.pos) for r in src.numbered(rows, "k").collect())
    assert [p for _, p in got] == list(range(1000))
