"""Queries on windows, morphology, components, overlays and resampling of grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domain
from ..operators import graph, grid, tiles
from ..operators import spatial as SP
from . import bindings as B
from .bindings import BOXES_SQL, cells, grid_sql, with_sql

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def values(spark, d):
    return cells(spark, d).select("row", "col", "zone", "lu", "ext", F.col("v").cast("double").alias("v"))


def box_join(r: int) -> str:
    return f"cells a CROSS JOIN (SELECT unnest(range(-{r}, {r + 1})) AS y) CROSS JOIN (SELECT unnest(range(-{r}, {r + 1})) AS x) JOIN cells b ON b.row = a.row + y AND b.col = a.col + x"


@query("foc01_box_mean", grid_sql(f"SELECT a.row, a.col, round(avg(b.v), 6) AS mean FROM {box_join(2)} GROUP BY a.row, a.col"))
def foc01(spark, d):
    return tiles.box_mean(values(spark, d), "v", 2).select("row", "col", F.round("mean", 6).alias("mean"))


@query("foc02_local_std", grid_sql(f"SELECT row, col, round(sqrt(greatest(mq - m * m, 0.0::double)), 4) AS std FROM (SELECT a.row, a.col, avg(b.v) AS m, avg((b.v * b.v)::double) AS mq FROM {box_join(2)} GROUP BY a.row, a.col)"))
def foc02(spark, d):
    return tiles.texture(values(spark, d), "v", 2).select("row", "col", F.round("std", 4).alias("std"))


@query("foc03_local_fraction", grid_sql(f"SELECT a.row, a.col, round(avg((b.zone > 4)::int), 6) AS share FROM {box_join(1)} GROUP BY a.row, a.col"))
def foc03(spark, d):
    return tiles.texture(values(spark, d), "zone", 1, bright=4).select("row", "col", F.round("bright", 6).alias("share"))


@query("foc09_gabor_energy")
def foc09(spark, d):
    return tiles.gabor_energy(B.shades(spark, d), "grey")


# Limits of tone and grain for blank paper and for streets.
PAPER, STREET = "v > 212 AND std < 4", "v > 195 AND std < 14"


@query("flt04_paper_and_street", grid_sql(f"SELECT row, col, {PAPER} AS paper, {STREET} AS street FROM ({B.around_sql('shades', 'grey', 2)}) WHERE ({PAPER}) OR ({STREET})", B.SHADES_SQL))
def flt04(spark, d):
    near = tiles.texture(B.shades(spark, d), "grey", 2)
    return near.select("row", "col", F.expr(PAPER).alias("paper"), F.expr(STREET).alias("street")).where("paper OR street")


# Limits for solid areas, to begin with (15 cells wide) and to grow into (7 cells wide).
SEED, RELAXED = "mean < 95 AND std < 20 AND bright < 0.03", "mean < 120 AND std < 35 AND bright < 0.08"
RULES_SQL = (B.SHADES_SQL, f"seed AS (SELECT row, col FROM ({B.around_sql('shades', 'grey', 7, 150)}) WHERE {SEED})", f"relaxed AS (SELECT row, col FROM ({B.around_sql('shades', 'grey', 3, 150)}) WHERE {RELAXED})")


def rules(spark, d):
    grey = B.shades(spark, d)
    return tiles.texture(grey, "grey", 7, bright=150).where(SEED).select("row", "col"), tiles.texture(grey, "grey", 3, bright=150).where(RELAXED).select("row", "col")


@query("flt09_seed_rules", grid_sql("SELECT row, col, 'seed' AS rule FROM seed UNION ALL SELECT row, col, 'relaxed' FROM relaxed", *RULES_SQL))
def flt09(spark, d):
    seed, relaxed = rules(spark, d)
    return seed.withColumn("rule", F.lit("seed")).unionByName(relaxed.withColumn("rule", F.lit("relaxed")))


@query("flt09_growth", grid_sql("SELECT row, col, min(ring)::int AS ring FROM g GROUP BY row, col", *RULES_SQL, """g(row, col, ring) AS (SELECT row, col, 0 FROM seed UNION SELECT r.row, r.col, g.ring + 1 FROM g JOIN relaxed r ON abs(r.row - g.row) + abs(r.col - g.col) = 1 WHERE g.ring < 5)""").replace("WITH", "WITH RECURSIVE", 1))
def flt09g(spark, d):
    seed, relaxed = rules(spark, d)
    return graph.geodesic_growth(seed, relaxed, 5)


PATCHES = "patches AS (SELECT row, col FROM (SELECT unnest(range(0, ny - 15, 8)) AS row FROM dim) CROSS JOIN (SELECT unnest(range(0, nx - 15, 8)) AS col FROM dim))"


@query("flt06_patch_filter", grid_sql("SELECT p.row, p.col, round(count(c.row) / 256.0::double, 6) AS street FROM patches p LEFT JOIN (SELECT row, col FROM cells WHERE zone = 3) c ON c.row BETWEEN p.row AND p.row + 15 AND c.col BETWEEN p.col AND p.col + 15 GROUP BY p.row, p.col HAVING count(c.row) / 256.0::double < 0.09", PATCHES))
def flt06(spark, d):
    from ..operators.texture import patch_grid

    nx, ny = B.width(spark, d)
    street = grid.integral(cells(spark, d).withColumn("street", (F.col("zone") == 3).cast("int")), "street")
    whole = street.select("row", "col", "sat")
    patch = patch_grid(spark, nx, ny, 16, 8).select((F.col("row").cast("long") * (1 << 20) + F.col("col")).alias("id"), F.col("row").alias("r0"), F.col("col").alias("c0"))
    boxes = patch.withColumns({"r1": F.col("r0") + 15, "c1": F.col("c0") + 15})
    share = grid.rectangle_sums(whole, boxes).join(patch, "id").select(F.col("r0").cast("long").alias("row"), F.col("c0").cast("long").alias("col"), F.round(F.col("total") / 256, 6).alias("street"))
    return share.where("street < 0.09")


@query("ag17_dissolve", grid_sql("""SELECT zone, count(*) AS area, 4 * count(*) - 2 * sum(a + b)::bigint AS perimeter, min(row) AS row_min, min(col) AS col_min, max(row) AS row_max, max(col) AS col_max
 FROM (SELECT c.*, (l.zone IS NOT DISTINCT FROM c.zone AND l.row IS NOT NULL)::int AS a, (u.zone IS NOT DISTINCT FROM c.zone AND u.row IS NOT NULL)::int AS b FROM cells c LEFT JOIN cells l ON l.row = c.row AND l.col = c.col - 1 LEFT JOIN cells u ON u.row = c.row - 1 AND u.col = c.col) GROUP BY zone"""))
def ag17(spark, d):
    return grid.dissolve(cells(spark, d), "zone")


MASK = "mask AS (SELECT row, col FROM cells WHERE zone <> 0)"
OFF = lambda cond: f"(SELECT y, x FROM (SELECT unnest(range(-2, 3)) AS y) CROSS JOIN (SELECT unnest(range(-2, 3)) AS x) WHERE {cond})"
SQUARE, DISK = "abs(x) <= 1 AND abs(y) <= 1", "x * x + y * y <= 4"
ERODED = f"er AS (SELECT m.row, m.col FROM mask m WHERE (SELECT count(*) FROM mask) > 0 AND (m.row, m.col) IN (SELECT (row, col) FROM (SELECT k.row - o.y AS row, k.col - o.x AS col FROM mask k CROSS JOIN {OFF(SQUARE)} o) GROUP BY row, col HAVING count(*) = 9))"
OPENED = f"op AS (SELECT DISTINCT e.row + o.y AS row, e.col + o.x AS col FROM er e CROSS JOIN {OFF(SQUARE)} o)"


def mask(spark, d):
    return cells(spark, d).where("zone <> 0").select("row", "col")


@query("foc04_dilate", grid_sql(f"SELECT DISTINCT row, col FROM (SELECT m.row + o.y AS row, m.col + o.x AS col FROM (SELECT row, col FROM cells WHERE zone = 1) m CROSS JOIN {OFF(DISK)} o) JOIN cells USING (row, col)"))
def foc04(spark, d):
    c = cells(spark, d)
    return grid.dilate(c.where("zone = 1"), grid.disk(2), c)


@query("foc04_erode", grid_sql("SELECT row, col FROM er", MASK, ERODED))
def foc04e(spark, d):
    return grid.erode(mask(spark, d), grid.square(1))


@query("foc04_open", grid_sql("SELECT row, col FROM op", MASK, ERODED, OPENED))
def foc04o(spark, d):
    return grid.opened(mask(spark, d), grid.square(1))


@query("foc05_top_hat", grid_sql("SELECT row, col FROM mask EXCEPT SELECT row, col FROM op", MASK, ERODED, OPENED))
def foc05(spark, d):
    return grid.top_hat(mask(spark, d), grid.square(1))


@query("foc06_median", grid_sql(f"SELECT a.row, a.col, median(b.v)::double AS median FROM {box_join(1)} GROUP BY a.row, a.col"))
def foc06(spark, d):
    return tiles.median_filter(values(spark, d), "v", 1)


@query("foc07_majority", grid_sql(f"SELECT row, col, mode FROM (SELECT row, col, z AS mode, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, z) AS r FROM (SELECT a.row, a.col, b.zone AS z, count(*) AS n FROM {box_join(1)} GROUP BY a.row, a.col, b.zone)) WHERE r = 1"))
def foc07(spark, d):
    return tiles.majority_filter(values(spark, d), "zone", 1)


@query("foc10_toroidal_shift", grid_sql("SELECT ((row + 5) % ny + ny) % ny AS row, ((col - 7) % nx + nx) % nx AS col, zone FROM cells, dim"))
def foc10(spark, d):
    nx, ny = B.width(spark, d)
    return grid.toroidal_shift(cells(spark, d).select("row", "col", "zone"), -7, 5, nx, ny)


SAT = "sat AS (SELECT row, col, sum(r) OVER (PARTITION BY col ORDER BY row) AS sat FROM (SELECT row, col, sum(v) OVER (PARTITION BY row ORDER BY col) AS r FROM cells))"


@query("foc11_summed_area", grid_sql("SELECT row, col, sat::bigint AS sat FROM sat", SAT))
def foc11(spark, d):
    return grid.integral(cells(spark, d), "v").select("row", "col", "sat")


def boxes_on_grid(spark, d):
    p = B.read(spark, d, "part")
    r, c = F.col("p_partkey") % 30, F.col("p_partkey") * 7 % 30
    return p.select(F.col("p_partkey").alias("id"), r.alias("r0"), c.alias("c0"), (r + F.col("p_size") % 6).alias("r1"), (c + F.col("p_size") % 5).alias("c1"))


@query("foc11_rectangle_sums", grid_sql("SELECT id, sum(v)::bigint AS total FROM (SELECT p_partkey AS id, p_partkey % 30 AS r0, p_partkey * 7 % 30 AS c0, p_size FROM part) b JOIN cells ON row BETWEEN r0 AND r0 + p_size % 6 AND col BETWEEN c0 AND c0 + p_size % 5 GROUP BY id"))
def foc11r(spark, d):
    return grid.rectangle_sums(grid.integral(cells(spark, d), "v"), boxes_on_grid(spark, d))


@query("foc12_profile", grid_sql("SELECT row, round(avg((v > 2500)::int), 6) AS share FROM cells GROUP BY row"))
def foc12(spark, d):
    return grid.profile(cells(spark, d), "row", F.col("v") > 2500).select("row", F.round("share", 6).alias("share"))


WALK = """line AS (SELECT event_type AS k, date_diff('hour', TIMESTAMP '2000-01-01', date_trunc('hour', ts)) AS pos, count(*)::double AS value FROM events GROUP BY ALL),
w AS (SELECT *, max((value > 3)::int) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen,
 max((value > 3)::int) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM line)"""


@query("foc13_profile_walk", with_sql("SELECT k, min(pos) FILTER (seen = 1 AND ahead = 0 AND n = 3)::bigint AS edge FROM w GROUP BY k", WALK))
def foc13(spark, d):
    e = B.read(spark, d, "events")
    hour = F.expr("timestampdiff(HOUR, timestamp'2000-01-01 00:00:00', date_trunc('HOUR', ts))").cast("long")
    line = e.groupBy(F.col("event_type").alias("k"), hour.alias("pos")).agg(F.count("*").cast("double").alias("value"))
    return grid.profile_walk(line, "k", "pos", "value", 3.0, 3)


@query("foc14_block_id", grid_sql(f"SELECT {B.block_sql(20)} AS block, count(*) AS n FROM cells, dim GROUP BY ALL"))
def foc14(spark, d):
    return cells(spark, d).groupBy(grid.block_id(20, B.blocks(spark, d, 20)[0]).alias("block")).agg(F.count("*").alias("n"))


@query("foc15_background", grid_sql(f"SELECT row, col, round(least(255.0::double, greatest(0.0::double, v / m * 200)), 6) AS norm FROM (SELECT a.row, a.col, any_value(a.v) + 1 AS v, avg(b.v) + 1 AS m FROM {box_join(3)} GROUP BY a.row, a.col)"))
def foc15(spark, d):
    c = tiles.texture(values(spark, d), "v", 3)
    return c.select("row", "col", F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("v") + 1) / (F.col("mean") + 1) * 200)), 6).alias("norm"))


@query("ag15_mode_downsample", grid_sql("SELECT row, col, zone FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, zone) AS r FROM (SELECT row // 4 AS row, col // 4 AS col, zone, count(*) AS n FROM cells GROUP BY ALL)) WHERE r = 1"))
def ag15(spark, d):
    return grid.mode_downsample(cells(spark, d), "zone", 4)


@query("ag16_first_nonzero", grid_sql("SELECT row // 2 AS row, col // 2 AS col, coalesce(arg_min(zone, (row, col)) FILTER (zone <> 0), 0)::int AS zone FROM cells GROUP BY ALL"))
def ag16(spark, d):
    return grid.first_nonzero(cells(spark, d), "zone")


@query("src07_nearest_resample", grid_sql("SELECT t.r AS row, t.c AS col, zone FROM (SELECT row AS r, col AS c FROM cells) t LEFT JOIN cells ON cells.row = floor(t.r * 0.5::double) AND cells.col = floor(t.c * 0.25::double)"))
def src07(spark, d):
    c = cells(spark, d)
    return grid.nearest_resample(c.select("row", "col", "zone"), c, 0.5, 0.25).select("row", "col", "zone")


@query("src06_overview", grid_sql("SELECT row // 8 AS row, col // 8 AS col, round(avg(v), 6) AS v FROM cells GROUP BY ALL"))
def src06(spark, d):
    return cells(spark, d).groupBy(F.floor(F.col("row") / 8).alias("row"), F.floor(F.col("col") / 8).alias("col")).agg(F.round(F.avg("v"), 6).alias("v"))


@query("pyr01_pyramid", grid_sql("SELECT z::int AS z, row // (2 ** z)::bigint AS row, col // (2 ** z)::bigint AS col, count(*) AS n, round(avg(v), 6) AS mean FROM cells CROSS JOIN (SELECT unnest(range(1, 5)) AS z) GROUP BY ALL"))
def pyr01(spark, d):
    return grid.pyramid(cells(spark, d), "v", 4).withColumn("mean", F.round("mean", 6))


@query("grid_spans", grid_sql("SELECT row, min(col) AS col_start, max(col) AS col_end, zone FROM (SELECT row, col, zone, col - row_number() OVER (PARTITION BY row, zone ORDER BY col) AS g FROM cells) GROUP BY row, zone, g"))
def spans(spark, d):
    return grid.spans(cells(spark, d), "zone").select("row", "col_start", "col_end", "zone")


def flood(eight: bool) -> str:
    touch = "abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1" if eight else "abs(a.row - b.row) + abs(a.col - b.col) <= 1"
    return f"""WITH RECURSIVE {CELLS_CTE}, mask AS (SELECT row, col, row * nx + col AS id FROM cells, dim WHERE zone < 3),
edges AS (SELECT a.id AS a, b.id AS b FROM mask a JOIN mask b ON {touch}),
walk(root, id) AS (SELECT id, id FROM mask UNION SELECT w.root, e.b FROM walk w JOIN edges e ON e.a = w.id)
"""


CELLS_CTE = B.CELLS_SQL.strip()


@query("cc01_components", flood(True) + "SELECT row, col, comp FROM mask JOIN (SELECT id, min(root) AS comp FROM walk GROUP BY id) USING (id)")
def cc01(spark, d):
    nx, _ = B.width(spark, d)
    return graph.components(cells(spark, d).where("zone < 3"), nx)


@query("cc01_components_four", flood(False) + "SELECT row, col, comp FROM mask JOIN (SELECT id, min(root) AS comp FROM walk GROUP BY id) USING (id)")
def cc01f(spark, d):
    nx, _ = B.width(spark, d)
    return graph.components(cells(spark, d).where("zone < 3"), nx, eight=False)


@query("cc05_outlines", flood(False) + """, known AS (SELECT row, col, comp FROM mask JOIN (SELECT id, min(root) AS comp FROM walk GROUP BY id) USING (id))
SELECT k.comp, any_value(n.size) AS area, (4 * any_value(n.size) - count(o.comp))::bigint AS perimeter FROM known k JOIN (SELECT comp, count(*) AS size FROM known GROUP BY comp) n USING (comp) LEFT JOIN known o ON o.comp = k.comp AND abs(k.row - o.row) + abs(k.col - o.col) = 1 GROUP BY k.comp""")
def cc05(spark, d):
    """Outlines of all components, held against their cells: area by the shoelace formula, perimeter by length."""
    rings = graph.outlines(cc01f(spark, d))
    length = F.aggregate(F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])), F.lit(0.0), lambda acc, v: acc + v)
    signed = F.when(F.col("hole"), -SP.ring_area(F.col("ring"))).otherwise(SP.ring_area(F.col("ring")))
    return rings.groupBy("comp").agg(F.sum(signed).cast("long").alias("area"), F.sum(length).cast("long").alias("perimeter"))


@query("ag14_component_sizes", flood(False) + "SELECT comp, count(*) AS size FROM (SELECT id, min(root) AS comp FROM walk GROUP BY id) GROUP BY comp")
def ag14(spark, d):
    return graph.component_sizes(cc01f(spark, d))


@query("ag14_largest_component", flood(False) + "SELECT row, col, comp FROM mask JOIN (SELECT id, min(root) AS comp FROM walk GROUP BY id) USING (id) WHERE comp = (SELECT comp FROM (SELECT id, min(root) AS comp FROM walk GROUP BY id) GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)")
def ag14l(spark, d):
    return graph.largest_component(cc01f(spark, d)).select("row", "col", "comp")


@query("flt08_size_threshold", flood(False) + "SELECT comp, count(*) AS size FROM (SELECT id, min(root) AS comp FROM walk GROUP BY id) GROUP BY comp HAVING count(*) BETWEEN 3 AND 60")
def flt08(spark, d):
    return graph.component_sizes(cc01f(spark, d)).where("size BETWEEN 3 AND 60")


@query("cc02_fill_holes", f"""WITH RECURSIVE {CELLS_CTE}, bg AS (SELECT row, col, row * nx + col AS id FROM cells, dim WHERE zone < 3),
edges AS (SELECT a.id AS a, b.id AS b FROM bg a JOIN bg b ON abs(a.row - b.row) + abs(a.col - b.col) <= 1),
walk(root, id) AS (SELECT id, id FROM bg UNION SELECT w.root, e.b FROM walk w JOIN edges e ON e.a = w.id),
comp AS (SELECT row, col, comp FROM bg JOIN (SELECT id, min(root) AS comp FROM walk GROUP BY id) USING (id)),
holes AS (SELECT comp FROM comp, dim GROUP BY comp HAVING count(*) <= 5 AND NOT bool_or(row = 0 OR col = 0 OR row = ny - 1 OR col = nx - 1))
SELECT row, col FROM cells WHERE zone >= 3 UNION ALL SELECT row, col FROM comp WHERE comp IN (SELECT comp FROM holes)""")
def cc02(spark, d):
    nx, ny = B.width(spark, d)
    c = cells(spark, d)
    return graph.fill_holes(c.where("zone >= 3"), c, nx, ny, 5)


@query("cc03_geodesic_growth", f"""WITH RECURSIVE {CELLS_CTE}, allowed AS (SELECT row, col FROM cells WHERE zone < 5),
g(row, col, ring) AS (SELECT row, col, 0 FROM cells WHERE zone = 0 UNION SELECT a.row, a.col, g.ring + 1 FROM g JOIN allowed a ON abs(a.row - g.row) + abs(a.col - g.col) = 1 WHERE g.ring < 3)
SELECT row, col, min(ring)::int AS ring FROM g GROUP BY row, col""")
def cc03(spark, d):
    c = cells(spark, d)
    return graph.geodesic_growth(c.where("zone = 0"), c.where("zone < 5"), 3)


@query("cc04_component_revert", flood(False) + "SELECT row, col, CASE WHEN size > 4 THEN 0 ELSE 1 END AS value FROM mask JOIN (SELECT id, min(root) AS comp FROM walk GROUP BY id) USING (id) JOIN (SELECT comp, count(*) AS size FROM (SELECT id, min(root) AS comp FROM walk GROUP BY id) GROUP BY comp) USING (comp)")
def cc04(spark, d):
    labelled = cc01f(spark, d).withColumns({"new": F.lit(1), "old": F.lit(0)})
    return graph.revert_components(labelled, graph.component_sizes(labelled), "size > 4", "new", "old").select("row", "col", "value")


SIEVE = f"""WITH RECURSIVE {CELLS_CTE}, m AS (SELECT row, col, zone % 3 AS z, row * nx + col AS id FROM cells, dim),
edges AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) <= 1 AND a.z = b.z),
walk(root, id) AS (SELECT id, id FROM m UNION SELECT w.root, e.b FROM walk w JOIN edges e ON e.a = w.id),
known AS (SELECT row, col, z, comp, count(*) OVER (PARTITION BY comp) AS size FROM m JOIN (SELECT id, min(root) AS comp FROM walk GROUP BY id) USING (id)),
met AS (SELECT k.comp, arg_max(o.z, (o.size, -o.comp)) AS new FROM known k JOIN known o ON abs(k.row - o.row) + abs(k.col - o.col) = 1 AND k.comp <> o.comp AND o.size >= k.size WHERE k.size < 4 GROUP BY k.comp)
SELECT row, col, coalesce(new, z)::int AS zone FROM known LEFT JOIN met USING (comp)"""


@query("foc08_sieve", SIEVE)
def foc08(spark, d):
    nx, _ = B.width(spark, d)
    return graph.sieve(cells(spark, d).select("row", "col", (F.col("zone") % 3).alias("zone")), "zone", nx, 4).withColumn("zone", F.col("zone").cast("int"))


OVERLAY = """pairs AS (SELECT z.id AS left_id, p.id AS right_id, z.zone, p.lu, greatest(z.x0, p.x0) AS x0, greatest(z.y0, p.y0) AS y0, least(z.x1, p.x1) AS x1, least(z.y1, p.y1) AS y1
 FROM zones z JOIN parcels p ON z.x0 < p.x1 AND p.x0 < z.x1 AND z.y0 < p.y1 AND p.y0 < z.y1)"""


@query("jn02_box_overlay", with_sql("SELECT left_id, right_id, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM pairs", BOXES_SQL, OVERLAY))
def jn02(spark, d):
    return SP.box_overlay(B.zones(spark, d), B.parcels(spark, d), 64.0)


@query("jn02_overlay_summary", with_sql("""SELECT district, zone_area, parcel_area, neutral_area, parcel_area - neutral_area AS denom_area, strict_area, cumulative_area,
 CASE WHEN parcel_area <> neutral_area THEN round(100 * strict_area / (parcel_area - neutral_area), 6) END AS strict_pct, CASE WHEN parcel_area <> neutral_area THEN round(100 * cumulative_area / (parcel_area - neutral_area), 6) END AS cumulative_pct
 FROM (SELECT district, sum((x1 - x0) * (y1 - y0)) AS parcel_area, sum(CASE WHEN is_neutral THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS neutral_area, sum(CASE WHEN is_strict THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS strict_area,
 sum(CASE WHEN is_cumulative THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS cumulative_area FROM pairs JOIN xw USING (zone, lu) GROUP BY district)
 JOIN (SELECT district, sum(2400.0::double) AS zone_area FROM zones JOIN (SELECT DISTINCT zone, district FROM xw) USING (zone) GROUP BY district) USING (district)""", BOXES_SQL, OVERLAY, B.XW))
def jn02s(spark, d):
    x = domain.crosswalk(spark)
    z, p = B.zones(spark, d), B.parcels(spark, d)
    names = x.select("zone", "lu", "district", "use")
    pairs = SP.box_overlay(z, p, 64.0).join(z.select(F.col("id").alias("left_id"), "zone"), "left_id").join(p.select(F.col("id").alias("right_id"), "lu"), "right_id").join(F.broadcast(names), ["zone", "lu"]).select("district", "use", "area")
    area = z.join(F.broadcast(x.select("zone", "district").distinct()), "zone").groupBy("district").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("zone_area"))
    return SP.overlay_summary(pairs, area, x)


@query("jn03_clip", with_sql("SELECT id, greatest(x0, 100.0::double) AS x0, greatest(y0, 150.0::double) AS y0, least(x1, 700.0::double) AS x1, least(y1, 800.0::double) AS y1, CASE WHEN x0 >= 100 AND y0 >= 150 AND x1 <= 700 AND y1 <= 800 THEN 'inside' ELSE 'crossing' END AS where_ FROM parcels WHERE greatest(x0, 100) < least(x1, 700) AND greatest(y0, 150) < least(y1, 800)", BOXES_SQL))
def jn03(spark, d):
    return SP.clip_to(B.parcels(spark, d).select("id", *SP.BOX), (100, 150, 700, 800))


@query("jn04_rasterise", with_sql("SELECT row, col, arg_max(lu, (lu NOT IN (9, 11), id))::int AS lu FROM (SELECT id, lu, x0, x1, y0, y1, unnest(range(ceil(y0 / 10 - 0.5)::bigint, ceil(y1 / 10 - 0.5)::bigint)) AS row FROM parcels) CROSS JOIN (SELECT unnest(range(0, 120)) AS col) WHERE (col + 0.5) * 10 >= x0 AND (col + 0.5) * 10 < x1 GROUP BY row, col", BOXES_SQL))
def jn04(spark, d):
    return SP.rasterise_boxes(B.parcels(spark, d), "lu", 10.0, [~F.col("lu").isin(9, 11), F.col("id")])


@query("jn04_rasterise_rings", with_sql("SELECT row, col, arg_max(lu, id)::int AS lu FROM parcels JOIN (SELECT unnest(range(0, 120)) AS row) ON (row + 0.5) * 10 >= y0 AND (row + 0.5) * 10 < y1 JOIN (SELECT unnest(range(0, 120)) AS col) ON (col + 0.5) * 10 >= x0 AND (col + 0.5) * 10 < x1 AND ((col + 0.5) * 10 - x0) + ((row + 0.5) * 10 - y0) < (x1 - x0) GROUP BY row, col", BOXES_SQL))
def jn04r(spark, d):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    p = B.parcels(spark, d).withColumn("ring", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x0", "y1")))  # a triangle
    return SP.rasterise_rings(p.select("id", "lu", "ring"), "lu", 10.0, [F.col("id")])


@query("geo10_ring_measures", with_sql("SELECT id, (x1 - x0) * (y1 - y0) / 2 AS area, x0, y0, x1, y1 FROM parcels", BOXES_SQL))
def geo10(spark, d):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    p = B.parcels(spark, d).select("id", F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x0", "y1")).alias("ring"))
    return p.select("id", SP.ring_area(F.col("ring")).alias("area"), SP.ring_box(F.col("ring")).alias("b")).select("id", "area", "b.*")


@query("jn02_polygon_overlay", with_sql("SELECT left_id, right_id, (x1 - x0) * (y1 - y0) AS area FROM pairs", BOXES_SQL, OVERLAY))
def jn02p(spark, d):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1")).alias("ring")
    return SP.polygon_overlay(B.zones(spark, d).select("id", ring), B.parcels(spark, d).select("id", ring), 64.0)


ELL = "ell AS (SELECT id, unnest([0, 1]) AS part, x0, y0, x1, y1 FROM parcels), parts AS (SELECT id, CASE part WHEN 0 THEN x0 ELSE x0 + (x1 - x0) / 2 END AS x0, CASE part WHEN 0 THEN y0 ELSE y0 END AS y0, CASE part WHEN 0 THEN x0 + (x1 - x0) / 2 ELSE x1 END AS x1, CASE part WHEN 0 THEN y1 ELSE y0 + (y1 - y0) / 2 END AS y1 FROM ell)"


@query("jn02_concave_overlay", with_sql("SELECT a.id AS left_id, b.id AS right_id, round(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))), 6) AS area FROM parts a JOIN parts b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY ALL", BOXES_SQL, ELL))
def jn02c(spark, d):
    """Every parcel less its upper right quarter, a ring with a dent, against every other."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in SP.BOX)
    mx, my = x0 + (x1 - x0) / 2, y0 + (y1 - y0) / 2
    rings = B.parcels(spark, d).select("id", F.array(pt(x0, y0), pt(x1, y0), pt(x1, my), pt(mx, my), pt(mx, y1), pt(x0, y1)).alias("ring"))
    return SP.polygon_overlay(rings, rings, 64.0).withColumn("area", F.round("area", 6)).where("area > 0")


@query("tk05_largest", "SELECT lu, id, area FROM (SELECT *, row_number() OVER (PARTITION BY lu ORDER BY area DESC, id) AS r FROM (SELECT cast(p_partkey % 11 + 1 AS int) AS lu, p_partkey AS id, p_size::double AS area FROM part)) WHERE r = 1")
def tk05(spark, d):
    shapes = B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("area"), (F.col("p_partkey") % 11 + 1).cast("int").alias("lu"))
    return SP.largest_of(shapes, "lu", "area").select("lu", "id", "area")


@query("jn05_point_in_raster", grid_sql("SELECT id, row, col, coalesce(lu, 0)::int AS lu FROM (SELECT p_partkey AS id, trunc((p_partkey * 3 % 2000 - 20) / 10.0::double)::bigint AS col, trunc((p_partkey * 7 % 2000 - 20) / 10.0::double)::bigint AS row FROM part) LEFT JOIN cells USING (row, col)"))
def jn05(spark, d):
    p = B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 3 % 2000).cast("double").alias("x"), (F.col("p_partkey") * 7 % 2000).cast("double").alias("y"))
    return SP.sample_raster(p, cells(spark, d), "lu", 20.0, 20.0, 10.0, 10.0)


NEAR = "t AS (SELECT s_suppkey AS target, cast(s_suppkey * 53 % 1000 AS double) AS tx, cast(s_suppkey * 29 % 1000 AS double) AS ty FROM supplier)"


@query("jn09_nearest", with_sql("SELECT id, arg_min(target, (d2, target)) AS target, min(d2) AS d2 FROM (SELECT id, target, (x0 - tx) ** 2 + (y0 - ty) ** 2 AS d2 FROM parcels CROSS JOIN t) GROUP BY id", BOXES_SQL, NEAR))
def jn09(spark, d):
    points = B.parcels(spark, d).select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    targets = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 1000).cast("double").alias("x"), (F.col("s_suppkey") * 29 % 1000).cast("double").alias("y"))
    return SP.nearest(points, targets, 100.0)


@query("jn10_nearest_label", grid_sql("SELECT row, col, arg_min(z, (d2, rr, cc))::int AS zone FROM (SELECT a.row, a.col, b.zone AS z, (a.row - b.row) ** 2 + (a.col - b.col) ** 2 AS d2, b.row AS rr, b.col AS cc FROM (SELECT * FROM cells WHERE zone = 0) a JOIN (SELECT * FROM cells WHERE zone > 6) b ON abs(a.row - b.row) <= 12 AND abs(a.col - b.col) <= 12) GROUP BY row, col"))
def jn10(spark, d):
    c = cells(spark, d)
    big = 1 << 20
    holes = c.where("zone = 0").select((F.col("row") * big + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    labels = c.where("zone > 6").select((F.col("row") * big + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    near = SP.nearest(holes, labels, 6.0, 2)
    tagged = c.select((F.col("row") * big + F.col("col")).alias("target"), "zone")
    return near.join(tagged, "target").select((F.floor(F.col("id") / big)).alias("row"), (F.col("id") % big).alias("col"), "zone")


@query("jn11_in_hull", with_sql("SELECT id, (30 * (y0 - 100) - 10 * (x0 - 100) >= 0) IS NOT NULL AND inside AS inside FROM (SELECT id, x0, y0, (600 * (y0 - 100) - 100 * (x0 - 100) >= 0 AND -100 * (y0 - 200) - 600 * (x0 - 700) >= 0 AND -500 * (y0 - 800) + 700 * (x0 - 600) >= 0) AS inside FROM parcels)", BOXES_SQL))
def jn11(spark, d):
    hull = SP.convex_hull([(100, 100), (700, 200), (600, 800), (400, 400), (500, 300)])
    return B.parcels(spark, d).select("id", SP.in_hull(F.col("x0"), F.col("y0"), hull).alias("inside"))


@query("src09_in_buffer", with_sql("SELECT id, greatest(200 - x0, 0, x0 - 600) ** 2 + greatest(300 - y0, 0, y0 - 700) ** 2 <= 2500 AS inside FROM parcels", BOXES_SQL))
def src09(spark, d):
    """Parcels' corners within 50 of a study area."""
    corners = SP.simplified([(200.0, 300.0), (400.0, 300.5), (600.0, 300.0), (600.0, 700.0), (200.0, 700.0)], 1.0)
    ring = F.array([F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return B.parcels(spark, d).select("id", SP.in_buffer(F.col("x0"), F.col("y0"), ring, 50.0).alias("inside"))


@query("jn13_legend_lookup", grid_sql("SELECT id, cells.zone, cells.lu, district, use, CASE WHEN cells.zone = 0 OR cells.lu = 0 THEN 0 WHEN is_neutral THEN 4 WHEN is_strict THEN 1 WHEN is_cumulative THEN 2 ELSE 3 END AS agree FROM (SELECT p_partkey AS id, p_partkey * 7 % 50 AS row, p_partkey * 3 % 60 AS col FROM part) JOIN cells USING (row, col) LEFT JOIN xw ON xw.zone = cells.zone AND xw.lu = cells.lu"))
def jn13(spark, d):
    """What a click on the map shows: the cell's district and use by name, and their agreement."""
    from ..operators.agreement import classify_cells

    x = domain.crosswalk(spark)
    p = B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 50).alias("row"), (F.col("p_partkey") * 3 % 60).alias("col"))
    met = p.join(cells(spark, d).select("row", "col", "zone", "lu"), ["row", "col"])
    return classify_cells(met, x).join(F.broadcast(x.select("zone", "lu", "district", "use")), ["zone", "lu"], "left").select("id", "zone", "lu", "district", "use", "agree")


@query("geo08_hull_coverage", grid_sql("SELECT count(*) AS cells, count(*) FILTER (NOT i)::bigint AS outside, round(count(*) FILTER (NOT i) / count(*)::double, 9) AS share FROM (SELECT 26 * (row - 3) - 2 * (col - 4) >= 0 AND -3 * (row - 5) - 24 * (col - 30) >= 0 AND -19 * (row - 29) + 4 * (col - 27) >= 0 AND -4 * (row - 25) + 22 * (col - 8) >= 0 AS i FROM cells WHERE ext)"))
def geo08(spark, d):
    """Share of the extent outside the hull of control points, one of which is inside."""
    return SP.outside_hull(cells(spark, d).where("ext"), [(4, 3), (30, 5), (15, 15), (27, 29), (8, 25)]).withColumn("share", F.round("share", 9))
