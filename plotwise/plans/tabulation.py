"""Queries on recoding, crosstabs, agreement and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domain
from ..operators import agreement as A
from ..operators import crosstab as C
from ..operators import recode as R
from . import bindings as B
from .bindings import ACRES, FEATURES_SQL, cells, features, grid_sql, with_sql

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


PCT = "CASE WHEN {d} <> 0 THEN round(100.0::double * {n} / {d}, 6) END"
pct = lambda n, d: PCT.format(n=n, d=d)
MEASURES = "sum(CASE WHEN NOT is_neutral THEN n ELSE 0 END) AS denom, sum(CASE WHEN is_strict THEN n ELSE 0 END) AS s, sum(CASE WHEN is_cumulative THEN n ELSE 0 END) AS c"
VALID = "ct AS (SELECT zone, lu, count(*) AS n FROM cells WHERE ext AND lu > 0 AND zone > 0 GROUP BY ALL)"
INSIDE = "ct AS (SELECT zone, lu, count(*) AS n FROM cells WHERE ext GROUP BY ALL)"


@query("ag01_crosstab", grid_sql("SELECT z.zone, l.lu, coalesce(n, 0)::bigint AS n FROM (SELECT unnest(range(0, 11))::int AS zone) z CROSS JOIN (SELECT unnest(range(0, 12))::int AS lu) l LEFT JOIN ct USING (zone, lu)", INSIDE))
def ag01(spark, d):
    domain_ = spark.range(11).select(F.col("id").cast("int").alias("zone")).withColumn("lu", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return C.complete(C.crosstab(C.inside(cells(spark, d)), "zone", "lu"), domain_, ["zone", "lu"])


@query("ag02_subtotals", grid_sql("""SELECT (grouping(zone) + grouping(grp))::int AS level, grp, zone, lu, sum(n)::bigint AS n,
 round(100.0::double * sum(n) / sum(sum(n)) OVER (PARTITION BY grouping(zone) + grouping(grp), grp, zone), 6) AS row_pct
 FROM ct LEFT JOIN (SELECT DISTINCT zone, grp FROM xw) USING (zone) GROUP BY GROUPING SETS ((grp, zone, lu), (grp, lu), (lu))""", INSIDE))
def ag02(spark, d):
    return C.subtotals(cells(spark, d), domain.crosswalk(spark))


@query("ag03_wide_crosstab", grid_sql("SELECT zone, " + ", ".join(f"sum(CASE WHEN lu = {u} THEN n ELSE 0 END)::bigint AS u{u}" for u in range(12)) + ", sum(n)::bigint AS total FROM ct GROUP BY zone", INSIDE))
def ag03(spark, d):
    return C.wide(C.crosstab(C.inside(cells(spark, d)), "zone", "lu"), list(range(12)), ["zone"])


@query("ag04_implementation", grid_sql(f"""SELECT is_group, grp, district, round(z * {ACRES}, 6) AS zone_acres, round(p * {ACRES}, 6) AS parcel_acres, {pct('(z - p)', 'z')} AS row_share_pct,
 round(ne * {ACRES}, 6) AS neutral_acres, {pct('ne', 'p')} AS neutral_pct, round((p - ne) * {ACRES}, 6) AS denom_acres, {pct('s', '(p - ne)')} AS strict_pct, {pct('c', '(p - ne)')} AS cumulative_pct
 FROM (SELECT grouping(district)::int AS is_group, grp, district, sum(n)::double AS z, sum(CASE WHEN lu > 0 THEN n ELSE 0 END)::double AS p, sum(CASE WHEN lu > 0 AND is_neutral THEN n ELSE 0 END)::double AS ne,
 sum(CASE WHEN lu > 0 AND is_strict THEN n ELSE 0 END)::double AS s, sum(CASE WHEN lu > 0 AND is_cumulative THEN n ELSE 0 END)::double AS c FROM ct JOIN xw USING (zone, lu) GROUP BY GROUPING SETS ((grp, district), (grp)))""", INSIDE))
def ag04(spark, d):
    return C.implementation(cells(spark, d), domain.crosswalk(spark), ACRES)


@query("ag05_group_agreement", grid_sql(f"SELECT grp, denom::bigint AS denom, {pct('s', 'denom')} AS strict_pct, {pct('c', 'denom')} AS cumulative_pct FROM (SELECT grp, {MEASURES} FROM ct JOIN xw USING (zone, lu) GROUP BY grp)", VALID))
def ag05(spark, d):
    return A.agreement(cells(spark, d), domain.crosswalk(spark), "grp")


@query("ag05_district_agreement", grid_sql(f"SELECT grp, district, denom::bigint AS denom, {pct('s', 'denom')} AS strict_pct, {pct('c', 'denom')} AS cumulative_pct FROM (SELECT grp, district, {MEASURES} FROM ct JOIN xw USING (zone, lu) GROUP BY ALL)", VALID))
def ag05b(spark, d):
    return A.agreement(cells(spark, d), domain.crosswalk(spark), "grp", "district")


@query("ag06_reverse_view", grid_sql("""SELECT lu, grp, sum(n)::bigint AS n, round(100.0::double * sum(n) / sum(sum(n)) OVER (PARTITION BY lu), 6) AS pct
 FROM (SELECT lu, n, coalesce(grp, 'Unclassified') AS grp FROM ct LEFT JOIN (SELECT DISTINCT zone, grp FROM xw) USING (zone) WHERE lu > 0) GROUP BY lu, grp""", INSIDE))
def ag06(spark, d):
    return C.reverse_view(cells(spark, d), domain.crosswalk(spark))


@query("ag07_detail_pairs", "SELECT p_type AS category, p_brand AS detail, count(*) AS n, round(sum(p_size::double) / 43560, 6) AS acres, p_brand LIKE 'Brand#1%' AS vacant FROM part GROUP BY ALL")
def ag07(spark, d):
    p = B.read(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("detail"), F.col("p_size").cast("double").alias("s"))
    return p.groupBy("category", "detail").agg(F.count("*").alias("n"), F.round(F.sum("s") / 43560, 6).alias("acres")).withColumn("vacant", R.is_vacant(F.col("detail"), "Brand#1"))


WINNER = """SELECT cluster, category AS winner FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f {dir}, category) AS r FROM (
 SELECT cluster, category, count(*) AS n, arg_max(neutral, id)::int AS f FROM features GROUP BY ALL)) WHERE r = 1"""


@query("ag08_cluster_winner", with_sql(WINNER.format(dir="ASC"), FEATURES_SQL))
def ag08(spark, d):
    return R.cluster_winners(features(spark, d), "cluster", "category", "neutral", "id")


@query("ag08_cluster_winner_reverse", with_sql(WINNER.format(dir="DESC"), FEATURES_SQL))
def ag08r(spark, d):
    return R.cluster_winners(features(spark, d), "cluster", "category", "neutral", "id", neutral_first=True)


@query("ag09_duplicate_report", with_sql("SELECT sum(n)::bigint AS features, count(*) FILTER (n > 1) AS clusters, coalesce(sum(n) FILTER (n > 1), 0)::bigint AS members, round(coalesce(sum(a - m) FILTER (n > 1), 0.0::double), 4) AS multi_area FROM (SELECT count(*) AS n, sum(area) AS a, max(area) AS m FROM features GROUP BY cluster)", FEATURES_SQL))
def ag09(spark, d):
    return R.duplicate_report(features(spark, d), "cluster", "area")


def use_groups(spark, with_neutral: bool):
    rows = [(u, g) for g, us in domain.USE_GROUPS.items() for u in us] + ([(u, "Neutral") for u in domain.FLOW_NEUTRAL] if with_neutral else [])
    return spark.createDataFrame(rows, f"use string, {'to_grp' if with_neutral else 'use_grp'} string")


def use_sql(with_neutral: bool) -> str:
    rows = [(u, g) for g, us in domain.USE_GROUPS.items() for u in us] + ([(u, "Neutral") for u in domain.FLOW_NEUTRAL] if with_neutral else [])
    return "ug(use, g) AS (VALUES " + ", ".join(f"('{u}', '{g}')" for u, g in rows) + ")"


@query("ag10_off_diagonal", grid_sql("SELECT grp, g AS use_grp, sum(n)::bigint AS n, round(100.0::double * sum(n) / any_value(denom), 6) AS pct FROM (SELECT * FROM ct JOIN xw USING (zone, lu) WHERE NOT is_neutral) JOIN (SELECT grp, sum(n) AS denom FROM ct JOIN xw USING (zone, lu) WHERE NOT is_neutral GROUP BY grp) USING (grp) JOIN ug USING (use) GROUP BY grp, g", VALID, use_sql(False)))
def ag10(spark, d):
    return C.off_diagonal(cells(spark, d), domain.crosswalk(spark), use_groups(spark, False))


@query("ag11_flows", grid_sql("SELECT grp AS from_grp, g AS to_grp, sum(n)::bigint AS n FROM ct JOIN xw USING (zone, lu) JOIN ug USING (use) GROUP BY ALL", VALID, use_sql(True)))
def ag11(spark, d):
    return C.flows(cells(spark, d), domain.crosswalk(spark), use_groups(spark, True))


@query("ag20_area_report", grid_sql("""SELECT zone, coalesce(b, 0)::bigint AS n_before, coalesce(a, 0)::bigint AS n_after, (coalesce(a, 0) - coalesce(b, 0))::bigint AS delta,
 CASE WHEN coalesce(b, 0) <> 0 THEN round(100.0::double * (coalesce(a, 0) - coalesce(b, 0)) / b, 6) END AS delta_pct
 FROM (SELECT zone, count(*) AS b FROM cells GROUP BY zone) FULL JOIN (SELECT zone, count(*) AS a FROM (SELECT CASE WHEN v % 5 = 0 THEN 3 ELSE zone END AS zone FROM cells) GROUP BY zone) USING (zone)"""))
def ag20(spark, d):
    c = cells(spark, d)
    return C.before_after(c, c.withColumn("zone", F.when(F.col("v") % 5 == 0, 3).otherwise(F.col("zone"))), "zone")


@query("ag23_distinct", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def ag23(spark, d):
    return B.read(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


SPREAD = "pi AS (SELECT lu, sum(n)::double / (SELECT sum(n) FROM ct JOIN xw USING (zone, lu) WHERE NOT is_neutral) AS pi FROM ct JOIN xw USING (zone, lu) WHERE NOT is_neutral GROUP BY lu), w AS (SELECT zone, sum(n)::double AS w FROM ct GROUP BY zone)"
BASE = "base AS (SELECT grp, round(100 * sum(w * s) / sum(w), 6) AS strict_pct, round(100 * sum(w * c) / sum(w), 6) AS cumulative_pct FROM (SELECT zone, grp, sum(CASE WHEN is_strict THEN pi ELSE 0 END) AS s, sum(CASE WHEN is_cumulative THEN pi ELSE 0 END) AS c FROM xw JOIN pi USING (lu) GROUP BY ALL) JOIN w USING (zone) GROUP BY grp)"


@query("st01_marginal_baseline", grid_sql("SELECT * FROM base", VALID, SPREAD, BASE))
def st01(spark, d):
    return A.baseline(cells(spark, d), domain.crosswalk(spark))


@query("st02_corrected_index", grid_sql(f"""SELECT grp, CASE WHEN e.strict_pct < 100 THEN round((o.strict_pct - e.strict_pct) / (100 - e.strict_pct), 6) END AS strict_index,
 CASE WHEN e.cumulative_pct < 100 THEN round((o.cumulative_pct - e.cumulative_pct) / (100 - e.cumulative_pct), 6) END AS cumulative_index
 FROM (SELECT grp, {pct('s', 'denom')} AS strict_pct, {pct('c', 'denom')} AS cumulative_pct FROM (SELECT grp, {MEASURES} FROM ct JOIN xw USING (zone, lu) GROUP BY grp)) o JOIN base e USING (grp)""", VALID, SPREAD, BASE))
def st02(spark, d):
    x = domain.crosswalk(spark)
    return A.corrected(A.agreement(cells(spark, d), x, "grp"), A.baseline(cells(spark, d), x))


@query("prj10_agreement_class", grid_sql("SELECT agree, count(*) AS n FROM (SELECT CASE WHEN zone = 0 OR lu = 0 THEN 0 WHEN is_neutral THEN 4 WHEN is_strict THEN 1 WHEN is_cumulative THEN 2 ELSE 3 END AS agree FROM cells LEFT JOIN xw USING (zone, lu)) GROUP BY agree"))
def prj10(spark, d):
    return A.classify_cells(cells(spark, d), domain.crosswalk(spark)).groupBy("agree").agg(F.count("*").alias("n"))


TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "LARGE", "SMALL"]
CASE = "CASE p_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " ELSE 11 END"


@query("prj01_recode", f"SELECT p_partkey AS id, {CASE} AS code FROM part")
def prj01(spark, d):
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.code_of(F.col("p_type"), TYPES, 11).alias("code"))


@query("prj02_burn_code", f"SELECT p_partkey AS id, CASE WHEN c IS NULL THEN 11 WHEN c IN ('SMALL') OR p_brand LIKE 'Brand#1%' THEN 9 ELSE CASE c " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES, 1)) + " ELSE 11 END END AS code, (c IS NULL OR c IN ('SMALL') OR p_brand LIKE 'Brand#1%') AS neutral FROM (SELECT *, nullif(p_type, 'MEDIUM') AS c FROM part)")
def prj02(spark, d):
    c = F.when(F.col("p_type") != "MEDIUM", F.col("p_type"))
    neutral = R.is_neutral(c, F.col("p_brand"), ["SMALL"], True, "Brand#1")
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.burn_code(c, TYPES, neutral, 11, 9).alias("code"), neutral.alias("neutral"))


@query("prj04_text_fields", "SELECT p_partkey AS id, trim(p_name) LIKE 'small%' AS vacant, md5(coalesce(nullif(p_name, 'red widget'), '')) AS fingerprint, coalesce(nullif(p_type, 'PROMO'), '(null)') AS category, try_cast(trim(replace(p_brand, 'Brand#', ' ')) AS int) AS brand FROM part")
def prj04(spark, d):
    name = F.when(F.col("p_name") != "red widget", F.col("p_name"))
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.is_vacant(F.col("p_name"), "small").alias("vacant"), R.fingerprint(name.cast("binary")).alias("fingerprint"), R.or_sentinel(F.when(F.col("p_type") != "PROMO", F.col("p_type"))).alias("category"), R.safe_int(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(" "))).alias("brand"))


@query("prj08_units", "SELECT p_partkey AS id, round(p_size / 43560.0::double, 9) AS acres, round(p_size * 100 / 43560.0::double, 9) AS cell_acres, round(455 / 3000.0::double * p_size, 6) AS px FROM part")
def prj08(spark, d):
    s = F.col("p_size").cast("double")
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(s / 43560.0, 9).alias("acres"), F.round(s * 100 / 43560.0, 9).alias("cell_acres"), F.round(F.lit(455 / 3000.0) * s, 6).alias("px"))


@query("prj12_rollup_maps", grid_sql("SELECT grp, g AS use_grp, count(*) AS pairs FROM xw JOIN ug USING (use) GROUP BY ALL", use_sql(True)))
def prj12(spark, d):
    return domain.crosswalk(spark).join(F.broadcast(use_groups(spark, True)), "use").groupBy("grp", F.col("to_grp").alias("use_grp")).agg(F.count("*").alias("pairs"))


@query("prj13_hex_colour", "SELECT p_partkey AS id, cast('0x' || substr(h, 1, 2) AS int) AS r, cast('0x' || substr(h, 3, 2) AS int) AS g, cast('0x' || substr(h, 5, 2) AS int) AS b FROM (SELECT p_partkey, substr(md5(p_name), 1, 6) AS h FROM part)")
def prj13(spark, d):
    from ..functions.scalar import hex_rgb

    r, g, b = hex_rgb(F.substring(F.md5("p_name"), 1, 6))
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), r.alias("r"), g.alias("g"), b.alias("b"))


@query("prj14_parse", r"SELECT l_orderkey AS k, l_linenumber AS n, cast(regexp_extract(s, '^([\d.]+)%', 1) AS double) AS pct, cast(regexp_extract(s, '\[([\d.]+), *([\d.]+)\]', 1) AS double) AS lo, cast(regexp_extract(s, '\[([\d.]+), *([\d.]+)\]', 2) AS double) AS hi FROM (SELECT l_orderkey, l_linenumber, l_linenumber::varchar || '.5% [' || (l_linenumber - 1)::varchar || '.25, ' || (l_linenumber + 1)::varchar || '.75]' AS s FROM lineitem)")
def prj14(spark, d):
    from ..functions.scalar import parse_interval, parse_percent

    n = F.col("l_linenumber")
    s = F.concat(n.cast("string"), F.lit(".5% ["), (n - 1).cast("string"), F.lit(".25, "), (n + 1).cast("string"), F.lit(".75]"))
    lo, hi = parse_interval(s)
    return B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), parse_percent(s).alias("pct"), lo.alias("lo"), hi.alias("hi"))


@query("prj15_resolution", "SELECT z, round(156543.03::double / pow(2.0::double, z) * 1.0001::double, 6) AS metres FROM (SELECT DISTINCT p_size % 20 AS z FROM part)")
def prj15(spark, d):
    from ..operators.georef import cell_resolution

    return B.read(spark, d, "part").select((F.col("p_size") % 20).alias("z")).distinct().select("z", F.round(cell_resolution(F.col("z")), 6).alias("metres"))


@query("prj16_mercator", "SELECT s_suppkey AS id, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS y FROM (SELECT s_suppkey, cast(s_suppkey % 360 - 180 AS double) AS lon, cast(s_suppkey % 160 - 80 AS double) + 0.5::double AS lat FROM supplier)")
def prj16(spark, d):
    from ..operators.georef import web_mercator

    x, y = web_mercator((F.col("s_suppkey") % 360 - 180).cast("double"), (F.col("s_suppkey") % 160 - 80).cast("double") + 0.5)
    return B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("prj21_formatting", "SELECT p_partkey AS id, format('{:,.1f}', floor(p_retailprice * 100)) AS price, CASE WHEN p_partkey % 5 = 0 THEN '< 0.0025' ELSE printf('%.4f', (p_partkey % 5) / 400.0::double) END AS p FROM part")
def prj21(spark, d):
    from ..functions.scalar import below, thousands

    rows = B.read(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("id"), thousands(F.floor(F.col("p_retailprice") * 100)).alias("price"), below(F.col("p_partkey") % 5 / 400, 400).alias("p"))


@query("prj17_scaled_box", "SELECT p_partkey AS id, p_partkey // 8 AS x, trunc(p_retailprice / 8)::bigint AS y, greatest(0, p_partkey - 100)::bigint AS origin FROM part")
def prj17(spark, d):
    from ..functions.scalar import tile_origin

    return B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") / 8).cast("long").alias("x"), (F.col("p_retailprice") / 8).cast("long").alias("y"), tile_origin(F.col("p_partkey"), 200).alias("origin"))


@query("flt01_masks", grid_sql("SELECT count(*) FILTER (ext AND lu > 0 AND zone > 0) AS valid, count(*) FILTER (ext) AS inside, count(*) FILTER (ext AND lu > 0 AND zone > 0 AND lu NOT IN (9, 11)) AS active, count(*) FILTER (NOT (row BETWEEN 3 AND 9 AND col BETWEEN 4 AND 20)) AS outside_box FROM cells"))
def flt01(spark, d):
    n = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    return cells(spark, d).agg(n("ext AND lu > 0 AND zone > 0").alias("valid"), n("ext").alias("inside"), n("ext AND lu > 0 AND zone > 0 AND lu NOT IN (9, 11)").alias("active"), n("NOT (row BETWEEN 3 AND 9 AND col BETWEEN 4 AND 20)").alias("outside_box"))


@query("jn01_star", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def jn01(spark, d):
    t = lambda n: B.read(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("jn01_cell_join", grid_sql("SELECT zone, lu, count(*) AS n FROM (SELECT row, col, zone FROM cells WHERE zone > 0) JOIN (SELECT row, col, lu FROM cells WHERE lu > 0) USING (row, col) JOIN (SELECT row, col FROM cells WHERE ext) USING (row, col) GROUP BY ALL"))
def jn01c(spark, d):
    c = cells(spark, d)
    return c.where("zone > 0").select("row", "col", "zone").join(c.where("lu > 0").select("row", "col", "lu"), ["row", "col"]).join(c.where("ext").select("row", "col"), ["row", "col"], "left_semi").groupBy("zone", "lu").agg(F.count("*").alias("n"))


@query("jn06_membership", grid_sql("SELECT zone, count(*) AS n FROM cells WHERE (zone, lu) IN (SELECT (zone, lu) FROM xw WHERE is_strict) GROUP BY zone"))
def jn06(spark, d):
    strict = domain.crosswalk(spark).where("is_strict").select("zone", "lu")
    return cells(spark, d).join(F.broadcast(strict), ["zone", "lu"], "left_semi").groupBy("zone").agg(F.count("*").alias("n"))


@query("jn07_positional", "SELECT s_suppkey AS id, tok AS token FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) JOIN (SELECT 't' || unnest(range((SELECT count(*) FROM supplier)))::varchar AS tok, unnest(range((SELECT count(*) FROM supplier))) AS pos) USING (pos)")
def jn07(spark, d):
    from ..sources.tables import zip_positions

    s = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    tokens = spark.range(s.count()).select(F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"))
    return zip_positions(s, "id", tokens).select("id", "token")


@query("jn08_winner_back", with_sql(f"SELECT f.id, f.category, coalesce(w.winner, f.category) AS winner FROM features f LEFT JOIN ({WINNER.format(dir='ASC')}) w USING (cluster)", FEATURES_SQL))
def jn08(spark, d):
    f = features(spark, d)
    return R.with_winners(f, R.cluster_winners(f, "cluster", "category", "neutral", "id"), "cluster", "category").select("id", "category", "winner")


@query("tk01_last_writer", "SELECT l_orderkey AS cell, arg_max(l_partkey, (l_returnflag = 'R', l_linenumber, l_partkey)) AS value FROM lineitem GROUP BY l_orderkey")
def tk01(spark, d):
    rows = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("value"), "l_returnflag", "l_linenumber")
    return R.last_writer(rows, "cell", "value", F.col("l_returnflag") == "R", F.col("l_linenumber"), F.col("value"))


@query("tk02_worst", "SELECT c_custkey AS id, c_acctbal AS residual FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def tk02(spark, d):
    return B.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("residual")).orderBy(F.col("residual").desc(), "id").limit(5)


@query("tk04_top_per_class", "SELECT p_type AS cls, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 8")
def tk04(spark, d):
    rows = B.read(spark, d, "part").select(F.col("p_type").alias("cls"), F.col("p_partkey").alias("id"), "p_retailprice")
    return R.top_per_class(rows, "cls", 8, F.col("p_retailprice").desc(), F.col("id")).select("cls", "id")
