"""Queries on inference, sampling, accuracy and registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domain
from ..config import Settings
from ..operators import accuracy as AC
from ..operators import georef as G
from ..operators import inference as I
from . import bindings as B
from .bindings import SAMPLE_SQL, cells, grid_sql, with_sql
from .tabulation import MEASURES, pct

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


SET = Settings()
CELL = SET.cell_ft
UNIT = "cast('0x' || substr(md5('{seed}:{what}:' || i::varchar), 1, 8) AS bigint) / 4294967296.0::double"
VECTORS = f"""vec AS (SELECT i AS shift, round_even(r * cos(a) / {CELL}::double, 0)::bigint AS dx, round_even(r * sin(a) / {CELL}::double, 0)::bigint AS dy FROM (SELECT i, {SET.null_min_ft}::double + {UNIT.format(seed=SET.seed, what="r")} * {SET.null_max_ft - SET.null_min_ft}::double AS r,
 {UNIT.format(seed=SET.seed, what="a")} * (2 * pi()) AS a FROM (SELECT unnest(range(0, {SET.null_shifts})) AS i)))"""


def shifted_sql(by: str) -> str:
    return f"""shape AS MATERIALIZED (SELECT * FROM dim), given AS MATERIALIZED (SELECT * FROM vec),
target AS MATERIALIZED (SELECT row * nx + col AS place, lu FROM cells, shape WHERE ext AND lu > 0),
moved AS MATERIALIZED (SELECT {by}, zone, ((row + dy) % ny + ny) % ny * nx + ((col + dx) % nx + nx) % nx AS place FROM (SELECT row, col, zone FROM cells WHERE zone > 0), given, shape),
sct AS (SELECT {by}, zone, lu, count(*) AS n FROM moved JOIN target USING (place) GROUP BY ALL),
shifted AS (SELECT {by}, grp, denom::bigint AS denom, {pct('s', 'denom')} AS strict_pct, {pct('c', 'denom')} AS cumulative_pct FROM (SELECT {by}, grp, {MEASURES} FROM sct JOIN xw USING (zone, lu) GROUP BY ALL))"""


def shifted(spark, d):
    nx, ny = B.width(spark, d)
    v = I.shift_vectors(spark, SET.null_shifts, SET.null_min_ft, SET.null_max_ft, CELL, SET.seed)
    return I.shifted_agreement(cells(spark, d), domain.crosswalk(spark), v, nx, ny, ["shift"])


OBS = f"obs AS (SELECT grp, {pct('s', 'denom')} AS os, {pct('c', 'denom')} AS oc FROM (SELECT grp, {MEASURES} FROM (SELECT zone, lu, count(*) AS n FROM cells WHERE ext AND lu > 0 AND zone > 0 GROUP BY ALL) JOIN xw USING (zone, lu) GROUP BY grp))"


@query("st03_toroidal_null", grid_sql("SELECT * FROM shifted", VECTORS, shifted_sql("shift")))
def st03(spark, d):
    return shifted(spark, d)


@query("st04_null_summary", grid_sql("""SELECT grp, round(avg(strict_pct), 6) AS strict_mean, round(quantile_cont(strict_pct, 0.95), 6) AS strict_p95, round(avg((strict_pct >= os)::int), 6) AS strict_p,
 round(avg(cumulative_pct), 6) AS cumulative_mean, round(quantile_cont(cumulative_pct, 0.95), 6) AS cumulative_p95, round(avg((cumulative_pct >= oc)::int), 6) AS cumulative_p FROM shifted JOIN obs USING (grp) GROUP BY grp""", VECTORS, shifted_sql("shift"), OBS))
def st04(spark, d):
    from ..operators.agreement import agreement

    return I.null_summary(shifted(spark, d), agreement(cells(spark, d), domain.crosswalk(spark), "grp"))


DECAY_SQL = f"""vec AS (SELECT distance, direction, round_even(distance * cos(direction * (2 * pi() / {SET.decay_directions})) / {CELL}::double, 0)::bigint AS dx, round_even(distance * sin(direction * (2 * pi() / {SET.decay_directions})) / {CELL}::double, 0)::bigint AS dy
 FROM (SELECT unnest(range(0, {int(SET.decay_max_ft / SET.decay_step_ft) + 1})) * {SET.decay_step_ft}::double AS distance) CROSS JOIN (SELECT unnest(range(0, {SET.decay_directions}))::int AS direction))"""


@query("st05_distance_decay", grid_sql("SELECT distance, grp, round(avg(strict_pct), 4) AS strict_pct FROM shifted GROUP BY ALL", DECAY_SQL, shifted_sql("distance, direction")))
def st05(spark, d):
    nx, ny = B.width(spark, d)
    v = I.decay_vectors(spark, SET.decay_max_ft, SET.decay_step_ft, SET.decay_directions, CELL)
    return I.decay(I.shifted_agreement(cells(spark, d), domain.crosswalk(spark), v, nx, ny, ["distance", "direction"]))


@query("st03_shifted_counts", grid_sql("SELECT shift, zone, lu, n FROM sct", VECTORS, shifted_sql("shift")))
def st03c(spark, d):
    nx, ny = B.width(spark, d)
    v = I.shift_vectors(spark, SET.null_shifts, SET.null_min_ft, SET.null_max_ft, CELL, SET.seed)
    return I.shifted_counts(cells(spark, d), v, nx, ny, ["shift"])


@query("st09_misregistration", grid_sql("SELECT shift, grp, strict_pct FROM shifted", "vec(shift, dx, dy) AS (VALUES (1::bigint, 1::bigint, 0::bigint), (2, -1, 0), (3, 0, 1), (4, 0, -1))", shifted_sql("shift")))
def st09(spark, d):
    nx, ny = B.width(spark, d)
    v = spark.createDataFrame([(1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1)], "shift long, dx long, dy long")
    return I.shifted_agreement(cells(spark, d), domain.crosswalk(spark), v, nx, ny, ["shift"]).select("shift", "grp", "strict_pct")


REPS = SET.bootstrap_reps
BT = f"bt AS (SELECT {B.block_sql(20)} AS block, zone, lu, count(*) AS n FROM cells, dim WHERE ext GROUP BY ALL)"
DRAWS = f"""blocks AS (SELECT cast(ceil(nx / 20.0) * ceil(ny / 20.0) AS bigint) AS m FROM dim),
draws AS (SELECT rep, cast('0x' || substr(md5('{SET.seed}:' || rep::varchar || ':' || i::varchar), 1, 8) AS bigint) % m AS block, count(*) AS times FROM (SELECT unnest(range(0, {REPS})) AS rep) CROSS JOIN (SELECT m, unnest(range(0, m)) AS i FROM blocks) GROUP BY ALL)"""
BOOT = f"boot AS (SELECT rep, grp, denom::bigint AS denom, {pct('s', 'denom')} AS strict_pct, {pct('c', 'denom')} AS cumulative_pct FROM (SELECT rep, grp, sum(denom * times) AS denom, sum(s * times) AS s, sum(c * times) AS c FROM (SELECT block, grp, {MEASURES} FROM bt JOIN xw USING (zone, lu) WHERE lu > 0 GROUP BY ALL) JOIN draws USING (block) GROUP BY ALL))"


@query("st06_block_table", grid_sql("SELECT block, zone, lu, n FROM bt", BT))
def st06(spark, d):
    return I.block_table(cells(spark, d), 20, B.blocks(spark, d, 20)[0])


def boot(spark, d):
    across, down = B.blocks(spark, d, 20)
    return I.block_bootstrap(I.block_table(cells(spark, d), 20, across), domain.crosswalk(spark), I.block_weights(spark, REPS, across * down, SET.seed))


@query("st07_block_bootstrap", grid_sql("SELECT * FROM boot", BT, DRAWS, BOOT))
def st07(spark, d):
    return boot(spark, d)


@query("ag19_percentile_interval", grid_sql("SELECT grp, round(quantile_cont(strict_pct, 0.025), 6) AS strict_lo, round(quantile_cont(strict_pct, 0.975), 6) AS strict_hi, round(quantile_cont(cumulative_pct, 0.025), 6) AS cumulative_lo, round(quantile_cont(cumulative_pct, 0.975), 6) AS cumulative_hi FROM boot GROUP BY grp", BT, DRAWS, BOOT))
def ag19(spark, d):
    return I.intervals(boot(spark, d))


@query("st08_sensitivity", grid_sql(f"""SELECT variant, grp, denom::bigint AS denom, {pct('s', 'denom')} AS strict_pct, {pct('c', 'denom')} AS cumulative_pct FROM (SELECT variant, grp, {MEASURES} FROM (
 SELECT variant, zone, lu, count(*) AS n FROM (SELECT 'base' AS variant, zone, lu, ext FROM cells UNION ALL SELECT 'vacant', zone, CASE WHEN v % 7 = 0 THEN 9 ELSE lu END, ext FROM cells UNION ALL SELECT 'moved', (zone + 1) % 11, lu, ext FROM cells)
 WHERE ext AND lu > 0 AND zone > 0 GROUP BY ALL) JOIN xw USING (zone, lu) GROUP BY ALL)"""))
def st08(spark, d):
    c = cells(spark, d)
    variant = F.explode(F.array(F.struct(F.lit("base").alias("variant"), "zone", "lu"), F.struct(F.lit("vacant").alias("variant"), "zone", F.when(F.col("v") % 7 == 0, 9).otherwise(F.col("lu")).alias("lu")), F.struct(F.lit("moved").alias("variant"), ((F.col("zone") + 1) % 11).alias("zone"), "lu")))
    return I.sensitivity(c.select("ext", variant.alias("x")).select("ext", "x.*"), domain.crosswalk(spark))


SM = "SELECT stratum, id, r AS draw FROM (SELECT o_orderpriority AS stratum, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('{seed}:' || o_orderkey::varchar), o_orderkey)::int AS r FROM orders) WHERE r <= {n}"


@query("sm01_stratified_sample", SM.format(seed=31415, n=90))
def sm01(spark, d):
    rows = B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("id"))
    return I.stratified_sample(rows, "stratum", "id", 90, 31415).select("stratum", "id", "draw")


@query("sm03_subsample", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('7:' || id::varchar), id) AS k FROM (" + SM.format(seed=31415, n=90) + ")) WHERE k <= 30")
def sm03(spark, d):
    return I.stratified_sample(sm01(spark, d).withColumn("one", F.lit(1)), "one", "id", 30, 7).select("id")


@query("sm02_strata", "SELECT o_orderpriority AS stratum, count(*) AS size, round(count(*) / sum(count(*)) OVER ()::double, 9) AS weight FROM orders GROUP BY o_orderpriority")
def sm02(spark, d):
    rows = B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"))
    return I.strata(rows, "stratum").withColumn("weight", F.round("weight", 9))


M = """wt AS (SELECT stratum, size::double / sum(size) OVER () AS w, size::double AS size FROM design), nh AS (SELECT stratum, count(*)::double AS n_h FROM sample GROUP BY stratum),
m AS (SELECT stratum, ref, n, n_h, w, size, w * n / n_h AS p, n / n_h AS u FROM (SELECT stratum, ref, count(*)::double AS n FROM sample GROUP BY ALL) JOIN nh USING (stratum) JOIN wt USING (stratum))"""


def matrix(spark, d):
    return AC.error_matrix(B.sample(spark, d).select("stratum", "ref"), B.design(spark, d))


@query("acc01_error_matrix", with_sql("SELECT stratum, ref, n::bigint AS n, n_h::bigint AS n_h, round(w, 9) AS w, round(p, 9) AS p FROM m", SAMPLE_SQL, M))
def acc01(spark, d):
    return matrix(spark, d).withColumns({"w": F.round("w", 9), "p": F.round("p", 9)})


@query("acc03_overall", with_sql("SELECT round(oa, 9) AS oa, round(se, 9) AS se, round(oa - 1.96 * se, 9) AS lo, round(oa + 1.96 * se, 9) AS hi FROM (SELECT sum(p) AS oa, sqrt(sum(w * w * u * (1 - u) / (n_h - 1))) AS se FROM m WHERE stratum = ref)", SAMPLE_SQL, M))
def acc03(spark, d):
    return AC.overall(matrix(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("oa", "se", "lo", "hi")])


@query("acc04_by_class", with_sql("""SELECT cls, round(u, 9) AS users, round(sqrt(u * (1 - u) / (nj - 1)), 9) AS users_se, round(pr, 9) AS producers,
 round(sqrt(sj * sj * (1 - pr) ** 2 * u * (1 - u) / (nj - 1) + pr * pr * o) / nhat, 9) AS producers_se, round(share, 9) AS share, round(share_se, 9) AS share_se FROM (
 SELECT ref AS cls, sum(p) AS share, sqrt(sum(w * w * u * (1 - u) / (n_h - 1))) AS share_se, sum(size * u) AS nhat, sum(CASE WHEN stratum = ref THEN p ELSE 0 END) / sum(p) AS pr, max(CASE WHEN stratum = ref THEN n / n_h END) AS u,
 max(CASE WHEN stratum = ref THEN n_h END) AS nj, max(CASE WHEN stratum = ref THEN size END) AS sj, sum(CASE WHEN stratum <> ref THEN size * size * m.u * (1 - m.u) / (n_h - 1) ELSE 0 END) AS o FROM m GROUP BY ref) WHERE u IS NOT NULL""", SAMPLE_SQL, M))
def acc04(spark, d):
    out = AC.by_class(matrix(spark, d), B.design(spark, d))
    return out.select("cls", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("acc05_confusion", with_sql("SELECT pred, ref, n, round(sum(CASE WHEN pred = ref THEN n ELSE 0 END) OVER (PARTITION BY pred)::double / sum(n) OVER (PARTITION BY pred), 9) AS users FROM (SELECT pred, ref, count(*) AS n FROM sample GROUP BY ALL)", SAMPLE_SQL))
def acc05(spark, d):
    return AC.confusion(B.sample(spark, d)).withColumn("users", F.round("users", 9))


@query("acc06_ratio", with_sql("""SELECT round(max(ratio), 9) AS ratio, round(sqrt(sum(w * w * v / n_h)) / max(bx), 9) AS se, max(npts)::bigint AS n FROM (
 SELECT stratum, var_samp(y - ratio * x) AS v, count(*) AS n_h, max(ratio) AS ratio, max(bx) AS bx, max(npts) AS npts FROM sample CROSS JOIN (SELECT sum(w * my) / sum(w * mx) AS ratio, sum(w * mx) AS bx, sum(nx) AS npts
 FROM (SELECT stratum, avg(y) AS my, avg(x) AS mx, sum(x) AS nx FROM sample GROUP BY stratum) JOIN wt USING (stratum)) GROUP BY stratum) JOIN wt USING (stratum)""", SAMPLE_SQL, M))
def acc06(spark, d):
    return AC.ratio_estimate(B.sample(spark, d), B.design(spark, d)).withColumns({"ratio": F.round("ratio", 9), "se": F.round("se", 9)})


@query("acc08_kappa", "SELECT n, agreed, round(agreed / n::double, 9) AS agreement, round((agreed / n::double - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agreed FROM labels), (SELECT sum(a * b)::double AS e FROM (SELECT quality AS c, count(*) AS a FROM labels GROUP BY quality) JOIN (SELECT toxic AS c, count(*) AS b FROM labels GROUP BY toxic) USING (c))")
def acc08(spark, d):
    return AC.kappa(B.read(spark, d, "labels"), "quality", "toxic").withColumns({"agreement": F.round("agreement", 9), "kappa": F.round("kappa", 9)})


@query("acc09_blind_score", with_sql("SELECT pred, count(*) AS n, round(avg((pred = ref)::int), 9) AS agreement FROM sample GROUP BY pred", SAMPLE_SQL))
def acc09(spark, d):
    return B.sample(spark, d).groupBy("pred").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("ref")).cast("int")), 9).alias("agreement"))


@query("jn14_repeat_join", with_sql("SELECT a.pred AS first, b.ref AS second, count(*) AS n FROM sample a JOIN (SELECT id + 1 AS id, ref FROM sample) b USING (id) GROUP BY ALL", SAMPLE_SQL))
def jn14(spark, d):
    s = B.sample(spark, d)
    again = s.select((F.col("id") + 1).alias("id"), F.col("ref").alias("second"))
    return s.select("id", F.col("pred").alias("first")).join(again, "id").groupBy("first", "second").agg(F.count("*").alias("n"))


@query("geo02_normal_equations", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def geo02(spark, d):
    rows = B.read(spark, d, "lineitem").select(F.col("l_quantity").alias("u"), F.lit(1.0).alias("one"), "l_extendedprice")
    sums = G.normal_sums(rows, [F.lit(1.0), F.col("u")], [F.col("l_extendedprice")])
    det = F.col("a_0_0") * F.col("a_1_1") - F.col("a_0_1") * F.col("a_0_1")
    slope = (F.col("a_0_0") * F.col("b_0_1") - F.col("a_0_1") * F.col("b_0_0")) / det
    return sums.select(F.round(slope, 4).alias("slope"), F.round((F.col("b_0_0") - slope * F.col("a_0_1")) / F.col("a_0_0"), 3).alias("intercept"))


POLY = [12.5, 3.0, -2.0, 0.25, 0.125, -0.5]


@query("prj18_polynomial", "SELECT l_orderkey AS k, l_linenumber AS n, round(12.5::double + 3 * u - 2 * v + 0.25::double * u * u + 0.125::double * u * v - 0.5::double * v * v, 6) AS x FROM (SELECT l_orderkey, l_linenumber, l_quantity AS u, l_discount AS v FROM lineitem)")
def prj18(spark, d):
    rows = B.read(spark, d, "lineitem")
    x = G.predict(F.col("l_quantity"), F.col("l_discount"), POLY, 2)
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(x, 6).alias("x"))


@query("prj19_cell_index", "SELECT l_orderkey AS k, l_linenumber AS n, trunc((l_extendedprice - 5000) / 10.0::double)::bigint AS col FROM lineitem")
def prj19(spark, d):
    from ..functions.scalar import cell_index

    return B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), cell_index(F.col("l_extendedprice"), 5000.0, 10.0).alias("col"))


ERR = "e AS (SELECT l_returnflag AS g, sqrt((l_quantity - 25) ** 2 + (100 * l_discount - 5) ** 2) AS e FROM lineitem)"


@query("ag18_residuals", with_sql("SELECT g, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error, round(quantile_cont(e, 0.95), 6) AS p95_error FROM e GROUP BY g", ERR))
def ag18(spark, d):
    e = F.sqrt((F.col("l_quantity") - 25) ** 2 + (100 * F.col("l_discount") - 5) ** 2)
    return G.residual_summary(B.read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g"), e, "g")


@query("geo07_warp", grid_sql("SELECT t.row, t.col, coalesce(s.zone, 0)::int AS zone FROM (SELECT row, col FROM cells) t LEFT JOIN cells s ON s.row = floor(2 + 0.9::double * t.row + 0.1::double * t.col + 0.5::double) AND s.col = floor(1 - 0.1::double * t.row + 0.9::double * t.col + 0.5::double)"))
def geo07(spark, d):
    c = cells(spark, d)
    t = c.select("row", "col")
    return G.warp_nearest(t, c, F.lit(2.0) + 0.9 * F.col("row") + 0.1 * F.col("col"), F.lit(1.0) - 0.1 * F.col("row") + 0.9 * F.col("col"), "zone")


def control(spark, d):
    """Sets of up to 32 control points and 8 check points, as many sets as the suppliers make."""
    s = B.read(spark, d, "supplier")
    u, v = (F.col("s_suppkey") * 53 % 101).cast("double"), (F.col("s_suppkey") * 29 % 97).cast("double")
    rows = s.select(F.floor(F.col("s_suppkey") / 40).cast("string").alias("set_"), F.col("s_suppkey").alias("id"), u.alias("u"), v.alias("v"), (3 * u - v + 0.01 * u * u + F.sin(u)).alias("x"), (u + 2 * v - 0.02 * u * v + F.cos(v)).alias("y"))
    return rows.where("id % 5 <> 4").drop("id"), rows.where("id % 5 = 4")


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("geo06_model_comparison")
def geo06(spark, d):
    points, checks = control(spark, d)
    return rounded(G.compare_models(points, scale=1e-2, checks=checks))


@query("geo09_check_points")
def geo09(spark, d):
    points, checks = control(spark, d)
    return rounded(G.check_errors(checks, points, "order2", 1e-2))


@query("geo05_displacement")
def geo05(spark, d):
    return G.residual_summary(G.displacement(control(spark, d)[0], "order2", "tps", 1e-2), F.col("gap"), "set_")


TERMS = ["1", "u", "v", "u * u", "u * v", "v * v"]


@query("geo02_order_two", "SELECT " + ", ".join(f"round(sum(({a}) * ({b}))::double, 4) AS a_{i}_{j}" for i, a in enumerate(TERMS) for j, b in enumerate(TERMS) if j >= i) + ", " + ", ".join(f"round(sum(({a}) * x)::double, 2) AS b_0_{i}" for i, a in enumerate(TERMS)) + " FROM (SELECT l_linenumber::double AS u, l_quantity / 10 AS v, floor(l_extendedprice) AS x FROM lineitem)")
def geo02q(spark, d):
    """The sums of a second-order fit; its solution is held against known coefficients in the tests."""
    rows = B.read(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("u"), (F.col("l_quantity") / 10).alias("v"), F.floor("l_extendedprice").cast("double").alias("x"))
    sums = G.normal_sums(rows, G.design(F.col("u"), F.col("v"), 2), [F.col("x")])
    return sums.select(*[F.round(c, 2 if c.startswith("b") else 4).alias(c) for c in sums.columns])


@query("sm04_cap", "SELECT l_orderkey AS k, l_linenumber AS n FROM (SELECT *, row_number() OVER (ORDER BY cast('0x' || substr(md5('3:' || (l_orderkey * 16 + l_linenumber)::varchar), 1, 8) AS bigint), l_orderkey * 16 + l_linenumber) AS r FROM lineitem) WHERE r <= 20000")
def sm04(spark, d):
    rows = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"))
    return I.capped(rows, "id", 20000, 3).select("k", "n")


@query("geo01_lambert")
def geo01(spark, d):
    s = B.read(spark, d, "supplier")
    x, y = G.lambert(F.lit(-95.0) + F.col("s_suppkey") / 1000, F.lit(29.0) + F.col("s_suppkey") / 1000, -99.0, 27.0 + 50 / 60, 28.0 + 23 / 60, 30.0 + 17 / 60, 1968500.0, 13123333.333, 0.3048006096012192)
    return s.select(F.col("s_suppkey").alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))
