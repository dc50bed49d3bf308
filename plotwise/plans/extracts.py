"""Queries on texture features and classification, lookup extracts, reshaping and text sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import domain
from ..operators import spatial as SP
from ..operators import texture as TX
from ..sources import tables as SRC
from ..streaming import sinks as SNK
from . import bindings as B
from .bindings import cells, grid_sql, with_sql
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


@query("ml01_patch_grid", "SELECT r::int AS row, c::int AS col FROM (SELECT unnest(range(0, 400 - 48 + 1, 16)) AS r) CROSS JOIN (SELECT unnest(range(0, 640 - 48 + 1, 16)) AS c)")
def ml01(spark, d):
    return TX.patch_grid(spark, 640, 400, 48, 16)


@query("ml03_tone_features", grid_sql("SELECT row // 8 AS pr, col // 8 AS pc, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg((v > 3000)::int), 6) AS bright, round(avg((v < 1000)::int), 6) AS dark FROM cells GROUP BY ALL"))
def ml03(spark, d):
    c = cells(spark, d).withColumns({"pr": F.floor(F.col("row") / 8), "pc": F.floor(F.col("col") / 8)})
    return TX.tone_features(c, ["pr", "pc"], "v", 3000, 1000)


@query("ml02_fft_features")
def ml02(spark, d):
    """Every patch of 16 x 16 cells of the grid; pixels that a patch at the edge lacks have the mean of those it has."""
    across, _ = B.blocks(spark, d, 16)
    place = ((F.col("row") % 16) * 16 + F.col("col") % 16).cast("int")
    patch = cells(spark, d).groupBy((F.floor(F.col("row") / 16) * across + F.floor(F.col("col") / 16)).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("v").cast("double")))).alias("m"), F.avg("v").alias("mean"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.col("mean")))  # a patch is 256 pixels
    return TX.fft_features(patch.select("id", pixels.alias("pixels")), 16)


@query("src05_grey", "SELECT p_partkey AS id, floor(least(255.0::double, greatest(0.0::double, 0.299::double * (p_partkey % 256) + 0.587::double * (p_partkey * 7 % 256) + 0.114::double * (p_size % 256))))::int AS grey FROM part")
def src05(spark, d):
    k = F.col("p_partkey")
    return B.read(spark, d, "part").select(k.alias("id"), TX.grey(k % 256, k * 7 % 256, F.col("p_size") % 256).alias("grey"))


@query("ml04_jitter", "SELECT p_partkey AS id, j AS jitter, round(least(255.0::double, greatest(0.0::double, p_size * g + b)), 6) AS x FROM part CROSS JOIN (VALUES (0, 1.0::double, 0.0::double), (1, 0.9, 5.0), (2, 1.1, -5.0), (3, 6.0, 0.0)) t(j, g, b)")
def ml04(spark, d):
    rows = B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"))
    return TX.jittered(rows, "x", [(1.0, 0.0), (0.9, 5.0), (1.1, -5.0), (6.0, 0.0)]).select("id", "jitter", F.round("x", 6).alias("x"))


@query("ml05_standardise", "SELECT l_orderkey AS k, l_linenumber AS n, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS q, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS t FROM lineitem")
def ml05(spark, d):
    rows = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    return TX.standardise(rows, ["q", "t"]).withColumns({c: F.round(c, 6) for c in "qt"})


def vectors(spark, d):
    return B.read(spark, d, "embeddings").select("vec_id", "label", "embedding")


FOLDS = 3
FOREST = {"trees": 40, "depth": 8}


@query("ml06_forest")
def ml06(spark, d):
    """Every vector, by a forest that was taught on the other folds."""
    e = vectors(spark, d)
    out = None
    for k in range(FOLDS):
        own = F.col("vec_id") % FOLDS == k
        part = TX.classify(TX.fit_forest(e.where(~own), "embedding", **FOREST), e.where(own), "embedding")
        out = part if out is None else out.unionByName(part)
    return out.select("vec_id", "label", "pred", F.round("conf", 6).alias("conf"))


@query("ml07_self_training")
def ml07(spark, d):
    """Labels of the first fold teach, all other vectors are the unlabelled ones that it learns from; every vector is classified."""
    e = vectors(spark, d)
    fitted = TX.self_train(e.where(F.col("vec_id") % FOLDS == 0), e.where(F.col("vec_id") % FOLDS != 0), "vec_id", "embedding", floor=0.3, **FOREST)
    return TX.classify(fitted, e, "embedding").select("vec_id", "label", "pred", F.round("conf", 6).alias("conf"))


@query("ml08_fit_summary")
def ml08(spark, d):
    """Rows and hits by class of a forest on its own training rows."""
    e = vectors(spark, d)
    return TX.fit_summary(TX.fit_forest(e, "embedding", **FOREST), e, "embedding")


@query("ml08_importances")
def ml08i(spark, d):
    return TX.importances(spark, TX.fit_forest(vectors(spark, d), "embedding", **FOREST))


D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) ** 2))"


@query("jn09_nearest_vector", f"SELECT id, target, round(d2, 5) AS d2 FROM (SELECT a.vec_id AS id, b.vec_id AS target, {D2} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS r FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r = 1")
def jn09v(spark, d):
    """Every vector whose id is divisible by 100 against all others."""
    e = vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    return SP.nearest_vectors(e.where("id % 100 = 0"), e).withColumn("d2", F.round("d2", 5))


@query("ag12_block_vote", grid_sql("SELECT block, zone FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, zone) AS r FROM (SELECT {block} AS block, zone, count(*) AS n FROM cells, dim WHERE zone > 0 GROUP BY ALL)) WHERE r = 1".format(block=B.block_sql(10))))
def ag12(spark, d):
    from ..operators.grid import block_id

    return TX.block_vote(cells(spark, d).where("zone > 0").withColumn("block", block_id(10, B.blocks(spark, d, 10)[0])), "block", "zone")


@query("ag13_block_fraction", grid_sql(f"SELECT {B.block_sql(10)} AS block, round(avg((zone = 7)::int), 6) AS share, count(*) AS area FROM cells, dim GROUP BY ALL"))
def ag13(spark, d):
    from ..operators.grid import block_id

    return cells(spark, d).groupBy(block_id(10, B.blocks(spark, d, 10)[0]).alias("block")).agg(F.round(F.avg((F.col("zone") == 7).cast("int")), 6).alias("share"), F.count("*").alias("area"))


@query("ml10_fallback", grid_sql(f"SELECT row, col, coalesce(vote, zone)::int AS cls FROM (SELECT cells.*, {B.block_sql(10)} AS block FROM cells, dim) LEFT JOIN (SELECT block, zone AS vote FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, zone) AS r FROM (SELECT {B.block_sql(10)} AS block, zone, count(*) AS n FROM cells, dim WHERE zone > 7 GROUP BY ALL)) WHERE r = 1 AND n >= 12) USING (block)"))
def ml10(spark, d):
    """A block's vote where it rests on a dozen cells, else the cell's own code."""
    from ..operators.grid import block_id

    c = cells(spark, d).withColumn("block", block_id(10, B.blocks(spark, d, 10)[0]))
    sure = c.where("zone > 7").join(c.where("zone > 7").groupBy("block", "zone").agg(F.count("*").alias("n")).groupBy("block").agg(F.max("n").alias("most")).where("most >= 12"), "block", "left_semi")
    votes = TX.block_vote(sure, "block", "zone").withColumnRenamed("zone", "vote")
    return c.join(votes, "block", "left").select("row", "col", F.coalesce("vote", "zone").alias("cls"))


@query("ml11_override", grid_sql("SELECT row, col, CASE WHEN NOT ext THEN 0 WHEN v > 4000 THEN 7 WHEN lu = 5 AND v < 1000 THEN 8 ELSE zone END AS cls FROM cells"))
def ml11(spark, d):
    return cells(spark, d).select("row", "col", TX.merged_override(None, [("NOT ext", "0"), ("v > 4000", "7"), ("lu = 5 AND v < 1000", "8")], "zone").alias("cls"))


@query("flt07_confidence", "SELECT p_type AS cls, count(*) AS n, min(p_retailprice) AS least FROM part WHERE p_retailprice / 1100 >= 0.85 GROUP BY p_type HAVING count(*) >= 5")
def flt07(spark, d):
    return B.read(spark, d, "part").where("p_retailprice / 1100 >= 0.85").groupBy(F.col("p_type").alias("cls")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("least")).where("n >= 5")


@query("prj09_lookup_colour", grid_sql("SELECT zone, concat_ws(',', (zone * 25) % 256, (zone * 40) % 256, 255 - zone * 20) AS rgb, count(*) AS n FROM cells GROUP BY zone"))
def prj09(spark, d):
    lut = F.create_map(*[x for z in range(11) for x in (F.lit(z), F.array(*[F.lit(c) for c in ((z * 25) % 256, (z * 40) % 256, 255 - z * 20)]))])
    return cells(spark, d).groupBy("zone").agg(F.count("*").alias("n")).select("zone", F.array_join(F.element_at(lut, F.col("zone")).cast("array<string>"), ",").alias("rgb"), "n")


@query("prj20_click_index", "SELECT s_suppkey AS id, CASE WHEN c BETWEEN 0 AND 99 AND r BETWEEN 0 AND 79 THEN r * 100 + c END AS idx FROM (SELECT s_suppkey, floor((s_suppkey * 37 % 4000 - 100) / 30.0::double)::bigint AS c, floor((2400 - s_suppkey * 91 % 3000) / 30.0::double)::bigint AS r FROM supplier)")
def prj20(spark, d):
    k = F.col("s_suppkey")
    return SNK.click_index(B.read(spark, d, "supplier").select(k.alias("id"), (k * 37 % 4000).cast("double").alias("x"), (k * 91 % 3000).cast("double").alias("y")), 100.0, 2400.0, 30.0, 100, 80)


@query("snk09_lookup_grid", grid_sql("SELECT row, base64(unhex(string_agg(lpad(to_hex(zone), 2, '0'), '' ORDER BY col))) AS codes, count(*) AS n FROM cells GROUP BY row"))
def snk09(spark, d):
    return SNK.packed_rows(cells(spark, d), "zone")


MODE = "(SELECT row, col, {v} FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, {v}) AS r FROM (SELECT row // 3 AS row, col // 3 AS col, {v}, count(*) AS n FROM cells GROUP BY ALL)) WHERE r = 1)"


@query("web01_lookup", grid_sql(f"SELECT row, col, zone, lu, CASE WHEN zone = 0 OR lu = 0 THEN 0 WHEN is_neutral THEN 4 WHEN is_strict THEN 1 WHEN is_cumulative THEN 2 ELSE 3 END AS agree FROM {MODE.format(v='zone')} JOIN {MODE.format(v='lu')} USING (row, col) LEFT JOIN xw USING (zone, lu)"))
def web01(spark, d):
    """The most frequent zone and the most frequent use of each 3 x 3 cells, and their agreement."""
    from ..operators.agreement import classify_cells
    from ..operators.grid import mode_downsample

    c = cells(spark, d)
    both = mode_downsample(c, "zone", 3).join(mode_downsample(c, "lu", 3), ["row", "col"])
    return classify_cells(both, domain.crosswalk(spark)).select("row", "col", "zone", "lu", "agree")


AGREE = f"ag AS (SELECT grp, {pct('s', 'denom')} AS strict_pct, {pct('c', 'denom')} AS cumulative_pct FROM (SELECT grp, {MEASURES} FROM (SELECT zone, lu, count(*) AS n FROM cells WHERE ext AND lu > 0 AND zone > 0 GROUP BY ALL) JOIN xw USING (zone, lu) GROUP BY grp))"


@query("web03_unpivot", grid_sql("SELECT grp, 'strict' AS measure, strict_pct AS pct FROM ag UNION ALL SELECT grp, 'cumulative', cumulative_pct FROM ag", AGREE))
def web03(spark, d):
    from ..operators.agreement import agreement

    a = agreement(cells(spark, d), domain.crosswalk(spark), "grp")
    return a.select("grp", F.expr("stack(2, 'strict', strict_pct, 'cumulative', cumulative_pct) AS (measure, pct)"))


@query("web04_sankey", grid_sql("SELECT grp AS source, lu AS target, greatest(sum(n) * 100 / 43560.0::double, 0.01::double)::double AS value FROM (SELECT zone, lu, count(*) AS n FROM cells WHERE ext GROUP BY ALL) JOIN (SELECT DISTINCT zone, grp FROM xw) USING (zone) GROUP BY ALL").replace("AS value", "AS v").replace("SELECT grp AS source, lu AS target, greatest", "SELECT source, target, round(v, 6) AS value FROM (SELECT grp AS source, lu AS target, greatest") + ")")
def web04(spark, d):
    c = cells(spark, d).where("ext").groupBy("zone", "lu").agg(F.count("*").alias("n"))
    groups = domain.crosswalk(spark).select("zone", "grp").distinct()
    return c.join(F.broadcast(groups), "zone").groupBy(F.col("grp").alias("source"), F.col("lu").alias("target")).agg(F.sum("n").alias("n")).select("source", "target", F.round(F.greatest(F.col("n").cast("double") * 100 / 43560.0, F.lit(0.01)), 6).alias("value"))


@query("snk10_results_join", grid_sql("SELECT grp, strict_pct, cumulative_pct, n FROM ag JOIN (SELECT grp, count(*) AS n FROM cells JOIN (SELECT DISTINCT zone, grp FROM xw) USING (zone) GROUP BY grp) USING (grp)", AGREE))
def snk10(spark, d):
    from ..operators.agreement import agreement

    x = domain.crosswalk(spark)
    n = cells(spark, d).join(F.broadcast(x.select("zone", "grp").distinct()), "zone").groupBy("grp").agg(F.count("*").alias("n"))
    return agreement(cells(spark, d), x, "grp").join(F.broadcast(n), "grp").select("grp", "strict_pct", "cumulative_pct", "n")


@query("snk10_results_bundle")
def snk10b(spark, d):
    """All six parts of the published results in one long table."""
    from ..operators import accuracy as AC
    from ..streaming import reports
    from . import statistics as ST
    from . import tabulation as TB

    m = ST.matrix(spark, d)
    accuracy = reports.accuracy_report(AC.overall(m), AC.by_class(m, B.design(spark, d)), AC.ratio_estimate(B.sample(spark, d), B.design(spark, d)))
    return reports.results_bundle(summary(spark, d), TB.ag05b(spark, d), TB.ag11(spark, d), ST.st05(spark, d), ST.st08(spark, d), accuracy)


def summary(spark, d):
    from ..operators.agreement import agreement, baseline
    from ..streaming import reports
    from . import statistics as ST

    x, c = domain.crosswalk(spark), cells(spark, d)
    return reports.stats_summary(agreement(c, x, "grp"), baseline(c, x), ST.st04(spark, d), ST.ag19(spark, d))


@query("snk05_stats_summary")
def snk05(spark, d):
    """Agreement, baseline, index, null model and intervals of each group; each part has SQL of its own."""
    return summary(spark, d)


USE_COLUMNS = [*domain.LAND_USES, "No parcel (ROW/water)"]


@query("snk01_crosstab_acres", grid_sql("SELECT zone_name, " + ", ".join(f'round(coalesce(sum(n) FILTER (lu = {(i + 1) % 12}), 0) * 100 / 43560.0::double, 6) AS "{u}"' for i, u in enumerate(USE_COLUMNS)) + """, round(sum(n) * 100 / 43560.0::double, 6) AS "Total" FROM (
 SELECT coalesce(district, 'Unclassified') AS zone_name, lu, n FROM ct LEFT JOIN (SELECT DISTINCT zone, district FROM xw) USING (zone) UNION ALL SELECT grp || ' total', lu, n FROM ct JOIN (SELECT DISTINCT zone, grp FROM xw) USING (zone) UNION ALL SELECT 'Total', lu, n FROM ct) GROUP BY zone_name""", "ct AS (SELECT zone, lu, count(*) AS n FROM cells WHERE ext GROUP BY ALL)"))
def snk01(spark, d):
    from ..streaming import reports

    acres, _ = reports.crosstab_tables(cells(spark, d), domain.crosswalk(spark))
    return acres.drop("level", "grp").select("zone_name", *[F.round(f"`{c}`", 6).alias(c) for c in [*USE_COLUMNS, "Total"]])


@query("snk13_fingerprints", "SELECT page_id, sha256(html) AS sha256, strlen(html)::bigint AS bytes FROM pages")
def snk13(spark, d):
    return B.read(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


@query("src12_tokens", "SELECT item_id, pos::int AS pos, token FROM (SELECT item_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS token, generate_subscripts(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1) - 1 AS pos FROM benchmark)")
def src12(spark, d):
    return SRC.tokens_of(B.read(spark, d, "benchmark"), "text", "item_id")


MD = "md AS (SELECT p_partkey AS id, x AS no, CASE x WHEN 0 THEN '| name | type |' WHEN 1 THEN '|---|:--:|' ELSE '| ' || p_name || ' | ' || p_type || ' |' END AS line FROM part CROSS JOIN (SELECT unnest(range(0, 3)) AS x))"


@query("src14_markdown", with_sql("SELECT id, no, array_to_string(list_transform(string_split(regexp_replace(line, '^\\||\\|$', '', 'g'), '|'), lambda s: trim(s)), '/') AS cells FROM md WHERE no <> 1", MD))
def src14(spark, d):
    p = B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("no"), t.alias("line")) for i, t in enumerate((F.lit("| name | type |"), F.lit("|---|:--:|"), F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("p_type"), F.lit(" |"))))])).alias("x")).select("id", "x.*")
    return SRC.markdown_rows(p, "line", "no", ["id"]).withColumn("cells", F.array_join("cells", "/"))


@query("src03_crosswalk", with_sql("SELECT zone, count(*) FILTER (is_strict) AS strict, count(*) FILTER (is_cumulative) AS cumulative, count(*) FILTER (is_neutral) AS neutral FROM xw GROUP BY zone", B.XW))
def src03(spark, d):
    n = lambda c: F.count(F.when(F.col(c), 1))
    return domain.crosswalk(spark).groupBy("zone").agg(n("is_strict").alias("strict"), n("is_cumulative").alias("cumulative"), n("is_neutral").alias("neutral"))


@query("src11_is_loaded", "SELECT (SELECT count(*) FROM orders) = (SELECT count(DISTINCT o_orderkey) FROM orders) AS loaded")
def src11(spark, d):
    o = B.read(spark, d, "orders")
    return spark.createDataFrame([(SRC.is_loaded(o, o.select("o_orderkey").distinct()),)], "loaded boolean")


@query("ag21_error_matrix", with_sql("SELECT pred, count(*) FILTER (ref = '0') AS r0, count(*) FILTER (ref = '1') AS r1, count(*) FILTER (ref = '2') AS r2, count(*) FILTER (ref = '3') AS r3, count(*) AS n FROM sample GROUP BY pred", B.SAMPLE_SQL))
def ag21(spark, d):
    from ..operators.accuracy import matrix_table

    return matrix_table(B.sample(spark, d), ["0", "1", "2", "3"], "r")


@query("tk03_detail_order", "SELECT p_brand AS detail, sum(p_size)::bigint AS acres, row_number() OVER (ORDER BY sum(p_size) DESC, p_brand)::int AS place FROM part GROUP BY p_brand")
def tk03(spark, d):
    g = B.read(spark, d, "part").groupBy(F.col("p_brand").alias("detail")).agg(F.sum("p_size").alias("acres"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("acres").desc(), "detail")))  # a row for each brand
