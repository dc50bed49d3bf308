"""Block ids and draws on a grid that is wider than that of the SQL's constants."""

from pyspark.sql import functions as F

from plotwise import domain
from plotwise.operators import inference
from plotwise.plans import bindings, statistics
from plotwise.plans.registry import QUERIES

SF = "/root/testdata/sf0.1"


def test_every_block_has_its_id_and_is_drawn(spark, monkeypatch):
    nx, ny = bindings.width(spark, SF)
    want = -(-nx // 20) * -(-ny // 20)
    places = bindings.cells(spark, SF).select(F.floor(F.col("row") / 20), F.floor(F.col("col") / 20)).distinct().count()
    ids = QUERIES["foc14_block_id"](spark, SF).agg(F.count("*"), F.max("block"), F.max("n")).first()
    assert places == want == 400
    assert tuple(ids) == (want, want - 1, 400)
    asked = []
    weights = inference.block_weights
    monkeypatch.setattr(inference, "block_weights", lambda s, reps, blocks, seed: asked.append(blocks) or weights(s, reps, blocks, seed))
    statistics.boot(spark, SF)
    assert asked == [want]


def test_blocks_of_ten_do_not_meet(spark):
    parts = QUERIES["ag13_block_fraction"](spark, SF).agg(F.max("area")).first()[0]
    assert parts == 100


def test_draws_are_not_sent_to_the_driver(spark):
    table = spark.createDataFrame([(b, 1 + b % 3, 1 + b % 5, 7) for b in range(50)], "block long, zone int, lu int, n long")
    boot = inference.block_bootstrap(table, domain.crosswalk(spark), inference.block_weights(spark, 20, 50, 0))
    plan = boot._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "block" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
    assert boot.count() == 20


def test_patches_of_a_tall_grid(spark, monkeypatch):
    monkeypatch.setattr(bindings, "width", lambda *_: (16, 2100))
    got = {r.row: r.street for r in QUERIES["flt06_patch_filter"](spark, "/root/testdata/sf0.001").collect()}
    assert got[2080] == 0.0 and max(got) == 2080
