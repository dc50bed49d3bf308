"""The pipeline, stage by stage, against plain versions."""

from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from plotwise.llm import packing, quality_rules

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = {i for i, _, _, k in brute.line_verdicts(rows, quality_rules.QualityRules()) if k}
    one = stages["quality_rules"](spark, docs, SF).cache()
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == good

    pairs = [(r.doc_id, r.text) for r in one.collect()]
    two = stages["near_dedup"](spark, one, SF).cache()
    assert two.columns == columns
    assert {r.doc_id for r in two.collect()} == {c for _, c in brute.near_classes(pairs)}

    left = [(r.doc_id, r.text) for r in two.collect()]
    three = stages["substring_dedup"](spark, two, SF).cache()
    assert three.columns == columns
    want = {i: (t if gone == 0 else " ".join(kept)) for (i, t), (n, gone, kept) in zip(left, brute.kept_words([t for _, t in left]), strict=True) if gone < n}
    assert {r.doc_id: r.text for r in three.collect()} == want
    assert three.where(F.col("n_chars") != F.char_length("text")).count() == 0

    four = stages["mixing"](spark, three, SF).cache()
    assert four.columns == columns
    assert {r.doc_id for r in four.collect()} <= set(want)

    five = stages["packing"](spark, four, SF).collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == Counter(r.doc_id for r in four.collect())
    per = Counter()
    for r in five:
        per[r.sequence_id] += r.length
    assert max(per.values()) <= packing.Packing().size

    assert corpus_pipeline.run(spark, SF).count() == len(five)


def test_stages_on_odd_and_empty_tables(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(5_000))
    same = " ".join(f"token{i}" for i in range(80))
    rows = [(None, same + " a", "en", "s", 1), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (4, same, "en", "s", 9), (4, same, "en", "s", 9), (5, same, "fr", None, 9), (7, long, "en", "s", len(long)), (8, long + "\n" + same, None, "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "__key", "__digest", "__id", "__source", "bucket", "kept", "host", "n_words", "length", "lane"):
        docs = docs.withColumn(c, F.lit("clash"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == {None: 1, 4: 2, 5: 1, 7: 1, 8: 1}
    single = stages["near_dedup"](spark, docs, SF)
    assert single.columns == docs.columns
    # the near copies go with the copies, empty and null texts are one class
    assert Counter(r.doc_id for r in single.collect()) == {c: 1 for c in {c for _, c in brute.near_classes([(r.doc_id, r.text) for r in docs.collect()])}}
    left = stages["substring_dedup"](spark, docs, SF)
    want = {i for (i, t, *_), (n, gone, _) in zip(rows, brute.kept_words([r[1] for r in rows]), strict=True) if gone < n}
    assert {r.doc_id for r in left.collect()} == want
    assert {r["key"] for r in left.collect()} <= {"clash"}
    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in rows}
    assert stages["packing"](spark, docs, SF).where("piece = 0").count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
