"""The operators against plain versions, and on awkward tables."""

import math
import pathlib
import random
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotwise.llm import chat, html_text, kernel, mixing, near_dedup, packing, quality_model, quality_rules, shared, spotsigs, substrings, suffix_tree, tokens

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties and repeated rows, and columns with clashing names."""
    same = " ".join(f"token{i}" for i in range(80))
    rows = [
        (None, "a b c d e f g", "en", "s", 1), (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", "de", None, 4), (4, same, "en", "s", 9),
        (4, same, "en", "s", 9), (4, same + " more", "en", "s", 9), (5, same, "fr", "t", 9), (6, "é ü 中 😀", None, "t", 7), (7, LONG, "en", "s", len(LONG)), (8, "The and", "en", "s", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "digest", "class_id", "bucket", "rid", "host", "n_words", "batch", "shard", "label", "__copy", "kept", "length", "lane"):
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# --- kernel ------------------------------------------------------------------------------------------------------------------


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\ré中😀\xa0", max_size=30)), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    got = []
    for block in kernel.blocks(pa.array(texts, pa.string()), 16):
        w = kernel.words(block)
        for i in range(block.hi - block.lo):
            got.append([block.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)])
    assert got == [brute.words(t) for t in texts]


def test_hashes_do_not_depend_on_the_place():
    a, b = "one two three four", "zero one two three"
    hashes = {}
    for t in (a, b):
        block = next(kernel.blocks(pa.array([t])))
        h = kernel.word_hashes(block, kernel.words(block))
        for w, x in zip(t.split(), h.tolist(), strict=True):
            assert hashes.setdefault(w, x) == x
    assert len(set(hashes.values())) == 5


# --- 1 -----------------------------------------------------------------------------------------------------------------------


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = random.Random(3)
    errors = []
    for trial in range(60):
        a = Counter(rng.choices(range(60), k=200))
        b = Counter(dict(a)) + Counter(rng.choices(range(90), k=rng.randrange(10, 200)))
        for x in rng.sample(sorted(b), 10):
            b[x] = max(1, b[x] // 2)
        want = sum(min(a[x], b[x]) for x in a | b) / sum(max(a[x], b[x]) for x in a | b)
        keys = [np.array(sorted(c)) for c in (a, b)]
        h = kernel.mix(np.concatenate(keys).astype(np.uint64) + np.uint64(1000 * trial))
        n = np.array([c[x] for c, k in zip((a, b), keys, strict=True) for x in k.tolist()])
        sig = near_dedup.bag_minhash(h, n, np.repeat([0, 1], [len(k) for k in keys]), 2, 1024)
        errors.append((sig[0] == sig[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.007
    assert np.abs(errors).max() < 0.08


@pytest.mark.parametrize("p", [near_dedup.NearDedup(), near_dedup.NearDedup(block=3)])
def test_near_duplicate_classes(docs, pairs, p):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs, p).collect()}
    assert got == dict(brute.near_classes(pairs))


def test_near_duplicates_in_one_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    # around the threshold: most pairs of these share buckets and are no links
    rows += [(1000 + i, " ".join(f"v{j}" if rng.random() > 0.025 else f"z{rng.random()}" for j in range(150))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.near_classes(rows))
    assert len({c for i, c in want if i >= 1000}) > 10
    for p in (near_dedup.NearDedup(), near_dedup.NearDedup(block=8, block_bytes=4000)):
        assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicate_classes(df, p).collect()) == want


def test_near_duplicates_odd(odd, empty):
    got = near_dedup.near_duplicate_classes(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == sorted(brute.near_classes(rows), key=repr)
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # null, null and empty texts are one class, the copies and the near copy another
    assert kept.count() == len({brute.sha(t or "") for _, t in rows}) - 1
    assert near_dedup.near_duplicate_classes(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------------------------------


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_draws_by_inversion(docs):
    import hashlib

    p = mixing.Mixture()
    rates = {r.source: (r.rate, r.n_chunks) for r in mixing.rates(docs, p).collect()}
    want = Counter()
    for r in docs.collect():
        key = f"{r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}"
        rate, chunks = rates[r.source]
        for j in range(1, chunks + 1):
            u = int(hashlib.md5(f"{key}:{p.seed}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            want[r.doc_id] += poisson(rate / chunks, u)
    got = mixing.mix_sources(docs, p).select("doc_id", "__copy", "__place").collect()
    assert Counter(r.doc_id for r in got) == +want
    assert [r["__place"] for r in got] == sorted(r["__place"] for r in got)


def test_mixing_meets_its_weights(spark):
    rows = [(i, "x" * 10, "a" if i % 10 else "b") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mixing.mix_sources(df, mixing.Mixture(weights=(("a", 1.0), ("b", 1.0)))).groupBy("source").count().collect()}
    assert abs(n["a"] - 10_000) < 400
    assert abs(n["b"] - 10_000) < 400  # a rate of 5
    assert mixing.mix_sources(df, mixing.Mixture(weights=(("a", 1.0),))).where("source = 'b'").count() == 0


def test_mixing_odd(odd, empty):
    clash = odd.withColumns({c: F.lit("x") for c in ("__key", "__source", "__chunks", "__table", "__0", "___KEY")})
    mixed = mixing.mix_sources(clash)
    assert [c for c in mixed.columns if c not in ("__copy", "__place")] == [c for c in clash.columns if c != "__copy"]
    assert mixed.count() == mixing.mix_sources(odd).count()
    assert mixing.mix_sources(odd).count() >= 0
    assert mixing.mix_sources(empty).count() == 0
    some = mixing.mix_sources(odd, mixing.Mixture(epochs=30.0))
    assert some.where("source IS NULL").count() > 0


# --- 3 -----------------------------------------------------------------------------------------------------------------------


def test_chat_is_read_back(spark):
    turns = [(1, 0, "user", "</s>[INST] a & b &amp; <|end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "x\ny<|turn|>"), (2, 1, "b\nad&nl;", "&lt;[&lsqb;"), (None, None, None, "t"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    parts = df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    for c in (1, 2, None, 3):
        mine = [t for t in turns if t[0] == c]
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == brute.sha("".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine))
        loss = "".join(x or "" for _, _, r, x in mine if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))
    assert chat.digests(parts.limit(0)).count() == 0


def test_chat_odd(spark):
    long = "[INST] & <|end|> " * 20_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("formatted", "turns", "body", "loss", "segments", "n_turns")})
    got = {r.conv_id: r for r in chat.digests(df.withColumn("parts", chat.text_part(F.col("text"))).select("conv_id", "turn", "role", "parts", "formatted", "turns", "body", "loss", "segments", "n_turns")).collect()}
    for c in (1, 2):
        mine = [t for t in turns if t[0] == c]
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == brute.sha("".join(f"{r}\n{x}\n" for _, _, r, x in mine))
        assert got[c].loss_sha256 == brute.sha("".join(x for _, _, r, x in mine if r == "assistant"))


def test_chat_attachments(spark):
    part = lambda kind, **k: tuple(k.get(n) if n != "kind" else kind for n in ("kind", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [(1, 0, "user", [part("text", text="see "), part("image", ref="u1", width=57, height=28), part("audio", ref="u2", seconds=2.0)]), (1, 1, "assistant", [part("document", ref="u3", pages=2), part("odd", text="ok")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|turn|>user\nsee <|image|><|audio|><|end|><|turn|>assistant\n<|document|>ok<|end|>"
    assert [(a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "u1", 3), (1, "audio", "u2", 50), (2, "document", "u3", 2048)]
    assert (r.placeholders, r.expanded_tokens) == (3, 2101)


# --- 4 -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    return t, tokens.Encoder(packing.vocabulary(), memory=500)


@given(st.lists(st.text(alphabet="ab'sreveltmd  \n\t12!?.éß中٥\xa0 ́😀<|>_", max_size=40), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(bpe, texts):
    library, own = bpe
    for block in kernel.blocks(pa.array(texts), 64):
        ids, bounds = own.encode(block)
        for i in range(block.hi - block.lo):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(texts[block.lo + i], add_special_tokens=False).ids


def test_packing(spark, docs, odd, empty, bpe):
    named = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>" + LONG), (3, "plain <|endoftext|")], "doc_id long, text string")
    assert 50256 in bpe[0].encode("a <|endoftext|> b", add_special_tokens=False).ids
    for df in (docs, odd, named):
        rows = packing.pack_documents(df).collect()
        want = Counter()
        for r in df.collect():
            ids = [*bpe[0].encode(r.text or "", add_special_tokens=False).ids, 2]
            n = -(-len(ids) // 1024)
            head = len(ids) - (n - 1) * 1024
            for k in range(n):
                a, b = (0, head) if k == 0 else (head + (k - 1) * 1024, head + k * 1024)
                want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(r.length for r in rows)
        assert len(bins) <= total / 1024 * 1.05 + 2
    assert packing.pack_documents(empty).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece(counts):
    placed = Counter()
    for times, lengths in packing.plan(counts, 64):
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            placed[n] += times
    assert placed == Counter(counts)


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 12), max_size=10))
@settings(max_examples=150, deadline=None)
def test_plan_is_that_of_one_bin_at_a_time(counts):
    bins = [b for times, b in packing.plan(counts, 32) for _ in range(times)]
    assert bins == brute.best_two_fit(counts, 32)


def test_plan_takes_two_for_one():
    # 60, then 3 greedily; 2 + 2 fill the gap of 4 exactly
    assert packing.plan({60: 1, 3: 1, 2: 2}, 64)[0] == (1, [60, 2, 2])


# --- 5 -----------------------------------------------------------------------------------------------------------------------


def test_kneser_ney_adds_up_to_one(spark):
    texts = ["a b a c a b", "b a c c a", "a b b a d", "c a b a", "a a c d d d"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    scorer = quality_model.Scorer(quality_model.tables(quality_model.count_grams(df, 3), 3))
    names = ["a", "b", "c", "d"]
    block = next(kernel.blocks(pa.array([" ".join(names)])))
    h = dict(zip(names, kernel.word_hashes(block, kernel.words(block)), strict=True))
    for context in ([quality_model.START] * 2, [quality_model.START, h["a"]], [h["a"], h["b"]], [h["d"], h["d"]], [h["b"], h["c"]]):
        total = sum(10 ** float(scorer.log10(np.array([*context, w], dtype=np.uint64), np.array([2]))[0]) for w in [*h.values(), np.uint64(quality_model.END)])
        unknown = 10 ** float(scorer.log10(np.array([*context, 12345], dtype=np.uint64), np.array([2]))[0])
        assert abs(total + unknown - 1) < 1e-5


def test_perplexities_are_those_of_the_plain_model(spark, docs, pairs):
    taught = [t for _, t in pairs[:60]]
    plain = brute.kneser_ney(taught)
    sample = spark.createDataFrame([(t,) for t in taught], "text string").repartition(3)
    scorer = spark.sparkContext.broadcast(quality_model.Scorer(quality_model.tables(quality_model.count_grams(sample, 3), 3)))
    got = {r.doc_id: (r.n_tokens, r.log10_ppl) for r in quality_model.perplexities(docs, scorer, 3, ["doc_id"]).collect()}
    for i, t in pairs:
        want = plain(t)
        assert got[i][0] == len(want)
        assert got[i][1] == pytest.approx(-sum(want) / len(want), abs=1e-9)


def test_classifier_tells_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r.kept for r in quality_model.classify(docs, quality_model.trusted_ids(labels)).collect()}
    marks = labels.collect()
    good = [got[r.doc_id] for r in marks if r.quality == 1]
    bad = [got[r.doc_id] for r in marks if r.quality == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.3


def test_all_trusted_rows_are_taught(spark):
    docs = spark.range(5300).select(F.col("id").alias("doc_id"), F.format_string("w%d w%d w%d", "id", "id", "id").alias("text"), F.lit("en").alias("lang"))
    taught = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(100)) < 80
    got = quality_model.classify(docs, docs.select("doc_id")).groupBy(taught.alias("taught")).agg(F.count("*").alias("n"), F.min("log10_ppl").alias("lo"), F.max("log10_ppl").alias("hi"))
    got = {r.taught: r for r in got.collect()}
    assert got[True].n > 4000
    assert got[True].hi < got[False].lo


def test_a_model_in_shards_scores_as_one_that_is_given(spark, docs, odd, empty):
    df = docs.select("doc_id", "text", F.lit("en").alias("lang")).unionByName(odd.select(F.col("doc_id") + 100000, "text", "lang").toDF("doc_id", "text", "lang"))
    ids = docs.select("doc_id").where("doc_id % 3 = 0")
    small = dict(given=0, shard_bytes=1 << 10, batch_bytes=1 << 12)
    rows = lambda d, i, **more: sorted(((r.doc_id, r.n_tokens, round(r.log10_ppl, 9), r.threshold, r.kept) for r in quality_model.classify(d, i, quality_model.QualityModel(**more)).collect()), key=repr)
    assert rows(df, ids, **small) == rows(df, ids)
    assert rows(df, ids.limit(0), given=-1) == rows(df, ids.limit(0))
    assert rows(empty, ids, **small) == []


def test_shards_with_heavy_and_unknown_words(spark):
    rng = random.Random(3)
    texts = [" ".join(x for _ in range(30) for x in ("the", f"w{rng.randrange(40)}")) + (f" only{i} only{i}x" if i % 4 else "") for i in range(80)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    ids = df.select("doc_id").where("doc_id % 2 = 0")
    assert {hex(x) for x in quality_model.heavy_words(df.select("text"), 2)} == {hex(x) for x in (lambda b: kernel.word_hashes(b, kernel.words(b)))(next(kernel.blocks(pa.array(["the"]))))}
    rows = lambda **more: sorted((r.doc_id, r.n_tokens, round(r.log10_ppl, 9), r.threshold, r.kept) for r in quality_model.classify(df, ids, quality_model.QualityModel(**more)).collect())
    assert rows(given=0, rounds=2) == rows()


def test_counted_grams_pack_well():
    rng = np.random.default_rng(2)
    words = kernel.mix((rng.zipf(1.3, 200_000) % 20_000 + 100_000).astype(np.uint64))
    vocabulary, ids, which, n = quality_model.distinct_grams(words, np.arange(2, len(words)), 3)
    data = quality_model.packed_grams(vocabulary, ids, n)
    columns, m = quality_model.unpacked_grams(data)
    assert (m == n).all() and all((c[which] == words[2 - back : len(words) - back]).all() for c, back in zip(columns, (1, 0, 2), strict=True))
    assert len(data) < 10 * len(n)  # six keys and a count are 56 bytes


def test_rounds_leave_the_model_where_it_is(spark, docs):
    p = quality_model.QualityModel(given=-1, shard_bytes=1 << 14, batch_bytes=1 << 14)
    texts = docs.select("text")
    model = quality_model.sharded(texts, texts, p)
    plan = quality_model.asked_perplexities(docs, model, ["doc_id"], p)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2  # requests, then answers
    model.release(spark)
    assert not spark.catalog.tableExists(model.table)


def test_small_tables_are_few_files(spark):
    most = 2 * spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 4 * most)
    assert len(shared.stored(quality_model.in_few(many), "few").inputFiles()) == most
    assert quality_model.in_few(many, most + 1).rdd.getNumPartitions() == most + 1


def test_numbers_take_the_bytes_that_they_have():
    columns = [np.arange(1000) % 200, np.zeros(1000, dtype=np.int64), np.arange(1000) << 7, np.array([-1, 5]), np.array([1 << 63], dtype=np.uint64), np.zeros(0, dtype=np.uint64)]
    data = quality_model.squeezed(columns)
    got = quality_model.unsqueezed(data)
    assert [x.tolist() for x in got] == [x.astype(np.uint64).tolist() for x in columns]
    assert int.from_bytes(data[:8], "little") < 5000  # 8 bytes each are 24 kB


@pytest.mark.parametrize("n_words", [20, 1 << 17])
def test_packed_rows_merge(n_words):
    rng = np.random.default_rng(4)
    words = np.sort(kernel.mix(np.arange(n_words, dtype=np.uint64)))
    parts, want = [], Counter()
    for _ in range(3):
        rows = np.unique(rng.integers(0, 9, (200, 4)) * (n_words // 9), axis=0)
        n = rng.integers(1, 5, len(rows))
        want.update({tuple(words[r].tolist()): int(c) for r, c in zip(rows, n, strict=True)})
        parts.append(quality_model.unpacked_numbers(quality_model.packed_grams(words, list(rows.T), n)))
    vocabulary, columns, n = quality_model.merged([*parts, (words, [np.zeros(0, dtype=np.int64)] * 4, np.zeros(0, dtype=np.int64))])
    rows = np.stack(columns, axis=1)
    assert rows.tolist() == sorted(rows.tolist()) and dict(zip(map(tuple, vocabulary[rows].tolist()), n.tolist(), strict=True)) == want


@pytest.mark.parametrize("order", [2, 3, 4])
def test_shard_tells_counts(order):
    rng = np.random.default_rng(order)
    grams = Counter(map(tuple, np.minimum(rng.zipf(1.3, (400, order)), 9).tolist()))  # the word before the last, the last, those before
    words = np.sort(kernel.mix(np.arange(12, dtype=np.uint64)))
    rows = np.array(sorted(grams))
    columns = list(rows.T.astype(np.int64))
    known = quality_model.Known(*quality_model.unpacked_numbers(quality_model.packed_grams(words, columns, np.array([grams[tuple(r)] for r in rows.tolist()]))))
    asked = [tuple(r) for r in rows[::7].tolist()] + [(1, 1, 11, 11)[:order], (11,) * order, (9, 10, 1, 1)[:order]]
    got = known.tell(words, list(np.array(asked).T))
    none = quality_model.Known(words[:0], [np.zeros(0, dtype=np.int64)] * order, np.zeros(0, dtype=np.int64))
    assert not np.any(none.tell(words, list(np.array(asked).T)))
    for k in range(order, 1, -1):
        for i, ask in enumerate(asked):
            after = [c for g, c in grams.items() if g[:1] + g[2:k] == ask[:1] + ask[2:k]]
            want = [grams.get(ask[:k], 0), sum(after), after.count(1), after.count(2), sum(c > 2 for c in after)]
            assert [int(x[i]) for x in got[5 * (k - 2) : 5 * (k - 1)]] == want
        grams = Counter(g[: k - 1] for g in grams)


def test_worker_gives_memory_back():
    held = lambda: int(pathlib.Path("/proc/self/statm").read_text().split()[1]) * 4096

    def each(_):
        return [np.ones(4096) for _ in range(8000)][-1]  # 260 MB in small pieces, of which the last stays

    before = held()
    last = shared.lean(each)(None)
    assert len(last) and held() - before < 60e6


def test_requests_and_replies_pack_well():
    rng = np.random.default_rng(1)
    keys, n = np.sort(rng.integers(0, 1 << 58, 5000, dtype=np.uint64)), rng.integers(0, 9, 5000, dtype=np.uint64)  # a shard's keys; counts
    data = kernel.planes(np.diff(keys, prepend=np.uint64(0))) + kernel.planes(n)
    assert (np.cumsum(kernel.unplaned(data, 5000, 0)) == keys).all()
    assert (kernel.unplaned(data, 5000, 1) == n).all()
    assert len(kernel.unplaned(kernel.planes(keys[:0]), 0, 0)) == 0
    plain, packed = (len(pa.compress(x, "lz4_raw", asbytes=True)) for x in (keys.tobytes() + n.tobytes(), data))
    assert packed < 0.8 * plain


def test_classifier_odd(spark, odd, empty):
    ids = spark.createDataFrame([(4,), (5,), (7,), (None,), (4,)], "doc_id long")
    assert quality_model.classify(odd, ids).count() == odd.count()
    none = quality_model.classify(odd, ids.limit(0)).collect()
    assert all(r.kept and r.threshold is None for r in none)
    assert quality_model.classify(empty, ids).count() == 0


# --- 6 -----------------------------------------------------------------------------------------------------------------------


def test_repeated_passages(spark, docs, pairs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(docs.select("doc_id", "text")).collect()}
    for (i, _), (n, gone, kept) in zip(pairs, brute.kept_words([t for _, t in pairs]), strict=True):
        assert got[i] == (n, gone, " ".join(kept))


def test_repeated_passages_small_windows(spark):
    rng = random.Random(1)
    p = substrings.Repeats(words=6, seed=3, batch_bytes=256)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(df, p).collect()}
    for i, (n, gone, kept) in enumerate(brute.kept_words(texts, 6)):
        assert got[i] == (n, gone, " ".join(kept))


def test_repeated_passages_odd(odd, empty):
    rows = odd.collect()
    got = substrings.remove_repeats(odd)
    want = [(r.doc_id, n, gone, " ".join(kept)) for r, (n, gone, kept) in zip(rows, brute.kept_words([r.text for r in rows]), strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {r["key"] for r in got.collect()} == {"clash"}
    whole = {r.doc_id: r.text for r in substrings.remove_repeats(odd, untouched=True).where("n_removed = 0").collect()}
    assert whole[3] == " \n\t " and whole[7] == LONG
    assert substrings.remove_repeats(empty).count() == 0


# --- 7 -----------------------------------------------------------------------------------------------------------------------


def scored(df):
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return suffix_tree.score_texts(df, train, suffix_tree.SuffixTree(heavy=0.01, batch_bytes=1 << 16))


def test_scores(docs, pairs, odd, empty):
    for df, rows in ((docs, pairs), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored(df).collect()), key=repr)
        want = sorted(((*x[:5], round(x[5], 6)) for x in brute.base_scores(rows)), key=repr)
        assert got == want
    assert scored(empty).count() == 0
    nobody = suffix_tree.score_texts(odd, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in nobody)


def test_scores_against_a_plain_tree(spark, docs, pairs):
    p = suffix_tree.SuffixTree(depth=3, least=1e-4, batch_bytes=1 << 16)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    told = [(100 + i, f"alpha{i % 5} beta{i % 5} the end of gamma{i % 3} delta{i % 7} the {'x' * 400}") for i in range(40)]
    for df, rows in ((spark.createDataFrame(told, "doc_id long, text string"), told), (docs, pairs)):
        want = brute.tree_scores(rows, p)
        got = {r.doc_id: r.score for r in suffix_tree.score_texts(df, held, p).collect()}
        assert got.keys() == want.keys()
        for i, (score, _) in want.items():
            assert abs(got[i] - score) <= 1e-6 * abs(score) + 1e-6
    assert sum(n for _, n in brute.tree_scores(told, p).values()) >= 40  # states of rare words are used


def test_common_words_are_contexts_too(spark, pairs, odd, empty):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    told = [(9000 + i, f"start{i % 2} alpha{i % 5} the end of gamma{i % 3} the end of all " + "stop go " * 30) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rows, more in ((told, {}), (told + pairs, dict(shard_bytes=1 << 10)), (pairs, dict(heavy=1e-3)), (told, dict(few=200))):
        p = suffix_tree.SuffixTree(common=True, depth=3, least=1e-4, batch_bytes=1 << 16, **more)
        want = brute.tree_scores(rows, p)
        for r in suffix_tree.score_texts(frame(rows), held, p).collect():
            assert abs(r.score - want[r.doc_id][0]) <= 1e-6 * abs(r.score) + 1e-6
    whole = suffix_tree.SuffixTree(common=True)
    rare, both = ({r.doc_id: r.score for r in suffix_tree.score_texts(frame(told), held, p).collect()} for p in (suffix_tree.SuffixTree(), whole))
    assert all(both[i] > rare[i] + 5 for i in rare)
    assert suffix_tree.score_texts(odd, held, whole).count() == odd.count()
    assert suffix_tree.score_texts(empty, held, whole).count() == 0
    assert all(r.base_score == 0 for r in suffix_tree.score_texts(odd, F.lit(False), whole).collect())


def test_places_that_wait_do_not_stay_on_disk(spark):
    from plotwise.operators.graph import shared_folder

    pick = np.random.default_rng(7).zipf(1.3, (120, 400)) % 500
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(pick.tolist())], "doc_id long, text string").repartition(3)
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:").replace("//", "/"))
    size = lambda: sum(x.stat().st_size for x in folder.rglob("*") if x.is_file())
    rows = lambda **more: {r.doc_id: r.score for r in suffix_tree.score_texts(df, F.col("doc_id") % 7 != 2, suffix_tree.SuffixTree(common=True, **more)).collect()}
    before = size()
    want = rows()
    assert size() - before < 60_000
    got = rows(batch_bytes=1 << 14)  # in rounds
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1e-6 * abs(want[i]) for i in want)


def test_counting_holds_little(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 1 << 20)) for _ in range(12)]  # nearly all grams differ

    class Texts:
        def mapInArrow(self, run, schema):
            self.run = run
            return spark.createDataFrame([], schema)

    given, p = Texts(), suffix_tree.SuffixTree()
    suffix_tree.counts(given, p)
    got = [0, 0]
    tracemalloc.start()
    for batch in given.run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        got[batch.column(0)[0].as_py()] += int(batch.column(2).to_numpy().sum())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [sum(len(t.split()) + 1 for t in texts), sum(sum(len(w) + 1 for w in t.split()) + 1 for t in texts)]
    assert most < 400e6  # 792 MB when 8 million grams waited


def test_scores_write_few_files(spark, docs, monkeypatch):
    written, stored = {}, suffix_tree.stored

    def counted(df, name):
        out = stored(df, name)
        written[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(suffix_tree, "stored", counted)
    most = 2 * spark.sparkContext.defaultParallelism
    own = {"spark.sql.shuffle.partitions": str(2 * most), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        suffix_tree.score_texts(docs.limit(20), F.col("doc_id") % 7 != 2, suffix_tree.SuffixTree(common=True))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"counts", "states", "common", "levels", "hashed", "scores"} == set(written) and max(written.values()) <= most


def test_rare_contexts_grow_with_the_corpus(spark):
    def states(n):
        texts = [(i, " ".join(f"w{i % n}x{k} w{i % n}y{k}" for k in range(5))) for i in range(5 * n)]
        df = spark.createDataFrame(texts, "doc_id long, text string").select("text")
        p = suffix_tree.SuffixTree()
        words = suffix_tree.counts(df, p).where("kind = 0").select(F.col("key").alias("word"), "n")
        total = words.agg(F.sum("n")).first()[0]
        keys = np.sort(np.array([r.word for r in words.collect()], dtype=np.int64).view(np.uint64))
        often = spark.sparkContext.broadcast(suffix_tree.Often(keys, np.full(len(keys), 5), p.few))
        return suffix_tree.states(suffix_tree.pairs(df, often, p), words, total, p).select("context").distinct().count()

    few, many = states(40), states(400)
    assert few > 0 and many >= 9 * few


def test_tree_is_a_distribution_and_learns(spark):
    text = "the cat and the dog and the cow " * 300
    df = spark.createDataFrame([(1, text), (3, text), (4, "zzqx " * 1600)], "doc_id long, text string")
    p = suffix_tree.SuffixTree(depth=3, least=1e-4, gain=1.0)
    tree = suffix_tree.grown(suffix_tree.counts(df.select("text"), p).where("kind = 1").select("key", "n"), p)
    for context in (b"\n\n\n", b"the", b"e c", b"q x", b"???"):
        base = int.from_bytes(context, "big") << 8
        chance = 10 ** tree.log10(np.arange(256, dtype=np.int64) + base)
        assert abs(chance.sum() - 1) < 1e-9
    assert any(len(k) for k in tree.keep[2:])  # long contexts are kept where they tell something
    r = {x.doc_id: x.score / x.n_tokens for x in suffix_tree.score_texts(df, F.col("doc_id") != 4, p).collect()}
    assert r[1] > r[4] + 2


def test_score_beats_counts_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    r = suffix_tree.score_texts(df, train).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_bytes_score_by_rows_as_by_sorted_grams():
    p = suffix_tree.SuffixTree(gain=0.1)
    block = next(kernel.blocks(pa.array(["the cat and the hat, the bat", "", "a cat that sat; the hat", "é the"])))
    other = next(kernel.blocks(pa.array(["the zebra\U0001f600 and the cat", "", "hat"])))
    data, at, _ = suffix_tree.spelled(block, kernel.words(block), p.depth)
    keys, n = np.unique(suffix_tree.grams(data, at, p.depth + 1), return_counts=True)
    levels = []
    for d in range(p.depth + 1):
        k, which = np.unique(keys & (1 << 8 * (d + 1)) - 1, return_inverse=True)
        levels.append((k, np.bincount(which, n).astype(np.int64)))
    none = [(keys[:0], n[:0])] * (p.depth + 1)
    walked = set()
    for cells in (0, *range(100, 2000, 100), 1 << 20):
        for tree in (suffix_tree.Tree(levels, p, cells), suffix_tree.Tree(none, p, cells)):
            walked.add(tree.walked)
            for b in (block, other):
                data, at, _ = suffix_tree.spelled(b, kernel.words(b), p.depth)
                assert (tree.scores(data, at, 7) == tree.log10(suffix_tree.grams(data, at, p.depth + 1))).all()
    assert len(walked) > 2


def test_words_are_found_by_ranges():
    for n in (0, 1, 2, 3000):
        keys = np.sort(kernel.mix(np.arange(n, dtype=np.uint64)))
        often = suffix_tree.Often(keys, np.ones(n, dtype=np.int64), 1)
        token = np.concatenate([keys, kernel.mix(np.arange(5000, 9000, dtype=np.uint64)), np.array([0, (1 << 64) - 1], dtype=np.uint64)])
        place, here, _ = often.find(token)
        assert (here == np.isin(token, keys)).all() and (keys[place[here]] == token[here]).all()
        assert not n or (often.place(token) == np.minimum(np.searchsorted(keys, token), n - 1)).all()


# --- 8 -----------------------------------------------------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice"><p>Cookies</p></div><main><article><h1>Head &amp; &lt;x&gt;</h1><p>One <b>bold</b>&nbsp;\n text<script>var a="</p>";</script><p>Two<ul><li>a<li>b</ul>
<aside>Side</aside><form><p>Form</p></form><section id="comments"><article class="comment"><p>Reader</p></article></section></article></main><!-- <p>no</p> --><footer>Foot</footer>"""


def test_page_lines():
    assert [x for x, k in html_text.lines_of(PAGE) if k == html_text.ARTICLE] == ["Head & <x>", "One bold text", "Two", "a", "b"]
    assert html_text.lines_of("") == []
    assert html_text.lines_of("a < b & c <") == [("a < b & c <", html_text.LOOSE)]


@given(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=9))
@settings(max_examples=200, deadline=None)
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    shared = html_text.shared_lines(a, b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    rest = iter(b)
    assert sum(shared) == best[-1][-1]
    assert all(x in rest for x, s in zip(a, shared, strict=True) if s)


def test_long_and_deep_pages():
    import time
    import tracemalloc

    began = time.time()
    n = 40_000
    a, b = [i % 1009 for i in range(n)], [i * 7 % 1009 for i in range(n)]
    tracemalloc.start()
    shared = html_text.shared_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # a row for each line would take 200 MB
    tracemalloc.stop()
    assert 0 < sum(shared) < n
    assert len(html_text.lines_of("<div>x" * 30_000)) == 30_000
    assert len(html_text.lines_of("</b></i>" * 30_000 + "<div><span>y" * 30_000)) == 30_000
    assert time.time() - began < 60


def test_copies_that_differ_in_a_line_keep_their_text(spark):
    body = "".join(f"<p>paragraph {i} of a long text that both pages have</p>" for i in range(20))
    page = lambda extra: f"<html><body>{body}<div>{extra}</div></body></html>"
    df = spark.createDataFrame([(1, "http://x.com/a/1", page("today")), (2, "http://x.com/a/2", page("yesterday"))], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(df).collect()}
    assert len(got[1]) == len(got[2]) == 21
    # the template goes where only the alignment can tell it, and the article stays where the neighbour has a line of it
    named = lambda x: f"<html><body><div>Shop</div><article><p>All wares</p><p>{x}</p></article></body></html>"
    plain = lambda x: f"<html><body><div>Shop</div><div>All wares</div><p>{x}</p></body></html>"
    df = spark.createDataFrame([(1, "http://x.com/1", named("one")), (2, "http://x.com/2", named("two")), (3, "http://y.com/1", plain("three and more")), (4, "http://y.com/2", plain("four and more"))], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_shared) for r in html_text.extract(df).collect()}
    assert got == {1: ("All wares\none", 2), 2: ("All wares\ntwo", 2), 3: ("three and more", 2), 4: ("four and more", 2)}


def test_nearest_pages(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a.com", "b.com", "c.com", f"one{i}.com"]), "/" + "/".join(rng.choice(["x", "xy", "news", "n"]) for _ in range(rng.randrange(4)))) for i in range(120)]
    df = spark.createDataFrame(rows, "rid long, host string, path string")
    for n in (1, 7):
        assert {r.rid: r.other for r in html_text.nearest(df, html_text.Pages(ranges=n)).collect()} == brute.nearest_pages(rows)


def test_neighbours_delete_the_template(spark):
    page = lambda body: f"<html><body><div>Shop name</div><div>All wares</div>{body}<div>Call us</div></body></html>"
    rows = [(1, "http://x.com/a/1", page("<p>first</p>")), (2, "http://x.com/a/2", page("<p>second</p>")), (3, "http://y.com/", page("<p>alone</p>")), (4, "http://x.com/b/9?q", page("<p>third</p>")), (None, None, None), (5, "http://z.com/1", PAGE), (6, "http://z.com/1", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))
    for n in (1, 5):
        got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df, html_text.Pages(ranges=n)).collect()}
        assert got[1] == ("first", 5) and got[2] == ("second", 6) and got[4] == ("third", 5)
        assert got[3] == ("Shop name\nAll wares\nalone\nCall us", 33)
        assert got[None] == ("", 0)
        assert got[5][0] == got[6][0] == "Head & <x>\nOne bold text\nTwo\na\nb"
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_give_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>|<br>", body))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


# --- 9 -----------------------------------------------------------------------------------------------------------------------


def test_quality_numbers(docs, pairs, odd, empty):
    for df, rows in ((docs, pairs), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        out = quality_rules.quality_verdicts(df).collect()
        got = Counter()
        for r in out:
            got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] += r.n_rows
        assert got == Counter((i, *brute.quality_numbers(t)) for i, t in rows)
    assert quality_rules.quality_verdicts(empty).count() == 0
    clash = docs.withColumn("__id", F.lit(1)).withColumn("__key", F.lit("k")).withColumn("__HOST", F.lit(2)).withColumn("___host", F.lit(2))
    assert quality_rules.keep_good(clash).columns == clash.columns
    assert quality_rules.keep_good(clash).count() == quality_rules.keep_good(docs).count()


@pytest.mark.parametrize("limit", [20, 2])
def test_line_frequencies(docs, limit):
    p = quality_rules.QualityRules(line_docs=limit, left_words=10_000, left_percent=95)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = {r.doc_id: (r.n_left_words, r.base_failed, r.kept) for r in quality_rules.quality_verdicts(docs, p).collect()}
    assert got == {i: (n, f, k) for i, n, f, k in brute.line_verdicts(rows, p)}


def test_banners_count_and_copies_do_not(spark):
    words = lambda k, n: " ".join(f"u{k}v{i}" for i in range(n))
    banner = words("b", 45)
    rows = [(k, f"{words(k, 10)}\n{banner}", "h") for k in range(30)] + [(100 + k, words("copy", 60) + "\n" + words("more", 20), "h") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(df).collect()}
    assert not any(got[k] for k in range(30))
    assert all(got[100 + k] for k in range(30))
    assert quality_rules.keep_good(df).count() == 30


def test_lines_are_counted_by_documents(spark):
    words = lambda k, n: " ".join(f"u{k}v{i}" for i in range(n))
    notice, footer = words("n", 45), words("f", 25) + "\n" + words("g", 25)
    rows = [(k, f"{notice}\n{words(k, 20)}", "first") for k in range(30)]
    rows += [(100 + k, f"{words(k, 20)}\n{footer}", "last") for k in range(30)]
    rows += [(200, "\n".join(f"{words(k, 2)}\n{notice}" for k in range(30)) + "\n" + words("x", 2000), "one")]
    # copies of one text are one document; what 30 of 3000 documents share is below the share of the host
    rows += [(300 + k, f"{words('same', 200)}\n{words('own', 60)}", "copies") for k in range(30)]
    rows += [(1000 + k, f"{words(k, 60)}" + (f"\n{words('rare', 70)}" if k % 100 == 0 else ""), "large") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_left_words, r.kept) for r in quality_rules.quality_verdicts(df).collect()}
    assert all(got[k] == got[100 + k] == (20, False) for k in range(30))  # a shared first line; a footer of two lines
    assert got[200] == (30 * 47 + 2000, True)  # a line repeated in one document
    assert all(got[300 + k] == (260, True) for k in range(30))
    assert all(got[1000 + k] == (60 + 70 * (k % 100 == 0), True) for k in range(3000))


# --- 10 ----------------------------------------------------------------------------------------------------------------------


def spots(text, p=spotsigs.SpotSigs()):
    bare = [w.strip(spotsigs.PUNCTUATION) for w in __import__("re").split(r"\s+", (text or "").lower())]
    w = [x for x in bare if x]
    content = [i for i, x in enumerate(w) if x not in p.anchors]
    out = set()
    for i, x in enumerate(w):
        if x in p.anchors:
            after = [w[j] for j in content if j > i][: p.chain]
            if len(after) == p.chain:
                out.add(" ".join(after) + " ")
    return out or {" ".join(w) + " "}


def test_signatures_are_chains_after_anchors(docs, pairs):
    sigs = {r.doc_id: set(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    some = pairs[:80]
    names = sorted({x for _, t in some for x in spots(t)})
    code = {r.x: r.h for r in docs.sparkSession.createDataFrame([(x,) for x in names], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    for i, t in some:
        assert sigs[i] == {code[x] for x in spots(t)}


def test_edited_texts(docs, pairs, odd, empty):
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs).collect()}
    rows = sorted(pairs, reverse=True)
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)]
        t, n = t or "", len(t or "") // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == brute.sha(t[: len(t) - n] + (nxt[1] or "")[:n])
        a, b, c = (set(x.split()) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[nxt[0]].fingerprint))
        assert got[i].near_edited == len(a & b) / len(a | b)
        assert got[i].near_next == len(a & c) / len(a | c)
    strange = spotsigs.edited_fingerprints(odd).collect()
    assert len(strange) == odd.count()
    same = [r.fingerprint for r in strange if r.doc_id in (1, 2)]
    assert same[0] == same[1]
    assert spotsigs.edited_fingerprints(empty).count() == 0
    one = spotsigs.edited_fingerprints(odd.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_ids_of_any_spread(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    ids = [low, high, None, 0, *range(1, 400), 1 << 40]
    df = spark.createDataFrame([(i, f"the text of number {i} is here and is its own" * 3) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        n = len(texts[i]) // 3
        assert got[i].edited_sha256 == brute.sha(texts[i][: len(texts[i]) - n] + texts[nxt][:n])
    own = df.select(F.col("doc_id").isNotNull().cast("int").alias("has"), F.coalesce("doc_id", F.lit(0)).alias("rid"), F.xxhash64("text").alias("key"))
    assert spotsigs.dealt(own).groupBy("bucket").count().agg(F.max("count")).first()[0] < 100


def test_similar_sets(docs, pairs):
    texts = {}
    for i, t in pairs:
        texts.setdefault(t or "", i)
    sets = docs.select(F.col("doc_id").alias("id"), spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    got = {(r.a, r.b) for r in spotsigs.similar_sets(sets).collect()}
    least = {}
    for r in sorted(sets.collect()):
        least.setdefault(tuple(r.sigs), r.id)
    assert {r.id: r["name"] for r in spotsigs.set_names(sets).collect()} == {r.id: least[tuple(r.sigs)] for r in sets.collect()}
    all_ = {i: set(k) for k, i in least.items()}
    ids = sorted(all_)
    assert got == {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(all_[a] & all_[b]) >= 0.8 * len(all_[a] | all_[b])}
