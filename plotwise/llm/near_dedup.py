"""Near-duplicate classes by BagMinHash (Ertl 2018): weighted minwise hashing of the multiset of word shingles.

Weights are the shingles' counts, discretised at the integers. A shingle's weight axis is cut into the dyadic intervals (0,1],
(1,2], (2,4], (4,8], ...; each carries a Poisson process whose points get a component of the signature and a weight level
inside the interval (the levels that successive halvings of the interval would pick). A bag sees the points whose level is not
above its own weight, and a component is the least point it sees. Points of an interval come in ascending order, so a process
stops at the bag's largest component: long bags cost about one point a shingle. Two bags agree in a component with a
probability of exactly their weighted Jaccard similarity.

Signatures are cut into bands; documents that agree in a band are candidates and are verified on their exact multisets. No
bucket emits all its pairs. First its members are held against one leader, the same for all buckets of a group, so that a group
of copies becomes one class by a pair a member. A bucket that still holds several classes then has one row for each of them, and
these are held against the largest class. What is left, members outside their bucket's largest class, is held against the rest of
the bucket in blocks of texts, each pair in the first bucket that it shares only; a block counts shared shingles with array
operations and gives the links between classes, a tree of them at most, and no pair of texts becomes a row. So every candidate
pair of different texts is verified or already in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .shared import digest_of, release, stored, text_of, unused

U64 = np.uint64


@dataclass(frozen=True)
class NearDedup:
    """A pair at the threshold is missed by all bands with a probability of 3e-6 (32 bands of 5). block: texts held against as many
    others in one task; block_bytes: bytes of them."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    block: int = 1024
    block_bytes: int = 1 << 22

    @property
    def size(self) -> int:
        return self.bands * self.rows


def bag_minhash(hashes: np.ndarray, counts: np.ndarray, docs: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Signatures (n_docs x size, 32-bit values) of bags given as distinct (doc, hash) rows with integer counts.

    A document without rows keeps the largest value in all components.
    """
    best = np.full(n_docs * size, np.iinfo(np.uint64).max, dtype=U64)
    parts = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(hashes)), parts)
    part = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(part == 0, 0, 1 << np.maximum(part - 1, 0))
    width = np.where(part <= 1, 1, 1 << np.maximum(part - 1, 0))
    seed = K.mix(hashes[item] + (part + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
    doc, weight, x = docs[item], counts[item], np.zeros(len(item))
    step = 0
    while len(seed):
        step += 1
        r = K.mix(seed + U64(step * 0xD1B54A32D192ED03 % (1 << 64)))
        x = x - np.log1p(-((r >> U64(11)).astype(np.float64) * 2.0**-53)) / width
        q = K.mix(r ^ U64(0xA0761D6478BD642F))
        level = low + 1 + ((q >> U64(32)) % width.astype(U64)).astype(np.int64)
        slot = doc * size + ((q & U64(0xFFFFFFFF)) % U64(size)).astype(np.int64)
        # the point's place in the order above, what names it below; 32 bits of each
        key = (x.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (K.mix(q) >> U64(32))
        seen = level <= weight
        np.minimum.at(best, slot[seen], key[seen])
        most = best.reshape(n_docs, size).max(axis=1)
        on = key < most[doc]
        seed, doc, weight, x, low, width = seed[on], doc[on], weight[on], x[on], low[on], width[on]
    return (best & U64(0xFFFFFFFF)).reshape(n_docs, size)


def bags(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) with counts, from one row for each occurrence."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), d[at]


def overlaps(a: pa.Array, b: pa.Array, words: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of the texts a[i] and b[i]; 0 if neither has a word."""
    n, step = len(a), 64
    if n > step:  # so that a batch is never held twice
        return np.concatenate([overlaps(a.slice(i, step), b.slice(i, step), words) for i in range(0, n, step)])
    both = pa.concat_arrays([a, b]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
    out = np.zeros(n)
    for block in pair_blocks(both):
        w = K.words(block)
        h, d = K.shingles(K.word_hashes(block, w), w.first, words)
        keys, counts, doc = bags(h, d)
        pair, side = doc // 2, doc % 2
        order = np.lexsort((side, keys, pair))
        keys, counts, pair = keys[order], counts[order], pair[order]
        n_pairs = (block.hi - block.lo) // 2
        total = np.bincount(pair, counts, minlength=n_pairs)
        same = np.flatnonzero((keys[1:] == keys[:-1]) & (pair[1:] == pair[:-1]))
        shared = np.bincount(pair[same], np.minimum(counts[same], counts[same + 1]), minlength=n_pairs)
        out[block.lo // 2 : block.hi // 2] = shared / np.maximum(total - shared, 1)
    return out


def pair_blocks(column: pa.Array) -> Iterator[K.Block]:
    """Blocks that never part the texts 2i and 2i+1."""
    lengths = np.diff(next(iter(K.blocks(column, limit=1 << 62))).bounds) if len(column) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths[0::2] + lengths[1::2])
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + K.BLOCK_BYTES, side="right")))
        block = next(iter(K.blocks(column.slice(2 * lo, 2 * (hi - lo)), limit=1 << 62)))
        yield K.Block(2 * lo, 2 * hi, block.data, block.bounds)
        lo = hi


def signed(texts: DataFrame, p: NearDedup) -> DataFrame:
    """(digest, keys, size): the band keys and the bytes of each text with a word; once a block for equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(0)
            for block in K.blocks(batch.column(1)):
                w = K.words(block)
                n = block.hi - block.lo
                names = np.frombuffer(b"".join(digests.slice(block.lo, n).to_pylist()), dtype="S16")
                has = np.zeros(n, dtype=bool)
                has[np.unique(names, return_index=True)[1]] = True
                has &= w.counts > 0
                h, d = K.shingles(K.word_hashes(block, w), w.first, p.words)
                hashes, counts, docs = bags(h[has[d]], np.cumsum(has)[d[has[d]]] - 1)
                rows = np.flatnonzero(has)
                if not len(rows):
                    continue
                got = bag_minhash(hashes, counts, docs, len(rows), p.size)
                bands = got.reshape(len(rows), p.bands, p.rows)
                key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(rows), p.bands)).copy()
                for r in range(p.rows):
                    key = K.mix(key ^ bands[:, :, r])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * p.bands), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([digests.slice(block.lo, n).take(pa.array(rows)).cast(pa.binary()), keys, pa.array(np.diff(block.bounds)[rows])], ["digest", "keys", "size"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, keys array<long>, size long")


def verified(pairs: DataFrame, texts: DataFrame, p: NearDedup, name: str) -> DataFrame:
    """(a, b, sim), stored, for the pairs (a, b) of text ids; `texts` has id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlaps(batch.column(2), batch.column(3), p.words))], ["a", "b", "sim"])

    left, right = (texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stored(joined.mapInArrow(run, "a long, b long, sim double"), name)


def ordered_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def shared_by(texts: pa.Array, words: int):
    """A function of i, j...: the weighted Jaccard similarities of the text i with the texts j, by their shared shingles."""
    hashes, docs = [], []
    for block in K.blocks(texts):
        w = K.words(block)
        h, d = K.shingles(K.word_hashes(block, w), w.first, words)
        hashes.append(h)
        docs.append(d + block.lo)
    keys, counts, doc = bags(np.concatenate(hashes), np.concatenate(docs))
    total = np.bincount(doc, counts, minlength=len(texts))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    order = np.argsort(keys, kind="stable")
    by_key, by_count, by_doc = keys[order], counts[order], doc[order]

    def similarities(i: int, others: np.ndarray) -> np.ndarray:
        own, n = keys[first[i] : first[i + 1]], counts[first[i] : first[i + 1]]
        lo = np.searchsorted(by_key, own)
        size = np.searchsorted(by_key, own, side="right") - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        both = np.bincount(by_doc[at], np.minimum(np.repeat(n, size), by_count[at]), minlength=len(texts))[others]
        return both / np.maximum(total[i] + total[others] - both, 1)

    return similarities


def block_links(rest: DataFrame, texts: DataFrame, p: NearDedup) -> DataFrame:
    """(a, b), stored: classes that a link joins. `rest` has key, keys, id, comp, out and the lanes of its bucket, `texts` id and text.

    Members that are `out` of their bucket's largest class are held against all members, block by block.
    """

    def run(rows):  # no type hints: Spark reads them
        side = rows.column("is_x").to_numpy()
        ids, comps = rows.column("id").to_numpy(), rows.column("comp").to_numpy()
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        here = keys == rows.column("key")[0].as_py()
        similarities = shared_by(rows.column("text").combine_chunks(), p.words)
        names, root = np.unique(comps, return_inverse=True)
        y, links = np.flatnonzero(~side), []
        for x in np.flatnonzero(side):
            other = y[root[y] != root[x]]
            met = keys[other] == keys[x]
            other = other[here[other, met.argmax(axis=1)]]  # the first bucket that the two share
            if not len(other):
                continue
            for j in other[similarities(x, other) >= p.similarity]:
                if root[j] != root[x]:
                    links.append((int(comps[x]), int(comps[j])))
                    root[root == root[j]] = root[x]
        return pa.table({"a": pa.array([min(v) for v in links], pa.int64()), "b": pa.array([max(v) for v in links], pa.int64())})

    lane = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["key", "keys", "id", "comp"]
    x = rest.where("out").select(*cols, F.lit(True).alias("is_x"), lane("out_lanes").alias("bx"), every("all_lanes").alias("by"))
    y = rest.select(*cols, F.lit(False).alias("is_x"), every("out_lanes").alias("bx"), lane("all_lanes").alias("by"))
    full = x.union(y).join(texts, "id")
    return stored(full.groupBy("key", "bx", "by").applyInArrow(run, "a long, b long").distinct(), "links")


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, comp) after more links (a, b) of nodes, or of classes by their names; only those that are joined are worked on."""
    at = lambda k: classes.select(F.col("node").alias(k), F.col("comp").alias(f"c_{k}"))
    edges = stored(links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return classes
    merged = components(edges)
    names = merged.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    known = classes.join(names, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return stored(known.union(merged.join(classes, "node", "left_anti")), "classes")


def link_classes(texts: DataFrame, p: NearDedup) -> DataFrame:
    """(digest, comp): classes of the digests that have a link to another text. `texts` (digest, text) may repeat a text.

    Inside, a text goes by a 64-bit hash of its digest. Two texts with near copies that share it by chance would be taken for one:
    of n such texts n * n / 2^65 pairs are to be expected, one or two in ten thousand million.
    """
    of_digest = F.xxhash64("digest").alias("id")
    marks = stored(signed(texts, p), "signatures")
    members = marks.select(of_digest, "size", F.explode("keys").alias("key")).distinct()
    buckets = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    members = stored(members.join(buckets, "key"), "members")
    involved = members.select("id").distinct()
    kept = stored(texts.select(of_digest, "text").dropDuplicates(["id"]).join(involved, "id", "left_semi"), "texts")

    held = verified(ordered_pairs(members, "leader", "id"), kept, p, "held")
    near = F.col("sim") >= p.similarity
    classes = components(held.where(near).select("a", "b"))

    def by_class(classes: DataFrame) -> DataFrame:
        """A row for each class in each bucket that holds several: n members of so many bytes, and the first and the last of them."""
        known = members.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        each = known.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("id").alias("low"), F.max("id").alias("high"))
        span = each.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("n_all"), F.sum("bytes").alias("bytes_all")).where("lo <> hi").select("key", "n_all", "bytes_all")
        return each.join(span, "key")

    rest = stored(by_class(classes), "rest")
    if not rest.isEmpty():
        lead = rest.groupBy("key").agg(F.max(F.struct("n", "comp", "low", "high")).alias("m")).select("key", "m.*")
        others = rest.select("key", F.col("comp").alias("own"), F.col("high").alias("id")).join(lead, "key").where("own <> comp")
        asked = ordered_pairs(others, "low", "id").union(ordered_pairs(others, "high", "id")).distinct()
        more = verified(asked.join(held.select("a", "b"), ["a", "b"], "left_anti"), kept, p, "held")
        held = held.unionByName(more)
        classes = joined_classes(classes, more.where(near).select("a", "b"))
        rest = stored(by_class(classes), "rest")
    if not rest.isEmpty():
        largest = rest.groupBy("key").agg(F.max(F.struct("n", "comp", "bytes")).alias("m"))
        lanes = lambda n, size: F.greatest(F.ceil(n / F.lit(p.block)), F.ceil(size / F.lit(p.block_bytes)), F.lit(1)).cast("long")
        outside = lanes(F.col("n_all") - F.col("m.n"), F.col("bytes_all") - F.col("m.bytes"))
        open_ = rest.join(largest, "key").select("key", "comp", (F.col("comp") != F.col("m.comp")).alias("out"), outside.alias("out_lanes"), lanes(F.col("n_all"), F.col("bytes_all")).alias("all_lanes"))
        known = members.join(open_.select("key").distinct(), "key", "left_semi").join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        full = known.join(open_, ["key", "comp"]).join(marks.select(of_digest, "keys").dropDuplicates(["id"]), "id")
        classes = joined_classes(classes, block_links(full, kept, p))
    names = marks.select(of_digest, "digest").distinct()
    named = names.join(classes.withColumnRenamed("node", "id"), "id").select("digest", "comp")
    out = stored(named, "classes")
    release(marks, members, kept, rest)
    return out


def near_duplicate_classes(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, digest, class_id, rep_digest, is_kept.

    Rows are in one class if their texts are equal or linked by similarity of at least p.similarity, directly or in a chain;
    class_id is the least doc_id of the class, rep_digest the digest of that row's text. is_kept marks the rows of that doc_id
    and text. Null text is empty; texts without a word are only equal to texts of the same bytes. Rows that repeat a doc_id are
    rows of their own. A class whose doc_ids are all null has a null class_id. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    rows = docs.select(F.col("doc_id"), text_of().alias("text")).withColumn("digest", digest_of(F.col("text")))
    classes = link_classes(rows.select("digest", "text"), p)
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(classes, "digest", "left")
    groups = groups.withColumn("comp", F.coalesce(F.lpad(F.hex("comp"), 16, "0"), F.hex("digest")))
    least = groups.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")).alias("r"))
    known = groups.join(least, "comp").select("digest", F.col("r.doc_id").alias("class_id"), F.col("r.digest").alias("rep_digest"))
    return rows.select("doc_id", "digest").join(known, "digest").withColumn("is_kept", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("rep_digest")))


def drop_near_duplicates(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """`docs` with one row of each class of near_duplicate_classes: that of the least doc_id. All columns stay as they are, whatever
    their names; of rows that repeat a kept doc_id and text one stays. Nulls are as there; an empty table gives no rows."""
    mark, known_id = unused(docs, "digest", "id")
    kept = near_duplicate_classes(docs, p).where("is_kept").select(F.col("digest").alias(mark), F.col("doc_id").alias(known_id)).distinct()
    known = docs.withColumn(mark, digest_of(text_of()))
    rows = known.join(kept, (known[mark] == kept[mark]) & known["doc_id"].eqNullSafe(kept[known_id]), "left_semi")
    return rows.dropDuplicates(["doc_id", mark]).drop(mark)
