"""Quality classifier: perplexity by an interpolated modified Kneser-Ney trigram model of trusted text.

The model is taught on all trusted rows but those held out for the quantile. N-grams are counted and packed where they are read, as
numbers of the words that a packed row has, and are dealt by the word before the last: there all n-grams with that word meet, so the
counts of different words before an n-gram and the totals of its contexts are known without a further shuffle. A word with more than a
shard's share of all is dealt by the last word too, and what its contexts lack is added up by key. A model of up to `given` n-grams of the
highest order is given to all tasks, and a document is scored where it is. A larger one stays in shards: each batch of documents asks
for its distinct n-grams, is answered with their counts, and is scored then; documents go in `rounds`. Both ways give the same scores.

A document is kept if its perplexity isn't above a quantile of its language's trusted documents that the model wasn't taught on.
The quantile counts all of them, at a resolution of 0.001 in log10.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from . import kernel as K
from .shared import lean, lean_batches, release, stored, swept, text_bytes, text_of
from .substrings import bloom, passes

U64 = np.uint64
#: By which the keys of n-grams of 1, 2, ... words are told apart in one table.
SALTS = K.mix(np.arange(1, 17, dtype=U64) + U64(0x5A17))
START, END, UNKNOWN = (int(x) for x in K.mix(np.array([0x57A27, 0xE4D, 0x0DD], dtype=U64)))


@dataclass(frozen=True)
class QualityModel:
    """quantile: of the trusted, untaught documents. few: a language with fewer such documents has the quantile of all languages.
    taught: share of the trusted rows that are taught on, in percent. given: n-grams of a model that is given to all tasks. rounds: in
    which documents ask a larger one, so that requests of so large a part of them are on disk at once."""

    order: int = 3
    quantile: float = 0.99
    few: int = 50
    taught: int = 80
    given: int = 2_000_000
    rounds: int = 8
    filter_bytes: int = 1 << 25
    shard_bytes: int = 1 << 25
    batch_bytes: int = 1 << 22


def padded(block: K.Block, w: K.Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with order - 1 starts before and an end after each document; places of what is predicted; document of each."""
    n, docs = len(w.first) - 1, w.docs()
    hashes = K.word_hashes(block, w)
    out = np.full(len(hashes) + n * order, START, dtype=U64)
    shift = docs * order + order - 1
    out[np.arange(len(hashes)) + shift] = hashes
    ends = w.first[1:] + np.arange(1, n + 1) * order - 1
    out[ends] = END
    sizes = w.counts + 1
    doc = np.repeat(np.arange(n), sizes)
    at = np.arange(len(doc)) + (doc + 1) * (order - 1)
    return out, at, doc


def padded_parts(block: K.Block, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As padded(), for a large block, a part of it at a time."""
    words, at, doc, size = [], [], [], 0
    for b in K.parts(block):
        w, a, d = padded(b, K.words(b), order)
        words.append(w)
        at.append(a + size)
        doc.append(d + b.lo)
        size += len(w)
    return np.concatenate(words), np.concatenate(at), np.concatenate(doc)


def gram_keys(words: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that end at each place."""
    return K.FIRST.spans(words, last - n + 1, last + 1)


def in_few(df: DataFrame, least: int = 1) -> DataFrame:
    """A small table in two tasks a core at most, or `least`. For files that tasks write Hadoop may start processes, which share
    the executor's memory until they run, and so seem to take as much again."""
    return df.coalesce(max(least, 2 * df.sparkSession.sparkContext.defaultParallelism))


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(g1, h1, g2, h2, ..., n): how often each n-gram of `order` words occurs. g<k> are its last k words, h<k> the words before the
    last one of those; h1 is the same for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column(0)):
                words, at, _ = padded(block, K.words(block), order)
                _, first, n = np.unique(gram_keys(words, at, order), return_index=True, return_counts=True)
                where, columns = at[first], []
                for k in range(1, order + 1):
                    columns += [gram_keys(words, where, k), K.FIRST.spans(words, where - k + 1, where)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(n.astype(np.int64))], [*names, "n"])

    names = [f"{c}{k}" for k in range(1, order + 1) for c in "gh"]
    seen = texts.mapInArrow(lean_batches(run), ", ".join([*[f"{c} long" for c in names], "n long"]))
    return seen.groupBy(*names).agg(F.sum("n").alias("n"))


def discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    n = {r["c"]: r["m"] for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("m")).collect()}
    return discounted(*(n.get(i, 0) for i in range(1, 5)))


def discounted(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The same from how many counts are 1, 2, 3 and 4."""
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]  # too little text to estimate them
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.01), i - 0.01) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


@dataclass
class Order:
    """An order's tables, sorted by key: what is left of each n-gram's count by its discount; contexts' totals and what was taken off."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    off: np.ndarray


def sorted_by(df: DataFrame, key: str, *values: str) -> list[np.ndarray]:
    """Columns of a bounded table, in the order of the key."""
    rows = df.select(key, *values).toArrow()
    keys = rows.column(key).to_numpy().view(U64)
    order = np.argsort(keys)
    return [keys[order], *(rows.column(v).to_numpy()[order] for v in values)]


def tables(counted: DataFrame, order: int) -> list[Order]:
    """The model of the counted n-grams, shortest first. Each shorter order counts the different n-grams that end with its own."""
    out: list[Order] = []
    table = stored(in_few(counted.withColumnRenamed("n", "c")), "grams")
    for k in range(order, 0, -1):
        d = discounts(table)
        off = F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        grams = sorted_by(table.select(f"g{k}", (F.col("c") - off).alias("left")), f"g{k}", "left")
        contexts = sorted_by(table.groupBy(f"h{k}").agg(F.sum("c").cast("double").alias("total"), F.sum(off).alias("off")), f"h{k}", "total", "off")
        out.append(Order(*grams, *contexts))
        below = None
        if k > 1:
            names = [f"{c}{i}" for i in range(1, k) for c in "gh"]
            below = stored(in_few(table.groupBy(*names).agg(F.count("*").alias("c"))), "grams")
        release(table)
        table = below
    return out[::-1]


def found(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and where."""
    if not len(have):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return have[at] == keys, at


class Scorer:
    """log10 probabilities from the model's tables. A word that was never seen has an equal part of what was taken off all words."""

    def __init__(self, orders: list[Order]):
        self.orders = orders

    def log10(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.full(len(at), 1.0 / (len(self.orders[0].grams) + 1))
        live = np.arange(len(at))  # places whose context is known so far
        for k, table in enumerate(self.orders, 1):
            known, x = found(table.contexts, K.FIRST.spans(words, at[live] - k + 1, at[live]))
            live, x = live[known], x[known]
            seen, g = found(table.grams, gram_keys(words, at[live], k))
            own = np.where(seen, table.counts[g], 0.0) if len(table.counts) else 0.0
            p[live] = (own + table.off[x] * p[live]) / table.totals[x]
        return np.log10(p)


def perplexities(docs: DataFrame, scorer, order: int, extra: list[str]) -> DataFrame:
    """`extra` columns of each row with n_tokens and log10_ppl, the mean of -log10 p over its words and its end."""
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column(len(extra))):
                words, at, doc = padded(block, K.words(block), order)
                n = np.bincount(doc, minlength=block.hi - block.lo)
                total = np.bincount(doc, scorer.value.log10(words, at), minlength=len(n))
                columns = [batch.column(i).slice(block.lo, block.hi - block.lo) for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array(-total / n)], [*extra, "n_tokens", "log10_ppl"])

    return docs.select(*extra, text_of().alias("text")).mapInArrow(lean_batches(run), f"{fields}, n_tokens long, log10_ppl double")


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return K.mix(K.mix(a) + b)


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Columns of numbers of any lengths, by byte planes and compressed. Planes above the largest number's are left out."""
    columns, head = [], [len(arrays)]
    for x in arrays:
        x = np.ascontiguousarray(x.astype(U64, copy=False))
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head += [len(x), width]
        columns.append(x.astype(np.uint8) if width == 1 else np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T))
    raw = b"".join([np.array(head, dtype=np.int64), *columns])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd")
    head = np.frombuffer(raw, dtype=np.int64, offset=8, count=2 * int(np.frombuffer(raw, dtype=np.int64, count=1)[0])).tolist()
    at, out = 8 + 8 * len(head), []
    for n, width in zip(head[::2], head[1::2], strict=True):
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at)
        at += n * width
        if width > 1:
            x = np.zeros((n, 8), dtype=np.uint8)
            x[:, :width] = planes.reshape(width, n).T
            out.append(x.view(U64).ravel())
        else:
            out.append(planes.astype(U64) if width else np.zeros(n, dtype=U64))
    return out


def pieces(at: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Places in parts with so few words that an n-gram of their numbers is one number."""
    size = (1 << 63 // order) - order
    for lo in range(0, len(at), size):
        yield at[lo : lo + size]


def distinct_grams(words: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The words around these places, and the distinct n-grams that end there: their words' numbers (the previous word, the last, those
    before, nearest first), in the order of these; which of them is at each place; how often each occurs."""
    lo = at[0] - order + 1
    vocabulary, ids = np.unique(words[lo : at[-1] + 1], return_inverse=True)
    ids = ids.astype(np.int64)
    bits, key = 63 // order, ids[at - lo - 1]
    lost = vocabulary[key] == U64(UNKNOWN)  # what is before an unknown word tells nothing
    for back in (0, *range(2, order)):
        key = key << bits | (np.where(lost, ids[at - lo - 1], ids[at - lo - back]) if back and lost.any() else ids[at - lo - back])
    key, which, n = np.unique(key, return_inverse=True, return_counts=True)
    return vocabulary, [key >> bits * i & (1 << bits) - 1 for i in range(order - 1, -1, -1)], which, n


def packed_grams(vocabulary: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """N-grams with the words that they need."""
    used = np.zeros(len(vocabulary), dtype=bool)
    for c in columns:
        used[c] = True
    words = np.flatnonzero(used)
    number = np.empty(len(vocabulary), dtype=np.int64)
    number[words] = np.arange(len(words))
    return squeezed([np.diff(vocabulary[words], prepend=U64(0)), n, np.diff(number[columns[0]], prepend=0), *(number[c] for c in columns[1:])])


def unpacked_numbers(data: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """What packed_grams() has packed: the words (hashes) in order, the n-grams by their words' numbers, and their counts."""
    steps, n, first, *others = unsqueezed(data)
    return np.cumsum(steps, dtype=U64), [np.cumsum(first.view(np.int64)), *(c.view(np.int64) for c in others)], n.view(np.int64)


def unpacked_grams(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams' words (hashes) in packed_grams()'s order, and their counts."""
    vocabulary, columns, n = unpacked_numbers(data)
    return [vocabulary[c] for c in columns], n


def dealt(columns: list[np.ndarray], heavy: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each n-gram, by its previous word, or by that and its last if the previous one is heavy; 1 + which heavy one, else 0."""
    is_heavy, which = found(heavy, columns[0])
    return (np.where(is_heavy, joined(columns[0], columns[1]), columns[0]) >> U64(64 - bits)).astype(np.int64), np.where(is_heavy, which + 1, 0)


def contexts_of(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the contexts of 1, 2, ... words."""
    out = [columns[0]]
    for c in columns[2:]:
        out.append(joined(out[-1], c))
    return out


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and the sums of the columns."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], order[first], [np.add.reduceat(c[order], first) if len(first) else c for c in columns]


def begins(column: np.ndarray) -> np.ndarray:
    """Where equal values in a row begin."""
    return np.append(True, column[1:] != column[:-1])[: len(column)]


def merged(parts: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """What unpacked_numbers() has of several packed rows as of one: distinct n-grams in the order of their words' numbers, counts added up."""
    vocabulary = np.sort(np.concatenate([v for v, _, _ in parts]))
    vocabulary = vocabulary[begins(vocabulary)]
    numbers = [np.searchsorted(vocabulary, v) for v, _, _ in parts]
    columns = [np.concatenate([number[c] for number, c in zip(numbers, same, strict=True)]) for same in zip(*(c for _, c, _ in parts), strict=True)]
    n, bits = np.concatenate([n for _, _, n in parts]), len(vocabulary).bit_length()
    if bits * len(columns) < 64:  # an n-gram is one number
        key = reduce(lambda key, c: key << bits | c, columns)
        order = np.argsort(key)
        changed = begins(key[order])
    else:
        order = np.lexsort(columns[::-1])
        changed = reduce(np.logical_or, (begins(c[order]) for c in columns))
    first = np.flatnonzero(changed)
    return vocabulary, [c[order[first]] for c in columns], np.add.reduceat(n[order], first) if len(first) else n


class Known:
    """A shard's distinct n-grams as they are asked for. They come in the order of their words' numbers, so a shorter one is a run of rows,
    and its place and the next word's number are the key of a longer one: only contexts of two words or more are sorted. levels: keys and
    counts of the n-grams of 2, 3, ... words, keys of their contexts and sums of these (of the counts, and how many are 1, 2, more); counts
    and sums have a 0 more, for what isn't there. contexts: the place of each word as a context."""

    def __init__(self, vocabulary: np.ndarray, columns: list[np.ndarray], n: np.ndarray):
        self.vocabulary, self.levels = vocabulary, []
        changed, rows = begins(columns[0]), []
        for c in columns[1:]:
            changed = changed | begins(c)
            rows.append(np.flatnonzero(changed))
        for k, (first, c) in enumerate(zip(rows, columns[1:], strict=True)):
            word, last = c[first], k == len(rows) - 1
            count = n if last else np.diff(np.searchsorted(rows[k + 1], first), append=len(rows[k + 1]))
            if k:
                gram, context = (np.repeat(x, size) << 32 | word for x in (np.arange(len(size)), place))
                order = np.argsort(context)
                context, sums = context[order], count[order]
            else:
                context, sums = columns[0][first], count
                gram = context << 32 | word
            at = begins(context)
            one = np.flatnonzero(at)
            if not last:
                place, size = np.cumsum(at) - 1, count
                if k:
                    place[order] = place.copy()
            sums = [np.add.reduceat(x, one) if len(one) else x.astype(np.int64) for x in (sums, *(y.astype(np.int64) for y in (sums == 1, sums == 2, sums > 2)))]
            self.levels.append((gram, np.append(count, 0), context[one], [np.append(x, 0) for x in sums]))
        words = self.levels[0][2]
        self.contexts = np.full(len(vocabulary) + 1, len(words))
        self.contexts[words] = np.arange(len(words))

    def tell(self, vocabulary: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
        """For each level the counts of these n-grams and the sums of their contexts, 0 where there are none."""
        number = self.number(self.vocabulary, vocabulary)
        columns, out = [number[c] for c in columns], []
        gram, context, known = columns[0], self.contexts[columns[0]], len(self.vocabulary)
        for k, (grams, count, contexts, sums) in enumerate(self.levels):
            word = columns[k + 1]
            if k:
                some = np.flatnonzero((context < before) & (word < len(self.vocabulary)))
                place = np.full(len(word), len(contexts))
                key = context[some] << 32 | word[some]
                order = np.argsort(key)
                place[some[order]] = self.number(contexts, key[order])
                context = place
            some = np.flatnonzero((gram < known) & (word < len(self.vocabulary)))
            key, place = gram[some] << 32 | word[some], np.full(len(word), len(grams))
            first = np.flatnonzero(begins(key))  # equal ones in a row are looked up once
            place[some] = np.repeat(self.number(grams, key[first]), np.diff(first, append=len(key)))
            gram, known, before = place, len(grams), len(contexts)
            out += [x[at] for at, values in ((gram, [count]), (context, sums)) for x in values]
        return out

    @staticmethod
    def number(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The place of each key, the number of all where it isn't."""
        seen, at = found(have, keys)
        return np.where(seen, at, len(have))

    def contexts_at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words before the last of all contexts of k + 1 words, and the contexts' keys, as contexts_of() has them."""
        contexts = self.levels[k][2]
        if not k:
            return self.vocabulary[contexts], self.vocabulary[contexts]
        word, key = self.contexts_at(k - 1)
        shorter = contexts >> 32
        return word[shorter], joined(key[shorter], self.vocabulary[contexts & 0xFFFFFFFF])


def values_at(have: np.ndarray, columns: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """The columns' values of each key, 0 where it isn't. Equal keys in a row are looked up once."""
    if not len(have) or not len(keys):
        return [np.zeros(len(keys), dtype=np.int64) for _ in columns]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    seen, at = found(have, keys[first])
    n = np.diff(first, append=len(keys))
    return [np.repeat(np.where(seen, c[at], 0), n) for c in columns]


def heavy_words(texts: DataFrame, bits: int) -> np.ndarray:
    """Words, the start included, that have more than a shard's share of all; those just above it may be missing. Sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column(0)):
                words = np.append(K.word_hashes(block, K.words(block)), np.full(block.hi - block.lo, START, dtype=U64))
                bucket = (words >> U64(48)).astype(np.int64)  # only few words are in a bucket that has so many
                word, n = np.unique(words[np.bincount(bucket, minlength=1 << 16)[bucket] > len(words) >> bits], return_counts=True)
                some = n > len(words) >> bits
                yield pa.RecordBatch.from_arrays([pa.array([None, *word[some].view(np.int64).tolist()], pa.int64()), pa.array([len(words), *n[some].tolist()], pa.int64())], ["word", "n"])

    counted = texts.mapInArrow(lean_batches(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
    total = counted.where("word is null").select("n").first()
    rows = counted.where(F.col("word").isNotNull() & (F.col("n") > F.lit((total["n"] if total else 0) >> bits))).select("word").toArrow()
    counted.unpersist()
    return np.sort(rows.column("word").to_numpy().view(U64))


def taught_texts(docs: DataFrame, teach: DataFrame, p: QualityModel) -> DataFrame:
    """The texts of the rows whose doc_id is in `teach`. Texts are not shuffled: a Bloom filter of bounded size tells where they are, and
    the few keys that it lets through for nothing are found by a join of ids."""
    key = F.xxhash64("doc_id").alias("g")
    context = docs.sparkSession.sparkContext
    filter_ = context.broadcast(bloom(in_few(teach.select(key)), p.filter_bytes))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(filter_.value, batch.column(0).to_numpy().view(U64))))

    ids = docs.where("doc_id is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    through = ids.select(key, "doc_id").mapInArrow(passing, f"g long, doc_id {kind}")
    wrong = context.broadcast(through.join(teach, "doc_id", "left_anti").select("g").distinct().toArrow().column("g").to_numpy())

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passing(batches):
            yield batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), wrong.value))).select([1])

    return ids.select(key, text_of().alias("text")).mapInArrow(lean_batches(taught), "text string")


@dataclass
class Shards:
    """A model in shards. table: the name of the one of (shard, data) of packed n-grams, then of packed (key, sums) of words and of heavy
    words' contexts; it lies in buckets by shard, so that no round shuffles it. grams: how many of the longest. words: how many, their total
    and what was taken off. heavy: their sums as contexts of one word. filter: of words. taken: discounts, shortest first."""

    table: str
    bits: int
    grams: int
    words: tuple[int, float, float]
    heavy: np.ndarray
    heavy_sums: np.ndarray
    filter: Broadcast
    taken: list[list[float]]

    def release(self, spark: SparkSession) -> None:
        """The model goes; nothing asks it any more."""
        release(spark.table(self.table))
        spark.sql(f"DROP TABLE {self.table}")
        self.filter.destroy()


def sharded(texts: DataFrame, all_texts: DataFrame, p: QualityModel) -> Shards:
    """The model of the texts. N-grams are dealt by the word before the last, so that all counts and contexts of two words or more meet in
    one shard. A word with more than a shard's share is dealt by the last word too; sums of its contexts are added up by key."""
    spark, bits = texts.sparkSession, max(2, (text_bytes(all_texts) // p.shard_bytes).bit_length() + 1)
    heavy = np.union1d(heavy_words(all_texts, bits), np.array([UNKNOWN], dtype=U64))
    names = ("a", "b", "c", "d")

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column(0), p.batch_bytes):
                words, at, _ = padded_parts(block, p.order)
                for some in pieces(at, p.order):
                    vocabulary, columns, _, n = distinct_grams(words, some, p.order)
                    shard, _ = dealt([vocabulary[c] for c in columns[:2]], heavy, bits)
                    order = np.argsort(shard, kind="stable")
                    for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                        yield pa.RecordBatch.from_arrays([pa.array([shard[rows[0]]]), pa.array([packed_grams(vocabulary, [c[rows] for c in columns], n[rows])], pa.binary())], ["shard", "data"])

    def build(table):  # no type hints: Spark reads them
        vocabulary, columns, n = merged([unpacked_numbers(x) for x in table.column("data").to_pylist()])
        known = Known(vocabulary, columns, n)
        out = [(-1, table.column("shard")[:1].to_numpy(), np.zeros((4, 1), dtype=np.int64)), (0, np.array([-1]), np.array([[len(n)], [0], [0], [0]]))]
        for k, (grams, count, _, sums) in enumerate(known.levels):
            out.append((0, np.array([k]), np.array([[(count == i).sum()] for i in range(1, 5)])))
            if k == 0:
                m = np.bincount(grams & 0xFFFFFFFF, minlength=len(vocabulary))
                last = np.flatnonzero(m)
                out.append((1, K.mix(vocabulary[last] ^ SALTS[0]).view(np.int64), np.stack([m[last], *np.zeros((3, len(last)), dtype=np.int64)])))
            before, context = known.contexts_at(k)
            some = np.flatnonzero(found(heavy, before)[0])
            out.append((3 if k else 2, (context[some] ^ SALTS[k] if k else context[some]).view(np.int64), np.stack([x[some] for x in sums])))
        size = sum(len(key) for _, key, _ in out)
        data = [packed_grams(vocabulary, columns, n), *[None] * (size - 1)]
        return pa.table([
            pa.array(np.concatenate([np.full(len(key), kind, dtype=np.int32) for kind, key, _ in out])), pa.array(np.concatenate([key for _, key, _ in out])),
            *map(pa.array, np.concatenate([x for _, _, x in out], axis=1)), pa.array(data, pa.binary()),
        ], ["kind", "key", *names, "data"])

    def pack(table):
        keys = table.column("key").to_numpy().view(U64)
        order = np.argsort(keys)
        data = squeezed([np.diff(keys[order], prepend=U64(0)), *(table.column(c).to_numpy()[order] for c in names)])
        return pa.table([table.column("shard")[:1], pa.array([data], pa.binary())], ["shard", "data"])

    built = stored(texts.mapInArrow(lean_batches(teach), "shard long, data binary").groupBy("shard").applyInArrow(lean(build), "kind int, key long, a long, b long, c long, d long, data binary"), "built")
    sums = stored(in_few(built.where("kind in (1, 3)").groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in names)), 1 << bits), "sums")
    few = {r["key"]: [r[c] or 0 for c in names] for r in built.where("kind = 0").groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).collect()}
    kept = built.where("kind = 2").groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    heavy_sums = np.stack(values_at(*(lambda k, o: (k[o], [kept.column(c).to_numpy()[o] for c in names]))(x := kept.column("key").to_numpy().view(U64), np.argsort(x)), heavy))
    w = sums.where("kind = 1").agg(F.count("*").alias("kinds"), F.sum("a").alias("total"), *(F.count_if(F.col("a") == i).alias(f"n{i}") for i in range(1, 5))).first()
    first = [w[f"n{i}"] for i in range(1, 5)]
    taken = [discounted(*first), *(discounted(*few.get(k, [0] * 4)) for k in range(p.order - 1))]
    off = first[0] * taken[0][0] + first[1] * taken[0][1] + (w["kinds"] - first[0] - first[1]) * taken[0][2]
    grams = built.where("kind = -1")
    keyed = sums.withColumn("shard", F.shiftrightunsigned("key", 64 - bits) + F.lit(1 << bits)).groupBy("shard").applyInArrow(lean(pack), "shard long, data binary")
    if few.get(-1, [0])[0] > p.given:
        swept(spark)  # what was taught is in `built` now
    name = f"plotwise_model_{uuid.uuid4().hex}"
    packed = grams.select(F.col("key").alias("shard"), "data").unionByName(keyed)
    buckets = min(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, "shard").saveAsTable(f"spark_catalog.default.{name}", format="parquet")
    filter_ = spark.sparkContext.broadcast(bloom(sums.where("kind = 1").select(F.col("key").alias("g")), p.filter_bytes))
    release(built, sums)
    return Shards(f"spark_catalog.default.{name}", bits, few.get(-1, [0])[0], (w["kinds"], float(w["total"] or 0), off), heavy, heavy_sums, filter_, taken)


def asked_perplexities(docs: DataFrame, model: Shards, extra: list[str], p: QualityModel) -> DataFrame:
    """As perplexities(), for a model in shards: a batch's distinct n-grams go to them, counts come back; its places wait meanwhile. Words
    that the model doesn't have are one; a Bloom filter tells most of them, and those that it lets through are asked for nothing."""
    bits, heavy = model.bits, model.heavy
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    row = "batch binary, part long, shard long, data binary, rows binary"
    names = ["batch", "part", "shard", "data", "rows"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column(len(extra)), p.batch_bytes):
                words, at, doc = padded_parts(block, p.order)
                words[~(passes(filter_.value, K.mix(words ^ SALTS[0])) | (words == START))] = UNKNOWN
                name, waiting, out = uuid.uuid4().bytes, [np.bincount(doc, minlength=block.hi - block.lo)], []
                for part, some in enumerate(pieces(at, p.order)):
                    vocabulary, ids, which, n = distinct_grams(words, some, p.order)
                    shard, which_heavy = dealt([vocabulary[c] for c in ids[:2]], heavy, bits)
                    order = np.argsort(shard, kind="stable")
                    place = np.empty(len(order), dtype=np.int64)
                    place[order] = np.arange(len(order))
                    ids, which_heavy = [c[order] for c in ids], which_heavy[order]
                    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=1 << bits))
                    out += [(part, int(shard[order[lo]]), packed_grams(vocabulary, [c[lo:hi] for c in ids], np.zeros(0, dtype=np.int64))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                    # by key: the words, and contexts of heavy words
                    used, number = np.unique(ids[1], return_inverse=True)
                    asked, index, size = [K.mix(vocabulary[used] ^ SALTS[0])], [number], len(used)
                    some_heavy = which_heavy > 0
                    for k, context in enumerate(contexts_of([vocabulary[c[some_heavy]] for c in ids])[1:], 1):
                        keys, number = np.unique(context ^ SALTS[k], return_inverse=True)
                        asked, index, size = [*asked, keys], [*index, number + size], size + len(keys)
                    keys = np.concatenate(asked)
                    order = np.argsort(keys)
                    number = np.empty(len(order), dtype=np.int64)
                    number[order] = np.arange(len(order))
                    keys = keys[order]
                    shard = (keys >> U64(64 - bits)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=1 << bits))
                    out += [(part, (1 << bits) + int(shard[lo]), squeezed([np.diff(keys[lo:hi], prepend=U64(0))])) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                    waiting += [place[which], which_heavy, *(number[i] for i in index)]
                rows = batch.select(extra).slice(block.lo, block.hi - block.lo)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as stream:
                    stream.write_batch(rows)
                out.append((-1, -1 - name[0] % (1 << bits), squeezed(waiting)))
                parts, shards, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.binary()), pa.array(parts, pa.int64()), pa.array(shards, pa.int64()), pa.array(data, pa.binary()), pa.array([*[None] * (len(out) - 1), sink.getvalue().to_pybytes()], pa.binary())], names)

    def answer(asks, own):  # no type hints: Spark reads them
        shard = asks.column("shard")[0].as_py() if asks.num_rows else -1
        if shard < 0:
            return asks
        model = own.column("data").to_pylist()
        none = np.zeros(0, dtype=U64)
        if shard < 1 << bits:
            known = Known(*(unpacked_numbers(model[0]) if model else (none, [none.view(np.int64)] * p.order, none.view(np.int64))))
        else:
            steps, *sums = unsqueezed(model[0]) if model else [none] * 5
            have = np.cumsum(steps, dtype=U64)
        out = []
        for data in asks.column("data").to_pylist():
            if shard < 1 << bits:
                vocabulary, columns, _ = unpacked_numbers(data)
                got = known.tell(vocabulary, columns)
            else:
                got = values_at(have, sums, np.cumsum(unsqueezed(data)[0], dtype=U64))
            out.append(squeezed(got))
        return asks.set_column(3, "data", pa.array(out, pa.binary()))

    def score(table):
        replies = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "shard", "data", "rows")), strict=True), key=lambda x: x[:2])
        waits, rows = unsqueezed(replies[0][2]), pa.ipc.open_stream(replies[0][3]).read_all()
        chances, width = [], p.order + 1
        heavy_sums = np.concatenate([np.zeros((4, 1), dtype=np.int64), model_heavy], axis=1)
        for part in range((len(waits) - 1) // width):
            place, which, word, *far = (x.view(np.int64) for x in waits[1 + part * width :][:width])
            grams, keyed = ([np.concatenate(c).view(np.int64) for c in zip(*(unsqueezed(x[2]) for x in replies if x[0] == part and (x[1] < 1 << bits) == side), strict=True)] for side in (True, False))
            kinds, total, off = words_
            chance = np.full(len(word), 1.0 / (kinds + 1))
            if total:
                c = keyed[0][word]
                chance = (c - less(c, taken[0]) + off * chance) / total
            for k in range(p.order - 1):
                c, *sums = grams[5 * k : 5 * k + 5]
                is_heavy = which > 0
                for i, s in enumerate(sums):
                    s[is_heavy] = keyed[i][far[k - 1]] if k else heavy_sums[i][which[is_heavy]]
                off = sums[1] * taken[k + 1][0] + sums[2] * taken[k + 1][1] + sums[3] * taken[k + 1][2]
                chance = np.where(sums[0] > 0, (c - less(c, taken[k + 1]) + off * chance) / np.maximum(sums[0], 1), chance)
            chances.append(np.log10(chance)[place])
        n = waits[0].view(np.int64)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), np.concatenate(chances), minlength=len(n))
        return pa.table([*rows.columns, pa.array(n), pa.array(-sums / n)], [*extra, "n_tokens", "log10_ppl"])

    words_, taken, model_heavy, filter_ = model.words, model.taken, model.heavy_sums, model.filter
    context = docs.sparkSession.sparkContext
    docs = docs.coalesce(max(context.defaultParallelism, docs.rdd.getNumPartitions() // p.rounds))  # a task has a batch's worth of a round
    sent = docs.select(*extra, text_of().alias("text")).mapInArrow(lean_batches(send), row)
    answers = sent.groupBy("shard").cogroup(docs.sparkSession.table(model.table).groupBy("shard")).applyInArrow(lean(answer), row)
    return answers.groupBy("batch").applyInArrow(lean(score), f"{fields}, n_tokens long, log10_ppl double")


def less(c: np.ndarray, taken: list[float]) -> np.ndarray:
    """What is taken off each count."""
    return np.array([0.0, *taken])[np.minimum(c, 3)]


def classify(docs: DataFrame, trusted: DataFrame, p: QualityModel = QualityModel()) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, lang): doc_id, lang, n_tokens, log10_ppl, threshold, kept.

    `trusted` has the doc_ids of trusted rows; repeats and nulls in it count for nothing. Null text is empty: its end is all that
    is scored. A null lang is a language of its own. Without trusted rows that aren't taught on, the threshold is null and all
    rows are kept. Texts of any length are scored whole, block by block; equal texts of one language have equal verdicts. Rows that
    repeat one another are scored each. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    known = trusted.select("doc_id").where("doc_id is not null").distinct()
    rank = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(100))
    teach = known.where(rank < p.taught)
    sample, extra = taught_texts(docs, teach, p), ["doc_id", "lang"]
    model = sharded(sample, docs.select(text_of().alias("text")), p)
    if model.grams <= p.given:
        model.release(spark)
        scorer = spark.sparkContext.broadcast(Scorer(tables(count_grams(sample, p.order), p.order)))
        scored = stored(perplexities(docs, scorer, p.order, extra), "scores")
    else:
        parts = []
        for i in range(p.rounds):
            swept(spark)
            parts.append(stored(asked_perplexities(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(p.rounds)) == i), model, extra, p), "scores"))
        model.release(spark)
        swept(spark)
        scored = reduce(DataFrame.unionByName, parts)
    held = known.where(rank >= p.taught)
    limits = thresholds(scored.join(held, "doc_id", "left_semi"), p)
    general = limits.agg(F.max("general")).first()[0]  # of all languages
    named = limits.where("threshold is not null").select(F.col("lang").alias("__lang"), F.col("threshold").alias("__own"))
    limit = F.coalesce("__own", F.lit(general).cast("double"))
    joined = scored.join(named, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return joined.select("doc_id", "lang", "n_tokens", "log10_ppl", limit.alias("threshold"), F.coalesce(F.col("log10_ppl") <= limit, F.lit(True)).alias("kept"))


def thresholds(held: DataFrame, p: QualityModel) -> DataFrame:
    """(lang, threshold, general) of the held documents' (lang, log10_ppl): a row for each language with enough of them."""
    bins = held.groupBy("lang", F.ceil(F.col("log10_ppl") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    bins = stored(in_few(bins), "bins")

    def cut(part: DataFrame, *by: str) -> DataFrame:
        over = Window.partitionBy(*by) if by else Window.partitionBy()
        along = over.orderBy("bin")
        full = part.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(over))
        return full.where(F.col("upto") >= F.lit(p.quantile) * F.col("all")).groupBy(*by).agg((F.min("bin") / F.lit(1000.0)).alias("threshold"), F.max("all").alias("all"))

    each = cut(bins, "lang").where(F.col("all") >= p.few).select("lang", "threshold")
    general = cut(bins.groupBy("bin").agg(F.sum("n").alias("n"))).agg(F.max("threshold").alias("general"))
    return stored(each.withColumn("general", F.lit(None).cast("double")).unionByName(general.select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("threshold"), "general")), "limits")


def trusted_ids(labels: DataFrame) -> DataFrame:
    good: Column = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where(good).select("doc_id")
