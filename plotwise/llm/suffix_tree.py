"""Scoring texts by a probabilistic suffix tree (Ron, Singer, Tishby 1996) over the bytes and words of normalised text.

Text is its words in lower case (A-Z), a blank after each, and an end sign; this spells every sequence of tokens in one way.

Frequent contexts, up to `depth` bytes. Such a context is a state if it is frequent (`least` of all positions) and its next-byte
distribution diverges from its parent's, the context without its first byte, by more than `gain` in the log-likelihood of the
training text, or if a longer state needs it. Each state's distribution is smoothed by its parent's (Witten-Bell), and a byte is
scored in the longest state that is a suffix of what precedes it. At most 1 / least contexts of each length are frequent, so
this part is given to all tasks.

Words. The product over a word's bytes spells any word, with regard to what precedes it; the counts of words of the whole corpus,
a table in shards, know rare words better. A word has the mean of the two, weighted by `spelt` for its spelling.

Rare contexts, a whole word. A word that is met less than `few` times, or less often than `heavy` of all tokens, is a state if the
words after it diverge from the counts of words by more than `gain`, each occurrence judged by the others (leaving one out, so
that a chance pair tells nothing). There is no cut by frequency: a context met twice is a state if it tells enough, and the
states, a table in shards, grow with the corpus. Their counts are discounted by `discount` and smoothed by those of words.

Common contexts. With `common`, every other word is a context by the same test, and so is the beginning of a text. There are
1 / heavy of them at most, so those that are states are given to all tasks; their pairs are counted in packed shards, over which
a context with more than a shard's share of all tokens is spread. These shards, as they were counted, are what is asked.

For comparison each text also gets the score of add-one counts of tokens. Words with at least `heavy` of all tokens, 1 / heavy
at most, are looked up where the document is. Other words, states and their pairs are asked for in packed requests of distinct
keys, one for each batch of documents and shard, and answered by one count for each. A pair of words that are both known where the
document is is one number of their places. A Bloom filter of bounded size saves asking for most contexts that are no states; what it
lets through for nothing is settled by the answer. Documents go in `rounds`, so that the places that wait for answers and the requests
of so large a part of them are on disk at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .quality_model import in_few, squeezed, summed, unsqueezed, values_at
from .shared import lean, lean_batches, release, stored, swept, text_bytes, text_of, trimmed
from .substrings import bloom, passes

U64 = np.uint64
END_BYTE, BLANK, LN10 = 0x0A, 0x20, float(np.log(10.0))
END_WORD = int(K.mix(np.array([0xE0D], dtype=U64))[0])
TOTAL, KINDS = (int(x) for x in K.mix(np.array([0x707, 0x817], dtype=U64)).view(np.int64))  # keys of a state's two counts: its hash with these


@dataclass(frozen=True)
class SuffixTree:
    depth: int = 5
    least: float = 2e-6
    gain: float = 20.0
    heavy: float = 1e-6
    few: int = 20
    discount: float = 0.75
    spelt: float = 0.5
    common: bool = False
    filter_bytes: int = 1 << 25
    shard_bytes: int = 1 << 25
    batch_bytes: int = 1 << 22
    rounds: int = 3


def spelled(block: K.Block, w: K.Words, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes with `depth` end signs before each document, the places to be scored, and the place after each token."""
    data = np.where((block.data >= 65) & (block.data <= 90), block.data + 32, block.data).astype(np.uint8)
    n, docs = len(w.first) - 1, w.docs()
    sizes = w.ends - w.starts + 1
    token_doc = np.concatenate([docs, np.arange(n)])
    order = np.argsort(token_doc, kind="stable")  # words in order, then the document's end
    token_size = np.concatenate([sizes, np.ones(n, dtype=sizes.dtype)])[order]
    token_doc = token_doc[order]
    close = np.cumsum(token_size) + (token_doc + 1) * depth
    out = np.full(int(token_size.sum()) + n * depth, END_BYTE, dtype=np.uint8)
    word = np.flatnonzero(order < len(sizes))
    before, each = np.cumsum(sizes) - sizes, np.arange(sizes.sum())
    out[each + np.repeat(close[word] - token_size[word] - before, sizes)] = np.append(data, 0)[each + np.repeat(w.starts - before, sizes)]
    out[close[word] - 1] = BLANK
    scored = np.ones(len(out), dtype=bool)
    begin = np.concatenate([[0], close[np.cumsum(np.bincount(token_doc, minlength=n))[:-1] - 1]]) if n else np.zeros(0, dtype=np.int64)
    for k in range(depth):
        scored[begin + k] = False
    return out, np.flatnonzero(scored), close


def grams(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes that end at each place, as a number."""
    key = np.zeros(len(data), dtype=np.int64)
    for k in range(size):
        key[k:] |= data[: len(data) - k].astype(np.int64) << (8 * k)
    return key[at]


def tokens_of(block: K.Block, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each document included, and their documents."""
    n = len(w.first) - 1
    doc = np.concatenate([w.docs(), np.arange(n)])
    order = np.argsort(doc, kind="stable")
    return np.concatenate([K.word_hashes(block, w, lower=True), np.full(n, END_WORD, dtype=U64)])[order], doc[order]


def counts(texts: DataFrame, p: SuffixTree) -> DataFrame:
    """(kind, key, n): how often each token (kind 0) and each gram of depth + 1 bytes (kind 1) occurs."""

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = map(np.concatenate, zip(*parts, strict=True))
        keys, _, (n,) = summed(keys, [n])
        return keys, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def waiting() -> int:
            return sum(len(k) for parts in held for k, _ in parts)

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    keys, n = added(held[kind])
                    held[kind].clear()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for batch in batches:
            for block in K.blocks(batch.column(0)):
                w = K.words(block)
                data, at, _ = spelled(block, w, p.depth)
                for kind, found in ((0, tokens_of(block, w)[0]), (1, grams(data, at, p.depth + 1))):
                    held[kind].append(np.unique(found, return_counts=True))
                del w, data, at, found
                if waiting() > 3 << 19:
                    for parts in held:
                        parts[:] = [added(parts)] if parts else []
                    trimmed()
                    if waiting() > 1 << 20:
                        yield from flush()
        yield from flush()

    return texts.mapInArrow(lean_batches(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Tree:
    """States and counts by depth; scores grams. The shallow states, as many as fit in `cells`, have a row with a cell for each byte of the
    training text (0: any other): their children, and the chance of that byte. What may have a deeper state is looked up in sorted grams."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], p: SuffixTree, cells: int = 1 << 23):
        """levels[d]: sorted grams of d context bytes and a next byte, with counts, of all frequent contexts."""
        self.states = []
        for d, (keys, n) in enumerate(levels):
            contexts, at, kinds = np.unique(keys >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(n, at) if len(n) else n
            self.states.append((contexts, total, kinds, keys, n))
        keep: list[np.ndarray] = [np.ones(len(s[0]), dtype=bool) for s in self.states]
        for d in range(p.depth, 0, -1):
            contexts, total, kinds, keys, n = self.states[d]
            if not len(contexts):
                continue
            up_contexts, up_total, _, up_keys, up_n = self.states[d - 1]
            mask = (1 << (8 * d)) - 1
            own = n / np.repeat(total, kinds)
            up_at = np.searchsorted(up_keys, keys & mask)
            up = up_n[up_at] / up_total[np.searchsorted(up_contexts, (keys & mask) >> 8)]
            where = np.cumsum(kinds) - kinds
            divergence = np.add.reduceat(n * np.log(own / up), where)
            keep[d] = divergence >= p.gain
            if d < p.depth and len(self.states[d + 1][0]):
                deeper = self.states[d + 1][0][keep[d + 1]]
                keep[d] |= np.isin(contexts, deeper & ((1 << (8 * d)) - 1))
        self.keep = [c[0][k] for c, k in zip(self.states, keep, strict=True)]
        self.states = [self.cut(s, k) for s, k in zip(self.states, keep, strict=True)]
        self.spread(p.depth, cells)

    def spread(self, depth: int, cells: int) -> None:
        """Rows of the states, shallow ones first; row 0 is for what is no state. children holds where a row begins."""
        known = np.union1d(self.states[0][3] & 0xFF, [END_BYTE])
        self.code = np.zeros(256, dtype=np.int64)
        self.code[known] = np.arange(1, len(known) + 1)
        self.width, self.depth, self.walked = len(known) + 1, depth, 0
        rows = 1 + np.cumsum([len(s[0]) for s in self.states])
        while self.walked < depth and rows[self.walked + 1] * self.width <= cells:
            self.walked += 1
        self.children = np.zeros((rows[self.walked], self.width), dtype=np.int32)
        chance = np.full((1, self.width), 1 / 256.0)
        chances, base = [np.log10(chance)], 1
        for d, (contexts, total, kinds, keys, n) in enumerate(self.states[: self.walked + 1]):
            up = np.zeros(len(contexts), dtype=np.int64)
            if d and len(contexts):
                up = np.searchsorted(self.states[d - 1][0], contexts & (1 << (8 * (d - 1))) - 1)
                self.children[base - len(self.states[d - 1][0]) + up, self.code[contexts >> (8 * (d - 1))]] = (base + np.arange(len(contexts))) * self.width
            seen = np.zeros((len(contexts), self.width))
            seen[np.repeat(np.arange(len(contexts)), kinds), self.code[keys & 0xFF]] = n
            chance = (seen + kinds[:, None] * chance[up]) / (total + kinds)[:, None]
            chances.append(np.log10(chance))
            self.deep, base = base * self.width, base + len(contexts)
        self.chances = np.concatenate(chances).ravel()
        self.children = self.children.ravel()

    def scores(self, data: np.ndarray, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """log10 of the probability of the byte at each of these places, which have `depth` bytes before them. From the byte before it
        backwards, the deepest state's row is the last one, as rows come by depth."""
        codes, out, deeper = self.code[data], np.zeros(len(data)), []
        for lo in range(self.depth, len(data), step):
            hi = min(len(data), lo + step)
            row = np.full(hi - lo, self.width if len(self.states[0][0]) else 0, dtype=np.int64)
            deepest = row
            for k in range(1, self.walked + 1):
                row = self.children[row + codes[lo - k : hi - k]].astype(np.int64)
                deepest = np.maximum(deepest, row)
            out[lo:hi] = self.chances[deepest + codes[lo:hi]]
            if self.walked < self.depth:
                deeper.append(np.flatnonzero(deepest >= self.deep) + lo)
        if any(map(len, deeper)):
            more = np.concatenate(deeper)
            distinct, which = np.unique(grams(data, more, self.depth + 1), return_inverse=True)
            out[more] = self.log10(distinct)[which]
        return out[at]

    @staticmethod
    def cut(state, keep):
        contexts, total, kinds, keys, n = state
        some = np.repeat(keep, kinds)
        return contexts[keep], total[keep], kinds[keep], keys[some], n[some]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its context."""
        chance = np.full(len(keys), 1 / 256.0)
        for d, (contexts, total, kinds, grams_, n) in enumerate(self.states):
            if not len(contexts):
                break
            gram = keys & ((1 << (8 * (d + 1))) - 1)
            at = np.minimum(np.searchsorted(contexts, gram >> 8), len(contexts) - 1)
            is_state = contexts[at] == gram >> 8
            g = np.minimum(np.searchsorted(grams_, gram), len(grams_) - 1)
            seen = np.where(grams_[g] == gram, n[g], 0)
            chance = np.where(is_state, (seen + kinds[at] * chance) / (total[at] + kinds[at]), chance)
        return np.log10(chance)


def grown(grams_: DataFrame, p: SuffixTree) -> Tree:
    """The tree of the counted grams (key, n). The driver gets the frequent contexts' distributions, a bounded number."""
    each = F.explode(F.array([F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("key")) for d in range(p.depth + 1)]))
    levels = grams_.select(each.alias("g"), "n").groupBy("g.d", "g.key").agg(F.sum("n").alias("n"))
    levels = stored(in_few(levels, grams_.rdd.getNumPartitions()), "levels")
    total = levels.where("d = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    frequent = levels.groupBy("d", F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("c")).where(F.col("c") >= F.lit(p.least * total)).select("d", "context")
    known = levels.alias("l").join(frequent.alias("f"), (F.col("l.d") == F.col("f.d")) & (F.shiftright("l.key", 8) == F.col("f.context"))).select("l.d", "l.key", "l.n")
    got = known.toArrow()
    release(levels)
    d, key, n = (got.column(i).to_numpy() for i in range(3))
    out = []
    for depth in range(p.depth + 1):
        k, c = key[d == depth], n[d == depth]
        order = np.argsort(k)
        out.append((k[order], c[order]))
    return Tree(out, p)


@dataclass(frozen=True)
class Often:
    """Words with at least `heavy` of all tokens: sorted hashes and counts; words under `limit` are rare contexts, the others common
    ones. kinds: how many different tokens follow a common context, 0 if it is no state."""

    keys: np.ndarray
    n: np.ndarray
    limit: float
    kinds: np.ndarray | None = None

    def __post_init__(self):
        bits = max(1, 2 * len(self.keys)).bit_length()  # keys are hashes, so each of so many ranges has a few at most
        object.__setattr__(self, "shift", U64(64 - bits))
        object.__setattr__(self, "begin", np.searchsorted(self.keys >> self.shift, np.arange(1 << bits, dtype=U64)))

    def place(self, token: np.ndarray) -> np.ndarray:
        """As np.searchsorted(), but at most the last place."""
        last = len(self.keys) - 1
        place = np.minimum(self.begin[(token >> self.shift).astype(np.int64)], last)
        open_ = np.flatnonzero(self.keys[place] < token)
        while len(open_):
            place[open_] += 1
            open_ = open_[place[open_] <= last]
            open_ = open_[self.keys[place[open_]] < token[open_]]
        return np.minimum(place, last)

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each token here, whether it is here, and whether it is a common one."""
        if not len(self.keys):
            return np.zeros(len(token), dtype=np.int64), np.zeros(len(token), dtype=bool), np.zeros(len(token), dtype=bool)
        place = self.place(token)
        here = self.keys[place] == token
        return place, here, here & (self.n[place] >= self.limit)


def contexts(token: np.ndarray, often: Often, found: tuple, p: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token before each one (the end sign before a document's first), whether it is a rare context, and the place in `often` of a
    common one, else -1. `found` is what often.find() tells of the tokens."""
    first = often.find(np.array([END_WORD], dtype=U64))
    before = np.concatenate([[U64(END_WORD)], token[:-1]]).astype(U64)
    place, _, common = (np.concatenate([x, y[:-1]]) for x, y in zip(first, found, strict=True))
    if p.common:
        return before, ~common, np.where(common, place, -1)
    return before, ~common & (before != U64(END_WORD)), np.full(len(token), -1)


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return token ^ (context << U64(1) | context >> U64(63))


def pairs(texts: DataFrame, often, p: SuffixTree) -> DataFrame:
    """(context, next, n) in parts: how often a token follows a rare context. `often` is a broadcast."""

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        context, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, at, n = np.unique(pair_keys(context, token), return_index=True, return_counts=True)
        return context[at], token[at], n.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                context, token, n = summed(held)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(token.view(np.int64)), pa.array(n)], ["context", "next", "n"])

        for batch in batches:
            for block in K.blocks(batch.column(0)):
                token, _ = tokens_of(block, K.words(block))
                context, some, _ = contexts(token, often.value, often.value.find(token), p)
                held.append((context[some], token[some]))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(lean_batches(run), "context long, next long, n long")


def pair_shards(context: np.ndarray, key: np.ndarray, often: Often, limit: int, bits: int) -> np.ndarray:
    """The shard of each pair of a common context (its place): contexts met more than `limit` times are dealt to all by the pair."""
    context = context.astype(np.int64)
    return (K.mix(np.where(often.n[context] > limit, key, context.astype(U64))) >> U64(64 - bits)).astype(np.int64)


def near_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Pairs of two words of `often`, by their places, as one number."""
    return context.astype(U64) << U64(32) | token.astype(U64)


def steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=U64(0))


def common_states(texts: DataFrame, often, total: int, limit: int, bits: int, p: SuffixTree) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Places in `often` (a broadcast) of the common contexts that are states, how many different tokens follow each, and (shard, data): all
    pairs of common contexts, packed.

    The test is that of states(). All pairs are counted: sorted in packed shards, a batch's share of a shard in one row. Pairs of two
    words of `often` are one number; for others the pair's hash goes with the context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            near, n = np.unique(np.concatenate([x for x, _ in held]), return_counts=True)
            far = np.concatenate([x for _, x in held], axis=1)
            held.clear()
            _, at, m = np.unique(far[1], return_index=True, return_counts=True)
            far = far[:, at]
            parts = []
            for context, key, count in ((near >> U64(32), near, n), (far[0], far[1], m)):
                shard = pair_shards(context, key, often.value, limit, bits)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
                parts.append((context[order], key[order], count[order], cut))
            for i in range(1 << bits):
                data = []
                for k, (context, key, count, cut) in enumerate(parts):
                    lo, hi = cut[i], cut[i + 1]
                    data += [steps(key[lo:hi]), count[lo:hi], *[context[lo:hi]] * k]
                if len(data[0]) or len(data[2]):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([squeezed(data)], pa.binary())], ["shard", "data"])

        for batch in batches:
            for block in K.blocks(batch.column(0)):
                token, _ = tokens_of(block, K.words(block))
                found = often.value.find(token)
                before, _, context = contexts(token, often.value, found, p)
                near, far = (context >= 0) & found[1], (context >= 0) & ~found[1]
                held.append((near_keys(context[near], found[0][near]), np.stack([context[far].astype(U64), pair_keys(before[far], token[far])])))
                if sum(len(x) + y.shape[1] for x, y in held) > 1 << 21:
                    yield from flush()
        if held:
            yield from flush()

    least = max(1.0, p.heavy * total)
    names = ["place", "kinds", "told", "once", "shard", "data"]

    def tell(table):  # no type hints: Spark reads them
        parts = [unsqueezed(x) for x in table.column("data").to_pylist()]
        share, sums = np.append(often.value.n, least) / max(1, total), np.zeros((3, len(often.value.keys)))
        counted = []
        for k, width in enumerate((2, 3)):
            columns = [x[2 * k : 2 * k + width] for x in parts]
            key = np.concatenate([np.cumsum(x[0], dtype=U64) for x in columns])
            n, *more = (np.concatenate(x) for x in zip(*(x[1:] for x in columns), strict=True))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            key, n = key[first], np.add.reduceat(n[order].view(np.int64), first) if len(first) else n.view(np.int64)
            counted += [steps(key), n]
            context = (more[0][order][first] if k else key >> U64(32)).astype(np.int64)
            up = share[-1] if k else share[(key & U64(0xFFFFFFFF)).astype(np.int64)]
            again = np.where(n > 1, n * (np.log(np.maximum(n - 1, 1) - p.discount) - np.log(up)), 0.0)
            for i, x in enumerate((np.ones(len(n)), again, (n == 1).astype(float))):
                sums[i] += np.bincount(context, x, minlength=sums.shape[1])
        some = np.flatnonzero(sums[0])
        none = [None] * len(some)
        columns = (some, sums[0][some].astype(np.int64), sums[1][some], sums[2][some].astype(np.int64))
        told = [pa.concat_arrays([pa.array(x), pa.nulls(1, pa.array(x).type)]) for x in columns]
        return pa.table([*told, pa.array([*none, table.column("shard")[0].as_py()], pa.int64()), pa.array([*none, squeezed(counted)], pa.binary())], names)

    told = texts.mapInArrow(lean_batches(run), "shard long, data binary").groupBy("shard").applyInArrow(lean(tell), "place long, kinds long, told double, once long, shard long, data binary")
    told = stored(in_few(told, (1 << bits) // 4), "common")
    got = told.where("data is null").groupBy("place").agg(*(F.sum(c).alias(c) for c in names[1:4])).toArrow()
    place, kinds, told_, once = (got.column(i).to_numpy() for i in range(4))
    whole = often.value.n[place]  # a token follows every one
    gain = told_ - (whole - once) * np.log(np.maximum(whole - 1, 1)) + once * np.log(p.discount * kinds / whole)
    keep = (whole > 1) & (gain >= p.gain)
    return place[keep], kinds[keep], told.where("data is not null").select("shard", "data")


def states(parts: DataFrame, often: DataFrame, total: int, p: SuffixTree) -> DataFrame:
    """(context, next, n, total, kinds) of all rare contexts that are states.

    A pair met n times gains, leaving one out, n * log of ((n - 1 - discount) / (total - 1)) over the next word's share of all tokens;
    pairs met once lose the log of what the discount leaves. Words that are not in `often` (word, n; 1 / heavy rows at most) count as
    if they were just too rare for it, so the gain is never put too high. A rare context has a bounded share of all rows.
    """
    least = max(1.0, p.heavy * total)
    each = parts.repartition("context").groupBy("context", "next").agg(F.sum("n").alias("n"))
    up = F.coalesce(F.col("c"), F.lit(least)) / F.lit(max(1, total))
    each = each.join(F.broadcast(often.select(F.col("word").alias("next"), F.col("n").alias("c"))), "next", "left")
    again = F.when(F.col("n") > 1, F.col("n") * (F.log(F.col("n") - 1 - p.discount) - F.log(up)))
    along = Window.partitionBy("context")
    found = each.select(
        "context", "next", "n", F.sum("n").over(along).alias("total"), F.count("*").over(along).alias("kinds"),
        F.sum(again).over(along).alias("told"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).over(along).alias("once"),
    )
    gain = F.col("told") - (F.col("total") - F.col("once")) * F.log(F.col("total") - 1) + F.col("once") * F.log(p.discount * F.col("kinds") / F.col("total"))
    return found.where((F.col("total") > 1) & (gain >= p.gain)).select("context", "next", "n", "total", "kinds")


def score_texts(docs: DataFrame, train: Column, p: SuffixTree = SuffixTree()) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the model's log10 probability of the text, base_score that of add-one counts of tokens.

    `train` is a condition; the rows that meet it (a null is no) teach the counts and the tree, all rows are scored. Null text is empty: one token, the end. Without training rows base_score is 0 and all
    bytes are equally likely. Rows that repeat one another teach and are scored each. An empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", (~F.coalesce(train, F.lit(False))).alias("held_out"), text_of().alias("text"))
    n_bytes = text_bytes(texts)
    files = n_bytes // p.shard_bytes  # at least, of a table that grows with the corpus
    learnt = stored(in_few(counts(texts.where("not held_out").select("text"), p), files), "counts")
    words = learnt.where("kind = 0").select(F.col("key").alias("word"), "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(size["n"]), int(size["v"])
    frequent = words.where(F.col("n") >= F.lit(max(1.0, p.heavy * total)))  # 1 / heavy rows at most
    got = frequent.toArrow()
    keys = got.column("word").to_numpy().view(U64)
    order = np.argsort(keys)
    spark = docs.sparkSession
    context = spark.sparkContext
    bits = max(2, (n_bytes // p.shard_bytes).bit_length() + 1)
    limit = total >> bits  # common contexts above it are dealt to all shards, the others to one
    taught = texts.where("not held_out").select("text")
    often = context.broadcast(Often(keys[order], got.column("n").to_numpy()[order], max(p.few, p.heavy * total)))
    long_ = stored(in_few(states(pairs(taught, often, p), frequent, total, p), files), "states")
    models = []
    if p.common:
        place, followed, model = common_states(taught, often, total, limit, bits, p)
        if len(place):
            kinds_ = np.zeros(len(keys), dtype=np.int64)
            kinds_[place] = followed
            often = context.broadcast(Often(often.value.keys, often.value.n, often.value.limit, kinds_))
            models.append(model)
    filter_ = bloom(in_few(long_.select(F.col("context").alias("g")).distinct(), files), p.filter_bytes)
    shared = context.broadcast((grown(learnt.where("kind = 1").select("key", "n"), p), filter_))
    unit = np.log10(total + kinds + 1)
    row = "batch binary, shard long, data binary, rows binary"
    names = ["batch", "shard", "data", "rows"]

    def by_shard(shard: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by shard, the index of each key in it, and where shards begin."""
        by = np.argsort(shard, kind="stable")
        at = np.empty(len(by), dtype=np.int64)
        at[by] = np.arange(len(by))
        return by, at[index], np.searchsorted(shard[by], np.arange((1 << bits) + 1))

    def asked(batch: pa.RecordBatch, block: K.Block) -> pa.RecordBatch:
        """What waits for answers, and the requests, of a block of documents."""
        tree, known_contexts = shared.value
        parts = [scored(b, tree, often.value, known_contexts) for b in K.parts(block)]
        n_tokens, known, base, score, n_near, near, near_spelling, n_open, spelling, place, token, before, state, given = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        trimmed()
        # what to ask for: pairs of two known words; pairs of a known and an unknown one; by hash the words that are not known, and
        # for a word after a possible rare state the pair and the state's counts
        near, index = np.unique(near, return_inverse=True)
        by, index, cuts = by_shard(pair_shards(near >> U64(32), near, often.value, limit, bits), index)
        near = near[by]
        some = np.flatnonzero(state & (given >= 0))
        far, first, far_index = np.unique(pair_keys(before[some], token[some]), return_index=True, return_inverse=True)
        by, far_index, far_cuts = by_shard(pair_shards(given[some][first], far, often.value, limit, bits), far_index)
        far = far[by]
        rare, at = np.flatnonzero(place < 0), np.flatnonzero(state & (given < 0))
        keys_ = [token[rare], pair_keys(before[at], token[at]), *(before[at] ^ np.array(k, dtype=np.int64).view(U64) for k in (TOTAL, KINDS))]
        hashed, number = np.unique(np.concatenate(keys_), return_inverse=True)
        hash_cuts = np.searchsorted((hashed >> U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        word, pair = -1 - place.astype(np.int64), np.full(len(place), -1)  # below 0: the place among frequent words; no state
        word[rare], pair[some] = number[: len(rare)], far_index
        pair[at], *counts_ = number[len(rare) :].reshape(3, -1)
        given = np.where(state, given, -1)
        waiting = [n_near, index, near_spelling.view(np.uint32), np.diff((near >> U64(32)).astype(np.int64), prepend=0), near & U64(0xFFFFFFFF), n_open, spelling.view(np.uint32), word, pair, given, *counts_]
        out = [(-1 - int(n_tokens.sum()) % (1 << bits), squeezed(waiting))]
        for i in range(1 << bits):
            data = [steps(near[cuts[i] : cuts[i + 1]]), steps(far[far_cuts[i] : far_cuts[i + 1]])]
            if len(data[0]) or len(data[1]):
                out.append((i, squeezed(data)))
            if hash_cuts[i] < hash_cuts[i + 1]:
                out.append(((1 << bits) + i, squeezed([steps(hashed[hash_cuts[i] : hash_cuts[i + 1]])])))
        rows = pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), batch.column(1).slice(block.lo, block.hi - block.lo), *map(pa.array, (n_tokens, known, base, score))], ["doc_id", "held_out", "n_tokens", "known", "base", "score"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows)
        shards, data = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes] * len(out), pa.binary()), pa.array(shards, pa.int64()), pa.array(data, pa.binary()), pa.array([sink.getvalue().to_pybytes(), *[None] * (len(out) - 1)], pa.binary())], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column(2), p.batch_bytes):
                yield asked(batch, block)

    def smoothed(count: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """log10 of a word's probability by its share of all tokens and its spelling."""
        if not total:
            return spelling
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(count) + np.log((1 - p.spelt) / total), np.log(p.spelt) + spelling * LN10) / LN10

    def scored(block: K.Block, tree: Tree, often: Often, known_contexts: np.ndarray) -> tuple:
        w = K.words(block)
        n = block.hi - block.lo
        data, at, close = spelled(block, w, p.depth)
        each = np.zeros(len(data) + 1)
        each[at + 1] = tree.scores(data, at)
        upto = np.cumsum(each)
        token, doc = tokens_of(block, w)
        begin = np.concatenate([[0], close[:-1]])  # the signs before a document score 0
        lp = upto[close] - upto[begin]
        del data, at, each, upto
        place, here, common = often.find(token)
        before, rare, given = contexts(token, often, (place, here, common), p)
        state = rare.copy()
        state[rare] = passes(known_contexts, before[rare])
        near = np.zeros(len(token), dtype=bool)
        if often.kinds is not None:
            known_state = (given >= 0) & (often.kinds[given] > 0)
            state |= known_state
            near = known_state & here
        n_tokens = np.bincount(doc, minlength=n).astype(np.int64)
        known = np.bincount(doc[here], minlength=n).astype(np.int64)
        c = often.n[place[here]] if here.any() else np.zeros(0, dtype=np.int64)
        base = np.bincount(doc[here], np.log10(c + 1.0), minlength=n) - n_tokens * unit
        done = here & ~state
        score = np.bincount(doc[done], smoothed(c[done[here]], lp[done]), minlength=n)
        open_, lp = ~done & ~near, lp.astype(np.float32)
        waiting = (lp[open_], np.where(here, place, -1)[open_], token[open_], before[open_], state[open_], given[open_])
        return n_tokens, known, base, score, np.bincount(doc[near], minlength=n), near_keys(given[near], place[near]), lp[near], np.bincount(doc[open_], minlength=n), *waiting

    def answer(table):  # no type hints: Spark reads them
        shard, own = table.column("shard")[0].as_py(), table.column("batch").is_null()
        if shard < 0:
            return table.select(names)
        data, asks = table.filter(own).column("data").to_pylist(), table.filter(pc.invert(own))
        have = unsqueezed(data[0]) if data else [np.zeros(0, dtype=U64)] * 4
        sections = [(np.cumsum(have[i], dtype=U64), have[i + 1]) for i in range(0, len(have), 2)]
        out = [squeezed([values_at(k, [n], np.cumsum(x, dtype=U64))[0] for x, (k, n) in zip(unsqueezed(data), sections, strict=False)]) for data in asks.column("data").to_pylist()]
        return asks.select(names).set_column(2, "data", pa.array(out, pa.binary()))

    def close_(table):
        replies = sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "data", "rows")), strict=True), key=lambda x: x[0])
        waits, rows = [x.view(np.int64) for x in unsqueezed(replies[0][1])], pa.ipc.open_stream(replies[0][2]).read_all().combine_chunks().to_batches()[0]
        n_near, index, near_spelling, context, near_word, n_open, spelling, word, pair, given, *states_ = waits
        near_spelling, spelling = (x.astype(np.uint32).view(np.float32).astype(np.float64) for x in (near_spelling, spelling))
        got = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
        for shard, data, _ in replies[1:]:
            for i, x in enumerate(unsqueezed(data)):
                got[i if shard < 1 << bits else 2].append(x.view(np.int64))
        near, far, found = map(np.concatenate, got)
        n_docs = rows.num_rows
        score = rows.column(5).to_numpy()
        if len(near):
            context = np.cumsum(context)
            whole, others = often.value.n[context], p.discount * often.value.kinds[context]
            own = (np.maximum(near - p.discount, 0) + others * (1 - p.spelt) / total * often.value.n[near_word]) / whole
            chance = np.log10(own[index] + (others * p.spelt / whole)[index] * 10.0**near_spelling)
            score = score + np.bincount(np.repeat(np.arange(n_docs), n_near), chance, minlength=n_docs)
        doc, rare = np.repeat(np.arange(n_docs), n_open), word >= 0
        c = np.zeros(len(word), dtype=np.int64)
        c[rare], c[~rare] = found[word[rare]], often.value.n[-1 - word[~rare]]
        known = rows.column(3).to_numpy() + np.bincount(doc[rare & (c > 0)], minlength=n_docs)
        base = rows.column(4).to_numpy() + np.bincount(doc[rare], np.log10(c[rare] + 1.0), minlength=n_docs)
        chance = smoothed(c, spelling)
        after, common = pair >= 0, given >= 0
        n, whole, others = (np.zeros(len(word), dtype=np.int64) for _ in range(3))
        n[common] = far[pair[common]]
        if common.any():
            whole[common], others[common] = often.value.n[given[common]], often.value.kinds[given[common]]
        others_ = after & ~common
        n[others_], whole[others_], others[others_] = found[pair[others_]], *(found[i] for i in states_)
        at = np.flatnonzero(whole > 0)
        with np.errstate(divide="ignore"):
            chance[at] = np.logaddexp(np.log(np.maximum(n[at] - p.discount, 0)), np.log(p.discount * others[at]) + chance[at] * LN10) / LN10 - np.log10(whole[at])
        score = score + np.bincount(doc, chance, minlength=n_docs)
        return pa.table([*rows.columns[:3], *map(pa.array, (known.astype(np.int64), np.full(n_docs, total), base, score))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def pack(table):
        keys = table.column("word").to_numpy().view(U64)
        order = np.argsort(keys)
        return pa.table([table.column("shard")[:1], pa.array([squeezed([steps(keys[order]), table.column("n").to_numpy()[order]])], pa.binary())], ["shard", "data"])

    turned = F.shiftleft("context", 1).bitwiseOR(F.shiftrightunsigned("context", 63))
    key = lambda name, n: F.struct(name.alias("word"), F.col(n).alias("n"))
    per_state = long_.groupBy("context").agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"))
    per_state = per_state.select(F.explode(F.array(*(key(F.col("context").bitwiseXOR(F.lit(k)), n) for k, n in ((TOTAL, "total"), (KINDS, "kinds"))))).alias("x")).select("x.*")
    table = words.unionByName(long_.select(F.col("next").bitwiseXOR(turned).alias("word"), "n")).unionByName(per_state).withColumn("shard", F.shiftrightunsigned("word", 64 - bits) + F.lit(1 << bits))
    hashed = stored(in_few(table.groupBy("shard").applyInArrow(lean(pack), "shard long, data binary"), files), "hashed")
    release(learnt, long_)
    model = reduce(DataFrame.unionByName, models, hashed)
    model = model.select(F.lit(None).cast("binary").alias("batch"), "shard", "data", F.lit(None).cast("binary").alias("rows"))
    rounds = p.rounds if n_bytes > p.rounds * p.batch_bytes else 1
    results = []
    for i in range(rounds):
        if rounds > 1:
            swept(spark)
        part = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rounds)) == i)
        part = part.coalesce(max(context.defaultParallelism, part.rdd.getNumPartitions() // rounds))  # a task has a batch's worth of a round
        answers = part.mapInArrow(lean_batches(send), row).unionByName(model).groupBy("shard").applyInArrow(lean(answer), row).where("batch is not null")
        scores = answers.groupBy("batch").applyInArrow(lean(close_), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        results.append(stored(in_few(scores, files // rounds), "scores"))
    release(*models, hashed)
    if rounds > 1:
        swept(spark)
    return reduce(DataFrame.unionByName, results)
