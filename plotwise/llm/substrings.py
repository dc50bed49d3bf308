"""Substring dedup by seed and extend: repeated passages of at least `words` words, wherever they start.

Seeds. Of the 12-word grams inside each window of 35 words the least hash is its anchor (winnowing), so equal windows have the
same anchor at the same place, and about 8 % of a text's grams are anchors. Anchors are counted over the whole corpus
(pre-aggregated per batch); those met twice go into a Bloom filter of bounded size, which only saves work: an anchor it lets
through for nothing is settled exactly below.

Extension. Around each occurrence of a repeated anchor, the match is extended both ways, as far as the windows that have it
for an anchor go: their 96-bit hashes are held against all other occurrences. An occurrence's neighbours continue the match,
so runs of repeated windows are the maximal repeats, and the words under them go. No pairs are made: a passage in a third of
all documents is one entry per batch.

Exchange. A batch of documents sends its distinct window hashes to shards by hash range, packed in one row for each shard, and
gets one bit back for each; the batch itself, with its texts, waits in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .shared import stored, text_bytes

U64 = np.uint64
ENTRY = np.dtype([("h", "<u8"), ("l", "<u4")])  # the lowest bit of l: met twice in the batch
PLACE = U64((1 << 28) - 1)


@dataclass(frozen=True)
class Repeats:
    """words: length of a window. seed: words of a gram. filter_bytes: largest Bloom filter. shard_bytes: text for a shard."""

    words: int = 35
    seed: int = 12
    filter_bytes: int = 1 << 26
    shard_bytes: int = 1 << 25
    batch_bytes: int = K.BLOCK_BYTES


def anchors(hashes: np.ndarray, first: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and the grams' hashes by place."""
    n = len(hashes)
    at = np.arange(max(0, n - p.words + 1))
    at = at[at + p.words <= np.repeat(first[1:], np.diff(first))[: len(at)]]
    if not len(at):
        return at, at, np.zeros(0, dtype=U64)
    places = np.arange(n - p.seed + 1)
    grams = K.FIRST.spans(hashes, places, places + p.seed)
    least, span, width = (grams & ~PLACE) | places.astype(U64), 1, p.words - p.seed + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return at, (least[at] & PLACE).astype(np.int64), grams


def count_anchors(texts: DataFrame, p: Repeats) -> DataFrame:
    """(g, n): how often each gram is chosen for an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in K.blocks(batch.column(0)):
                w = K.words(block)
                _, where, grams = anchors(K.word_hashes(block, w), w.first, p)
                found.append(grams[np.unique(where)])
            g, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    return texts.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def bloom(keys: DataFrame, most_bytes: int) -> np.ndarray:
    """Bits of a Bloom filter with two probes over the 64-bit column g; 16 bits a key, most_bytes at most."""
    keys = stored(keys, "keys")
    bits = max(1 << 10, min(8 * most_bytes, 1 << (16 * keys.count()).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    probe = F.explode(F.array(F.shiftrightunsigned("g", shift), F.shiftrightunsigned(F.shiftleft("g", 31), shift)))
    words = keys.select(probe.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.view(U64)


def passes(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    shift = U64(64 - ((len(filter_) * 64).bit_length() - 1))
    ok = np.ones(len(keys), dtype=bool)
    for b in (keys >> shift, (keys << U64(31)) >> shift):
        ok &= (filter_[(b >> U64(6)).astype(np.int64)] >> (b & U64(63))) & U64(1) == 1
    return ok


def rebuilt(block: K.Block, w: K.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    docs = w.docs()
    last = np.zeros(len(keep), dtype=bool)
    held = np.flatnonzero(keep)
    if len(held):
        last[held[np.append(docs[held][1:] != docs[held][:-1], True)]] = True
    data = block.data.copy()
    inner = w.ends[keep & ~last]
    data[inner] = 0x20
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    edge[w.starts[keep]] += 1
    np.subtract.at(edge, w.ends[keep] + ~last[keep], 1)
    mask = np.cumsum(edge[:-1]) > 0
    upto = np.concatenate([[0], np.cumsum(mask)])
    return pa.Array.from_buffers(pa.large_string(), len(block.bounds) - 1, [None, pa.py_buffer(upto[block.bounds].astype(np.int64)), pa.py_buffer(data[mask])])


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), text: str = "text", untouched: bool = False) -> DataFrame:
    """The rows of `docs` with the kept words in `text`, joined by one space, and n_words, n_removed (long).

    Every word under a window whose words start anywhere else too, in any row, goes; windows are judged on the input. With
    `untouched`, texts that lose nothing stay byte for byte. Null text has no words and becomes empty (stays null with
    `untouched`). Rows that repeat one another all lose their windows. Other columns are carried along; those named n_words or
    n_removed are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed").withColumn(text, F.col(text).cast("string"))
    names, place = docs.columns, docs.columns.index(text)
    bits = max(2, (text_bytes(docs, text) // p.shard_bytes).bit_length() + 1)
    spark = docs.sparkSession
    filter_ = spark.sparkContext.broadcast(bloom(count_anchors(docs.select(text), p).where("n > 1").select("g"), p.filter_bytes))

    def finish(columns: list[pa.Array], block: K.Block, w: K.Words, keep: np.ndarray) -> pa.RecordBatch:
        n, gone = block.hi - block.lo, np.bincount(w.docs()[~keep], minlength=block.hi - block.lo)
        new = rebuilt(block, w, keep).cast(pa.string())
        if untouched:
            new = pa.compute.if_else(pa.array(gone > 0), new, columns[place].cast(pa.string()))
        columns = [new if i == place else x for i, x in enumerate(columns)]
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, names), pa.array(np.diff(w.first).astype(np.int64)), pa.array(gone.astype(np.int64))], ["row", "n_words", "n_removed"]) if n else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("row", pa.struct([pa.field(f.name, f.type) for f in batch.schema]))])  # nullable, as rows of another kind have none
            for block in K.blocks(batch.column(place), p.batch_bytes):
                w = K.words(block)
                hashes = K.word_hashes(block, w)
                at, where, grams = anchors(hashes, w.first, p)
                open_ = at[passes(filter_.value, grams[where])] if len(at) else at
                entries = np.zeros(len(open_), dtype=ENTRY)
                entries["h"] = K.FIRST.spans(hashes, open_, open_ + p.words)
                entries["l"] = K.SECOND.spans(K.word_hashes(block, w, K.SECOND), open_, open_ + p.words).astype(np.uint32) << np.uint32(1) if len(open_) else 0
                order = np.lexsort((entries["l"], entries["h"]))
                sorted_ = entries[order]
                new = np.ones(len(sorted_), dtype=bool)
                new[1:] = sorted_[1:] != sorted_[:-1]
                index = np.empty(len(sorted_), dtype=np.int32)
                index[order] = np.cumsum(new) - 1
                distinct = sorted_[new]
                distinct["l"] |= (np.bincount(index, minlength=len(distinct)) > 1).astype(np.uint32) if len(distinct) else 0
                # documents without an open window are done
                docs_ = np.searchsorted(w.first, open_, side="right") - 1
                busy = np.zeros(block.hi - block.lo, dtype=bool)
                busy[docs_] = True
                columns = [c.slice(block.lo, block.hi - block.lo) for c in batch.columns]
                done = finish(columns, block, w, np.ones(len(hashes), dtype=bool)).filter(pa.array(~busy))
                yield row(done, schema, kind=0)
                if not len(open_):
                    continue
                name = uuid.uuid4().bytes
                moved = np.cumsum(np.where(busy, np.diff(w.first), 0)) - np.where(busy, np.diff(w.first), 0)
                starts = (open_ - w.first[docs_] + moved[docs_]).astype(np.int32)
                pack = pa.RecordBatch.from_arrays(columns, names).filter(pa.array(busy))
                yield row(None, schema, kind=1, batch=[name], data=[packed(pack, starts, index)])
                shard = (distinct["h"] >> U64(64 - bits)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                data = [x.tobytes() for x in np.split(distinct, cut[1:])]
                yield row(None, schema, kind=2, batch=[name] * len(cut), shard=shard[cut], data=data)

    def row(done, schema, kind, batch=None, shard=None, data=None) -> pa.RecordBatch:
        n = done.num_rows if done is not None else len(batch)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, kind, dtype=np.int32)),
                pa.array(batch, pa.binary()) if batch else none(pa.binary()),
                pa.array(np.asarray(shard), pa.int64()) if shard is not None else none(pa.int64()),
                pa.array(data, pa.binary()) if data else none(pa.binary()),
                done.column(0) if done is not None else none(schema.field("row").type),
                done.column(1) if done is not None else none(pa.int64()),
                done.column(2) if done is not None else none(pa.int64()),
            ],
            ["kind", "batch", "shard", "data", "row", "n_words", "n_removed"],
        )

    def packed(batch: pa.RecordBatch, starts: np.ndarray, index: np.ndarray) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        body = sink.getvalue().to_pybytes()
        return len(starts).to_bytes(8, "little") + starts.tobytes() + index.tobytes() + body

    def settle(key, rows):  # no type hints: Spark reads them
        """One shard: which entries are met twice anywhere."""
        parts = [np.frombuffer(x, dtype=ENTRY) for x in rows.column("data").to_pylist()]
        entries = np.concatenate(parts)
        low = entries["l"] >> np.uint32(1)
        order = np.lexsort((low, entries["h"]))
        h, l = entries["h"][order], low[order]
        same = (h[1:] == h[:-1]) & (l[1:] == l[:-1])
        twice = (entries["l"] & 1).astype(bool)
        again = np.zeros(len(entries), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        # an entry that is met twice in one batch only says so itself
        twice |= again
        bits_ = np.split(twice, np.cumsum([len(x) for x in parts])[:-1])
        return pa.table({"batch": rows.column("batch"), "shard": rows.column("shard"), "bits": pa.array([b"".join([len(b).to_bytes(4, "little"), np.packbits(b).tobytes()]) for b in bits_], pa.binary())})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, replies in zip(batch.column(0), batch.column(1), strict=True):
                body = data.as_buffer()
                n = int.from_bytes(body.slice(0, 8).to_pybytes(), "little")
                starts, index = np.frombuffer(body.slice(8, 4 * n), dtype=np.int32), np.frombuffer(body.slice(8 + 4 * n, 4 * n), dtype=np.int32)
                rows = pa.ipc.open_stream(body.slice(8 + 8 * n)).read_all().combine_chunks().to_batches()[0]
                bits_ = []
                for x in sorted(replies.as_py(), key=lambda x: x["shard"]):
                    bits_.append(np.unpackbits(np.frombuffer(x["bits"][4:], dtype=np.uint8))[: int.from_bytes(x["bits"][:4], "little")])
                twice = np.concatenate(bits_).astype(bool)[index]
                for block in K.blocks(rows.column(place), 1 << 62):
                    w = K.words(block)
                    edge = np.zeros(w.first[-1] + 1, dtype=np.int32)
                    begin = starts[twice].astype(np.int64)
                    np.add.at(edge, begin, 1)
                    np.subtract.at(edge, begin + p.words, 1)
                    yield finish(rows.columns, block, w, np.cumsum(edge[:-1]) == 0)

    struct = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    field = lambda name, kind: T.StructField(name, kind, True)
    result = T.StructType([field("row", struct), field("n_words", T.LongType()), field("n_removed", T.LongType())])
    sent = T.StructType([field("kind", T.IntegerType()), field("batch", T.BinaryType()), field("shard", T.LongType()), field("data", T.BinaryType()), *result])
    held = stored(docs.mapInArrow(send, sent), "repeats")
    replies = held.where("kind = 2").select("batch", "shard", "data").groupBy("shard").applyInArrow(settle, "batch binary, shard long, bits binary")
    answers = replies.groupBy("batch").agg(F.collect_list(F.struct("shard", "bits")).alias("replies"))
    waiting = held.where("kind = 1").select("batch", "data").join(answers, "batch").select("data", "replies")
    closed = waiting.mapInArrow(close, result)
    return held.where("kind = 0").select("row", "n_words", "n_removed").unionByName(closed).select("row.*", "n_words", "n_removed")
