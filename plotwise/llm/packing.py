"""Best-fit packing of documents into sequences, by best-two-fit.

A bin is filled greedily with the longest documents that fit; then its smallest document is replaced by two unpacked ones if
they fit the gap that this leaves more tightly. Only lengths matter for this, and there are at most `size` of them, so the plan
is made from the histogram of lengths: as long as no length runs out, the next bin is filled as the last one was, and a bin's
pattern is taken as often as the counts allow. The plan has about one pattern for each length. Pieces then take their place by
their rank among the pieces of their length; ranks are counted in `lanes` lanes for each length, so that a length that a third
of all pieces has is dealt out evenly.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import stored, text_of
from .tokens import encoder, with_end


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Packing:
    """size: tokens of a sequence. end: id after each document. lanes: see above. path: vocabulary file, on all machines."""

    size: int = 1024
    end: int = 2
    lanes: int = 64
    path: str = field(default_factory=vocabulary)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths in order) for bins of `size` that hold `counts[length]` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: Counter[int] = Counter()
        bin_, gap = [], size

        def best(room: int, used=used) -> int:
            i = bisect_right(lengths, room)
            while i and left[lengths[i - 1]] <= used[lengths[i - 1]]:
                i -= 1
            return lengths[i - 1] if i else 0

        while n := best(gap):
            bin_.append(n)
            used[n] += 1
            gap -= n
        if gap:
            small = bin_[-1]
            used[small] -= 1
            pair = best_two(lengths, left, used, small + gap, small)
            if pair:
                bin_[-1:] = pair
                used.update(pair)
            else:
                used[small] += 1
        used = +used
        times = min(left[n] // c for n, c in used.items())
        out.append((times, bin_))
        for n, c in used.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n]]
    return out


def best_two(lengths: list[int], left: dict[int, int], used: Counter[int], room: int, more: int) -> list[int] | None:
    """Two free lengths with the largest sum over `more` and up to `room`."""
    free = [n for n in lengths if n < room and left[n] > used[n]]
    best, i, j = None, 0, len(free) - 1
    while i <= j:
        total = free[i] + free[j]
        if total > room or (i == j and left[free[i]] < used[free[i]] + 2):
            j -= 1
            continue
        if total > more:
            best, more = [free[j], free[i]], total
        i += 1
    return best


def pieces_of(docs: DataFrame, p: Packing) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, lane): each document's ids and the end, cut if they are more than p.size."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(p.path)
        for batch in batches:
            for block in K.blocks(batch.column(1), 1 << 19):
                ids, bounds = with_end(*own.encode(block), p.end)
                total = np.diff(bounds)
                n = -(-total // p.size)
                doc = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = (total - (n - 1) * p.size)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * p.size)
                length = np.where(piece == 0, head, p.size)
                raw, at = ids.astype("<u4"), bounds[doc] + start
                crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)], dtype=np.int64)
                lane = (K.mix(crc.view(np.uint64) + at.astype(np.uint64)) % np.uint64(p.lanes)).astype(np.int32)
                numbers = [pa.array(x) for x in (piece.astype(np.int32), start.astype(np.int64), length.astype(np.int64), crc, lane)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo).take(pa.array(doc)), *numbers], ["doc_id", "piece", "start", "length", "ids_crc32", "lane"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, lane int")


def pack(pieces: DataFrame, p: Packing) -> DataFrame:
    """`pieces` with sequence_id and offset. The driver gets the histogram: p.size x p.lanes numbers at most."""
    counted = pieces.groupBy("length", "lane").agg(F.count("*").alias("n")).collect()
    by = np.zeros((p.size + 1, p.lanes), dtype=np.int64)
    for r in counted:
        by[r["length"], r["lane"]] = r["n"]
    before = np.cumsum(by, axis=1) - by
    slots: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    taken: Counter[int] = Counter()
    base = 0
    for times, bin_ in plan({n: int(c) for n, c in enumerate(by.sum(axis=1)) if c}, p.size):
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in bin_:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            slots.setdefault(n, []).append((taken[n], base, len(where), where))
            taken[n] += times * len(where)
        base += times
    shared = pieces.sparkSession.sparkContext.broadcast((before, slots))
    rank = F.row_number().over(Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")).cast("long")
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, slots = shared.value
        for batch in batches:
            length, lane, rank = (batch.column(i).to_numpy() for i in (3, 5, 6))
            k = before[length, lane] + rank - 1
            sequence, offset = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                mine = slots[int(length[rows[0]])]
                slot = np.searchsorted([s[0] for s in mine], k[rows], side="right") - 1
                for s in np.unique(slot).tolist():
                    first, base, times, where = mine[s]
                    r = rows[slot == s]
                    sequence[r] = base + (k[r] - first) // times
                    offset[r] = np.asarray(where)[(k[r] - first) % times]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "lane", rank.alias("rank"))
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, p: Packing | None = None) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ids_crc32 is that of the piece's ids as little-endian 32-bit numbers. Null text is empty: its one piece is the end id. Rows
    that repeat one another are packed each. Sequences hold their pieces from offset 0 without a gap. An empty table gives no
    rows; other columns are not read.
    """
    p = p or Packing()
    return pack(stored(pieces_of(docs, p), "pieces"), p)
