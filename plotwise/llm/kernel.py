"""Vectorised text kernels shared by the Python-side operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, a block of documents at a time, so the cost is a few
NumPy passes over the bytes and the memory is bounded by the block (one document at least) and not by the batch.

Words are the maximal runs outside the ASCII white space set 0x20, 0x09-0x0D. Hashes are 64-bit polynomials over the bytes
with a final avalanche; they do not depend on the process, the machine or the position in a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = (1 << 20) - 1
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Family:
    """One family of polynomial hashes: values per byte and the powers of its base, grown on demand."""

    def __init__(self, seed: int):
        self.byte = mix(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        base = int(mix(np.array([seed + 77], dtype=U64))[0]) | 5
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                step = np.full(size, base, dtype=U64)
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))
        return self.powers[:n], self.inverses[:n]

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end] for many spans."""
        powers, inverses = self.upto(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * powers[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


FIRST, SECOND = Family(0x51), Family(0xA7C3)


@dataclass
class Block:
    """Documents lo..hi of a batch: their bytes, and the bounds of each document in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def parts(block: Block, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The same cut again, its documents numbered from 0."""
    lo, n = 0, block.hi - block.lo
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(block.bounds, block.bounds[lo] + limit, side="right")) - 1)
        yield Block(lo, hi, block.data[block.bounds[lo] : block.bounds[hi]], block.bounds[lo : hi + 1] - block.bounds[lo])
        lo = hi


@dataclass
class Words:
    """starts, ends: byte positions of all words of a block; first: index of each document's first word, and the total."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block) -> Words:
    n = len(block.data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~SPACE[block.data]
    body = inside[1:-1]
    left, right = ~inside[:-2], ~inside[2:]
    edges = block.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    left, right = left.copy(), right.copy()
    left[edges], right[edges - 1] = True, True
    starts = np.flatnonzero(body & left)
    ends = np.flatnonzero(body & right) + 1
    return Words(starts, ends, np.searchsorted(starts, block.bounds))


def word_hashes(block: Block, w: Words, family: Family = FIRST, lower: bool = False) -> np.ndarray:
    data = block.data
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return family.spans(family.byte[data], w.starts, w.ends)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes first: small ones compress well."""
    return np.ascontiguousarray(x.astype(U64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes, n: int, at: int) -> np.ndarray:
    """The n numbers of the column `at` among equally long ones."""
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=8 * n, offset=8 * n * at).reshape(8, n).T).view(U64).ravel()


def windows(hashes: np.ndarray, first: np.ndarray, size: int, family: Family = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words inside documents, and the index of each one's first word."""
    n = len(hashes)
    at = np.arange(max(0, n - size + 1))
    if not len(at):
        return np.zeros(0, dtype=U64), at
    limit = np.repeat(first[1:], np.diff(first))[: len(at)]
    at = at[at + size <= limit]
    return family.spans(hashes, at, at + size), at


def shingles(hashes: np.ndarray, first: np.ndarray, size: int, family: Family = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words and the document of each; a shorter document is one shingle, an empty one none."""
    got, at = windows(hashes, first, size, family)
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = family.spans(hashes, first[short], first[short + 1])
    return np.concatenate([got, whole]), np.concatenate([docs[at], short])
