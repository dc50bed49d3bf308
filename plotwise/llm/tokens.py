"""Byte-level BPE ids of whole batches, as the tokenizers library gives them.

A text is cut into pre-tokens with array operations that follow the vocabulary's own split pattern, and only pre-tokens not met
before by this worker go through the library; ids are then gathered. Characters outside ASCII get their class (letter, number,
white space, other) from the library's pre-tokenizer, once each. A text that holds one of the vocabulary's added tokens, such as
an end sign spelled out, goes through the library whole, which gives that token's id as any plain call does.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from . import kernel as K

U64 = np.uint64
OTHER, LETTER, NUMBER, WHITE, UNKNOWN = range(5)


class Encoder:
    """Ids by a byte-level BPE vocabulary file. `memory`: distinct pre-tokens remembered before starting anew."""

    def __init__(self, path: str, memory: int = 1 << 19):
        # one thread: a task has one core, and each thread would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.classes[:128] = [LETTER if chr(i).isalpha() else NUMBER if chr(i).isdigit() else WHITE if 9 <= i <= 13 or i == 32 else OTHER for i in range(128)]
        self.forget()

    def forget(self) -> None:
        """Known pre-tokens by hash, in order, with where their ids are in `ids`: a large table and a recent one."""
        none = np.zeros(0, dtype=np.int64)
        self.tables = [(np.zeros(0, dtype=U64), none, none)] * 2
        self.ids, self.used = np.zeros(1 << 16, dtype=np.int32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are known, and where their ids begin and how many they are."""
        known, begin, size = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for have, at_, n_ in self.tables:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                known |= hit
                begin[hit], size[hit] = at_[at[hit]], n_[at[hit]]
        return known, begin, size

    def classify(self, points: np.ndarray) -> None:
        one = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
        for x in points.tolist():
            c = chr(x)
            self.classes[x] = LETTER if one("a" + c) else NUMBER if one("1" + c) else OTHER if one("!" + c) else WHITE

    def char_classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte position and class of each character."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at].astype(np.int64)
        point = lead.copy()
        padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)]).astype(np.int64)
        for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            i = np.flatnonzero((lead >= low) & (lead < high))
            if len(i):
                value = lead[i] & bits
                for k in range(1, more + 1):
                    value = (value << 6) | (padded[at[i] + k] & 0x3F)
                point[i] = value
        kinds = self.classes[point]
        if len(new := np.flatnonzero(kinds == UNKNOWN)):
            self.classify(np.unique(point[new]))
            kinds = self.classes[point]
        return at, kinds

    def pre_tokens(self, block: K.Block) -> np.ndarray:
        """Byte positions where pre-tokens start; each ends where the next, or its document, does."""
        data = block.data
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.int64)
        at, kind = self.char_classes(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[block.bounds] = True
        doc_start = edge[at]
        run = doc_start.copy()
        run[1:] |= kind[1:] != kind[:-1]
        follows = ~np.append(doc_start[1:], True)  # the next character is in the same document
        blank = data[at] == 0x20
        start = run.copy()
        # white space before something else in the document: its last character stands alone or joins what follows
        last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & follows[:-1])
        start[last] = True
        start[last[blank[last]] + 1] = False
        # 's 't 're 've 'm 'll 'd where the apostrophe is alone and no blank joins it
        alone = run & np.append(run[1:], True) & (data[at] == 0x27)
        quote = np.flatnonzero(start & alone & follows)
        if len(quote):
            pad = np.append(data[at], np.zeros(3, dtype=np.uint8))
            inside = np.append(~doc_start, np.zeros(3, dtype=bool))
            one, two = pad[quote + 1], pad[quote + 2]
            letter = np.append(kind, np.zeros(3, dtype=np.uint8))[quote + 1] == LETTER
            single = letter & np.isin(one, [ord(c) for c in "stmd"])
            double = letter & inside[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for hit, size in ((single, 1), (double & ~single, 2)):
                q = quote[hit]
                start[q + 1] = False
                rest = q + 1 + size
                ok = rest < len(at)
                start[rest[ok]] = True
        return at[start]

    def learn(self, keys: np.ndarray, texts: list[str], chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Has the library encode new pre-tokens; `keys` are in order. Where their ids begin and how many they are."""
        found: list[list[int]] = []
        for lo in range(0, len(texts), chunk):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + chunk], add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=total)
        begin = self.used + np.cumsum(size) - size
        self.used += total
        self.tables[1] = merged(self.tables[1], (keys, begin, size))
        if len(self.tables[1][0]) > 1 << 16:
            large = merged(*self.tables)
            self.tables = [large, (keys[:0], begin[:0], size[:0])]
        return begin, size

    def encode(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and the bounds of each document in them."""
        raw = block.data.tobytes()
        if not any(x in raw for x in self.added):
            return self.encode_plain(block)
        ids, sizes = [], []
        for i in range(len(block.bounds) - 1):
            text = block.text(i)
            if any(x in text for x in self.added):
                ids.append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=np.int32))
            else:
                ids.append(self.encode_plain(K.Block(0, 1, np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])))[0])
            sizes.append(len(ids[-1]))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])

    def encode_plain(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        starts = self.pre_tokens(block)
        ends = np.append(starts[1:], len(block.data))
        hashes = K.FIRST.spans(K.FIRST.byte[block.data], starts, ends)
        keys, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        known, begin, size = self.find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = block.data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)]
            begin[new], size[new] = self.learn(keys[new], texts)
        flat = self.gather(begin[which], size[which])
        if len(self.tables[0][0]) > self.memory:
            self.forget()
        return flat[0], flat[1][np.searchsorted(starts, block.bounds)]

    def gather(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return flat, total


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's own encoder: tasks that follow one another in a worker share its vocabulary and what it remembers."""
    return Encoder(path)


def merged(a: tuple, b: tuple) -> tuple:
    """Two tables in order of their keys."""
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate(x)[order] for x in zip(a, b, strict=True))


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each document."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end, dtype=np.int32)
    shift = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(ids)) + shift] = ids
    return out, bounds + np.arange(n + 1)
