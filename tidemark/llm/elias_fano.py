"""Elias-Fano coding of monotone sequences, and a two-level n-gram trie on top of it, in one mapped piece of memory.

Nothing is decoded as a whole: elements are read by select on the high bits, found by the bucket that their high part
names and a search of the low parts in it.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Queries are answered so many at a time, so that what they need beside the coded levels is bounded.
SLICE = 200_000


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th set bit of each 64-bit word."""
    place, rank = np.zeros(len(words), np.uint64), rank.astype(np.uint64)
    for half in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count((words >> place) & np.uint64((1 << half) - 1)).astype(np.uint64)
        beyond = rank >= count
        rank = rank - np.where(beyond, count, 0).astype(np.uint64)
        place = place + np.where(beyond, half, 0).astype(np.uint64)
    return place.astype(np.int64)


class EliasFano:
    """A monotone sequence of unsigned 64-bit numbers: the low parts in whole bytes, the high parts in unary, with the
    number of ones before each 64 bits as the directory of select; that of zeros follows from it."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.low, self.high, self.ones = low, high, ones
        self.zeros = 64 * np.arange(len(high)) - ones
        self.n, self.width = low.shape[0], low.shape[1]

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        width = min(7, (max(0, (universe // max(1, n)).bit_length() - 1) + 7) // 8)
        low = values.view(np.uint8).reshape(n, 8)[:, :width].copy()
        parts = (values >> np.uint64(8 * width)).astype(np.int64)
        size = (int(parts[-1]) if n else 0) + n + 1  # a zero ends every part, the last too
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[parts + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
        return cls(low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, : self.width] = self.low[at]
        return out.view(np.uint64).ravel()

    def _one(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, rank, side="right") - 1
        return 64 * word + _select_in_word(self.high[word], rank - self.ones[word])

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        return 64 * word + _select_in_word(~self.high[word], rank - self.zeros[word])

    def _run(self, bit: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from the given bit on."""
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        rest = ~(self.high[word] >> shift)
        run = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        left = 64 - (bit & 63)
        full = np.flatnonzero(run >= left)  # to the end of the word: go on in the next
        run[full] = left[full]
        if len(full):
            more = full[word[full] + 1 < len(self.high)]
            run[more] += self._run(64 * (word[more] + 1))
        return run

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The elements at the given places."""
        return self._low(at) | ((self._one(at) - at).astype(np.uint64) << np.uint64(8 * self.width))

    def find(self, wanted: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first element from begin to end that is not less, whether it is equal)."""
        end = self.n if end is None else end
        if not self.n or not len(wanted):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        part = wanted >> np.uint64(8 * self.width)
        most = int(self._one(np.array([self.n - 1]))[0]) - self.n + 1
        inside = part <= np.uint64(most)
        part = np.minimum(part, np.uint64(most)).astype(np.int64)
        bit = np.where(part > 0, self._zero(np.maximum(part - 1, 0)) + 1, 0)
        first = bit - part
        a = np.clip(np.where(inside, first, self.n), begin, end)
        stop = np.clip(np.where(inside, first + self._run(bit), self.n), begin, end)
        small = wanted & np.uint64((1 << (8 * self.width)) - 1)
        b = stop.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            less = self._low(np.minimum(mid, self.n - 1)) < small
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        there = a < stop
        there[there] = self._low(a[there]) == small[there]
        return a, there


def quantise(values: np.ndarray, bins: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """(codes, centres): bins of equal mass, each stood for by its mean. The error is bounded by a bin's width."""
    distinct = np.unique(values)
    if len(distinct) > bins:
        edges = distinct[np.linspace(0, len(distinct), bins + 1).astype(np.int64)[1:-1]]
        codes = np.searchsorted(edges, values, side="right")
        size = np.bincount(codes, minlength=bins)
        return codes.astype(np.uint16), np.bincount(codes, values, minlength=bins) / np.maximum(size, 1)
    return np.searchsorted(distinct, values).astype(np.uint16), distinct


class Trie:
    """Words, and below each the words that stand before it, with a quantised number for each node.

    keys: hashes of the words; contexts: hashes of the words before; pointers: where each word's nodes begin; below: the
    nodes' context numbers, each word's raised by one more than the last of the word before it, so that the level is
    monotone. A lookup finds the word, reads its pointers and what its numbers are raised by, and searches the successor
    of the raised context number between the pointers."""

    LEVELS = ("keys", "contexts", "pointers", "below")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray, centres: np.ndarray, size: int):
        self.levels, self.codes, self.centres, self.size = levels, codes, centres, size

    @classmethod
    def build(cls, keys: np.ndarray, contexts: np.ndarray, word: np.ndarray, before: np.ndarray, value: np.ndarray) -> Trie:
        """The trie of distinct pairs (keys[word], contexts[before]) with a value each; keys and contexts are sorted, and so
        are the pairs, by both numbers. A key may have no pair."""
        often = np.bincount(word, minlength=len(keys))
        pointers = np.append(0, np.cumsum(often)).astype(np.uint64)
        last = np.zeros(len(keys), np.uint64)
        some = often > 0
        last[some] = before[pointers[1:][some].astype(np.int64) - 1].astype(np.uint64) + np.uint64(1)
        raised = np.cumsum(last) - last
        below = before.astype(np.uint64) + np.repeat(raised, often)
        codes, centres = quantise(value) if len(value) else (np.zeros(0, np.uint16), np.zeros(0))
        arrays = [x for v in (keys, contexts, pointers, below) for x in EliasFano.encode(v).arrays()] + [codes, centres]
        return cls._mapped(arrays)

    @classmethod
    def _mapped(cls, arrays: list[np.ndarray]) -> Trie:
        """The arrays side by side in one anonymous memory map."""
        starts = np.cumsum([0] + [-(-x.nbytes // 64) * 64 for x in arrays])
        memory = mmap.mmap(-1, max(64, int(starts[-1])))
        views = []
        for x, start in zip(arrays, starts[:-1].tolist(), strict=True):
            view = np.frombuffer(memory, x.dtype, x.size, start).reshape(x.shape)
            view[...] = x
            view.flags.writeable = False
            views.append(view)
        levels = {k: EliasFano(*views[3 * i : 3 * i + 3]) for i, k in enumerate(cls.LEVELS)}
        return cls(levels, views[-2], views[-1], int(starts[-1]))

    def lookup(self, words: np.ndarray, word: np.ndarray, contexts: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The values of the pairs (words[word], contexts[before]); NaN where the trie has none."""
        keys, named, pointers, below = (self.levels[k] for k in self.LEVELS)
        if not below.n:
            return np.full(len(word), np.nan)
        at, known = keys.find(words)
        at = np.where(known, at, 0)
        begin, end = (pointers[at + i].astype(np.int64) for i in (0, 1))
        raised = np.where(begin > 0, below[np.maximum(begin - 1, 0)] + np.uint64(1), np.uint64(0))
        number, seen = named.find(contexts)
        out = np.full(len(word), np.nan)
        for a in range(0, len(word), SLICE):
            w, c = word[a : a + SLICE], before[a : a + SLICE]
            both = np.flatnonzero(known[w] & seen[c])
            w, c = w[both], c[both]
            place, hit = below.find(raised[w] + number[c].astype(np.uint64), begin[w], end[w])
            out[a + both[hit]] = self.centres[self.codes[place[hit]]]
        return out
