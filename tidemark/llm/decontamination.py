"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters occurs in a text with at most k = ERROR * m edits only if some region shares m + 1 - Q - k Q of
its Q-character grams on at most k + 1 neighbouring diagonals (text position minus item position). Shared grams are
counted in bands of diagonals that overlap by k, so that every such region lies whole in one band; bands that reach the
bound are verified by alignment within the band, the item whole and the text's ends free. Texts and items are
compared lower-cased and with single blanks for white space; positions count characters of that form.

A match with k edits leaves all but k Q of an item's grams whole, so it has FIRST of any k Q + FIRST of them (or as many as
the bound asks for). The item's rarest ones in the benchmark are indexed, and a band is counted in full only if it has
FIRST of these: grams that many items share are met only where an item has nothing rarer. Hits are taken in slices of at most SLICE, whatever the text and the benchmark.

Items of fewer than SHORT characters must be there without an edit and end at word ends; below Q characters an item is
its own and only gram. Items with one text are searched once. A text that has an item at several places reports the one
with the fewest edits, the first of those. Null and empty texts and items match nothing. Texts of any length are searched
whole. Repeated rows and rows without an id are searched one by one, equal item ids are taken together; an empty table on
either side gives an empty result. Only the id and text columns are read; clean() decides every row by its own text and
passes the other columns through, whatever their names.

The benchmark is indexed in blocks of at most BLOCK_CHARS characters, one after the other, each searched in all texts:
the driver and the executors hold one block at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import store
from tidemark.llm.tokens import mixed, release

Q = 10
ERROR = 0.05
SHORT = 25
FIRST = 8
BLOCK_CHARS = 4_000_000
SLICE = 1_000_000
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, n, 2**64)) for n in (1, 2, 4)]


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q = 10 characters, by doubling."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    one = chars.astype(np.uint64) + np.uint64(1)
    b1, b2, b4 = _POWERS
    two = one[:-1] * b1 + one[1:]
    four = two[:-2] * b2 + two[2:]
    eight = four[:-4] * b4 + four[4:]
    return mixed(eight[:-2] * b2 + two[8:])


def runs(chars: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n < Q characters."""
    out = np.zeros(max(0, len(chars) - n + 1), np.uint64)
    for i in range(n):
        out = out * _POWERS[0] + chars[i : i + len(out)] + np.uint64(1)
    return mixed(out)


def budget(m: int) -> int:
    """Edits allowed in an item: few enough for the bound on shared grams to stay above zero."""
    return 0 if m < SHORT else max(0, min(int(ERROR * m), (m - Q) // Q))


def at_word_ends(text: str, start: int, end: int) -> bool:
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(start) and not inside(end)


def align(item: np.ndarray, text: np.ndarray, lowest: int, highest: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of the whole item within the diagonals lowest to highest."""
    lowest, m = max(lowest, -len(item)), len(item)
    width = highest - lowest + 1
    far = m + len(text) + 1
    steps = np.arange(width)
    at = lowest + steps  # text position before the first character of the item
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    begin = at.copy()
    for i in range(m):
        place = at + i
        inside = (place >= 0) & (place < len(text))
        differ = np.where(inside, text[np.clip(place, 0, len(text) - 1)] != item[i], far)
        kept, k_begin = cost + differ, begin
        skipped = np.append(cost[1:] + 1, far)  # a character of the item without one of the text
        s_begin = np.append(begin[1:], 0)
        better = skipped < kept
        cost, begin = np.where(better, skipped, kept), np.where(better, s_begin, k_begin)
        reach = np.minimum.accumulate(cost - steps)  # characters of the text without one of the item
        source = np.maximum.accumulate(np.where(cost - steps == reach, steps, 0))
        cost, begin = reach + steps, begin[source]
    best = int(np.argmin(cost))
    return int(cost[best]), int(begin[best]), int(at[best]) + m


class Index:
    """The rarest grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        ids: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            if text := normal(text):
                ids[text].append(item_id)
        #: by length, the items that are shorter than a gram: their hashes, sorted, and their texts
        self.tiny: dict[int, tuple[np.ndarray, list[str]]] = {}
        for m in sorted({len(t) for t in ids if len(t) < Q}):
            texts = [t for t in ids if len(t) == m]
            hashes = np.concatenate([runs(characters(t), m) for t in texts])
            order = np.argsort(hashes)
            self.tiny[m] = hashes[order], [texts[i] for i in order]
        self.ids = ids
        self.texts = [t for t in ids if len(t) >= Q]
        self.items = [characters(t) for t in self.texts]
        self.grams = [grams(c) for c in self.items]
        self.edits = np.array([budget(len(x)) for x in self.items], np.int64)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        hashes = join(self.grams, np.uint64)
        owner = np.repeat(np.arange(len(self.grams)), [len(g) for g in self.grams])
        place = join([np.arange(len(g)) for g in self.grams], np.int64)
        _, number, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((place, often[number], owner))
        rank = np.arange(len(order)) - np.repeat(np.cumsum([0, *map(len, self.grams)])[:-1], [len(g) for g in self.grams])
        self.bound = np.array([len(g) for g in self.grams], np.int64) - Q * self.edits
        self.first = np.minimum(self.bound, FIRST)
        rare = order[rank < (Q * self.edits + self.first)[owner]]
        rare = rare[np.lexsort((place[rare], owner[rare], hashes[rare]))]
        self.hashes, self.owner, self.place = hashes[rare], owner[rare], place[rare]
        self.shift = np.uint64(64 - min(27, max(20, int(64 * len(rare)).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True

    def _tiny(self, text: str, chars: np.ndarray) -> Iterator[tuple[str, int]]:
        for m, (hashes, texts) in self.tiny.items():
            h = runs(chars, m)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = set()
            for start in np.flatnonzero(hashes[at] == h).tolist():
                item = texts[at[start]]
                if item not in found and text[start : start + m] == item and at_word_ends(text, start, start + m):
                    found.add(item)
                    yield item, start

    def _bands(self, h: np.ndarray) -> np.ndarray:
        """item << 40 | band of the bands that have enough rare grams, in ascending order; a band has k + 1 diagonals of its own
        and the k before them. Diagonals are raised to be positive."""
        near = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        if not len(near):
            return near
        first = np.searchsorted(self.hashes, h[near])
        often = np.searchsorted(self.hashes, h[near], side="right") - first
        upto = np.cumsum(often)
        total = int(upto[-1])
        keys, counts = np.zeros(0, np.int64), np.zeros(0)
        for low in range(0, total, SLICE):
            hit = np.arange(low, min(low + SLICE, total))
            k = np.searchsorted(upto, hit, side="right")
            entry = first[k] + hit - (upto[k] - often[k])
            item = self.owner[entry]
            edits = self.edits[item]
            band = (near[k] - self.place[entry] + 2**31) // (edits + 1)
            both = np.concatenate([item << 40 | band, (item << 40 | band + 1)[edits > 0]])
            keys, number = np.unique(np.concatenate([keys, both]), return_inverse=True)
            counts = np.bincount(number, np.concatenate([counts, np.ones(len(both))]), minlength=len(keys))
        return keys[counts >= self.first[keys >> 40]]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of each item that the text has, at its best place."""
        text = normal(text)
        chars = characters(text)
        out = [(i, s, s + len(t), 0) for t, s in self._tiny(text, chars) for i in self.ids[t]] if self.tiny else []
        h = grams(chars)
        if not len(h) or not len(self.hashes):
            return out
        best: dict[int, tuple[int, int, int]] = {}
        for key in self._bands(h).tolist():
            j, b = key >> 40, key & (2**40 - 1)
            if j in best and not best[j][0]:
                continue  # nothing beats the first exact one
            k, own = int(self.edits[j]), self.grams[j]
            low, high = b * (k + 1) - k - 2**31, b * (k + 1) + k - 2**31
            if self._shared(own, h, low, high) < self.bound[j]:
                continue
            if not k:
                end = low + len(self.items[j])
                if np.array_equal(chars[low:end], self.items[j]) and (len(self.items[j]) >= SHORT or at_word_ends(text, low, end)):
                    best[j] = (0, low, end)
                continue
            edits, start, end = align(self.items[j], chars, low - k, high + k)
            if edits <= k and (j not in best or (edits, start) < best[j][:2]):
                best[j] = (edits, start, end)
        return out + [(i, s, e, d) for j, (d, s, e) in best.items() for i in self.ids[self.texts[j]]]

    @staticmethod
    def _shared(own: np.ndarray, h: np.ndarray, low: int, high: int) -> int:
        """The grams that an item and a text share on the diagonals low to high."""
        n = 0
        for d in range(low, high + 1):
            a, z = max(0, -d), min(len(own), len(h) - d)
            if a < z:
                n += int(np.count_nonzero(own[a:z] == h[a + d : z + d]))
        return n


class Block:
    """A block of items as it is sent to the executors; a worker indexes it once."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self._index = items, None

    def __getstate__(self) -> dict:
        return {"items": self.items, "_index": None}

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        if self._index is None:
            self._index = Index(self.items)
        return self._index.search(text)


def _each_block(docs: DataFrame, benchmark: DataFrame, step: Callable[[DataFrame, Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """step(docs, Block) for each block of the benchmark; all but a single one are stored, so that only one block is held
    at a time. What is sent back takes the place of docs."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # a block of bounded size
        shared = docs.sparkSession.sparkContext.broadcast(Block([(r["item_id"], r["text"]) for r in rows]))
        out = step(docs, shared)
        if blocks > 1:
            out = store(out, "leaks")
            shared.destroy()
        sent = yield out
        docs = docs if sent is None else sent


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end and n_edits of every occurrence of an item in a document, one a pair."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, start long, end long, n_edits long"

    def step(docs: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = [], []
                texts = batch.column("text")
                for i in range(batch.num_rows):
                    per: dict[int, tuple[int, int, int]] = {}
                    for item, s, e, d in block.value.search(texts[i].as_py()):
                        if item not in per or (d, s) < (per[item][2], per[item][0]):
                            per[item] = (s, e, d)
                    ids += [i] * len(per)
                    found += [(item, *x) for item, x in sorted(per.items())]
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "item_id", "start", "end", "n_edits"])
                release()

        return docs.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, list(_each_block(docs, benchmark, step)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any item, with their columns."""
    schema = docs.schema

    def step(docs: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text")
                yield batch.filter(pa.array([not block.value.search(texts[i].as_py()) for i in range(batch.num_rows)], pa.bool_()))
                release()

        return docs.mapInArrow(run, schema)

    steps = _each_block(docs, benchmark, step)
    out = next(steps)
    while True:
        try:
            out = steps.send(out)
        except StopIteration:
            return out


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)
