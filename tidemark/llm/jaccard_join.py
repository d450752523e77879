"""N-gram Jaccard join with a prefix tree: links of 0.75 and more between sets of five-word shingles, and components.

1. Documents with equal sets form a class; from here on a class is one set. In the order of their hashes, the most
   frequent shingles (at most MOST, found before) last, two linked classes have k shingles in common among the first
   n - ceil(3n/4) + k of each. With k = ceil(n/8) only those, three eighths, go as 32 bits to a shard by their value; a
   class of which fewer than k are shared there is done, whatever else it has. One row of each other class is read again.
   Of these, each distinct shingle goes, as a 64-bit hash, to a shard by its value, where classes that share it meet.
   Shingles of one class only can overlap with nothing; the others go back to their classes. The most frequent shingles
   need no shard. A class needs three quarters of its own shingles to be shared, so more are done.
2. The shared shingles have a global order, rarest first (by the logarithm of the number of classes, then by value).
   Two linked classes have a shingle in common in their prefixes, the first n - ceil(3n/4) + 1 of the full set.
3. Joins run in groups with a trie of the sets, most frequent shingle first, so that copies share long paths: a
   traversal keeps the overlap so far, skips subtrees that already belong to the set's component, and prunes by the
   overlap that the remaining lengths could still give. First every class is joined in the one group of its
   commonest prefix shingle, in chunks of at most CHUNK; then, ROUNDS times, one member of each component is. This
   links copies at the cost of one pass each, whatever the size of their group, and leaves out nothing for good.
4. Then a prefix shingle that still has classes of two components or more is open. Shingles with the same holders (as
   those of one passage are) count as one group, and groups that share classes make a family. Every family is joined in
   full, so that a class travels once, not once for each shingle; only where many classes hang together by few groups, as
   by a widespread phrase, each group is joined for itself instead, whichever moves less. A family or group of more than
   CHUNK classes is cut by length into bands as wide as a link can reach, of which only neighbours meet, and those into
   chunks. New links are closed over components in the same way.

A link is only ever made after counting the overlap of the whole sets. A document without words has the empty set and its
own id as component; with fewer than five words its sequence is its only shingle. Null texts count as empty; rows with
equal ids keep their rows; a null id gets the smallest id of its component, null if there is none. Texts of any length
are read whole: a longer one makes a larger block. A tie at exactly 75 % is a link. An empty table gives an empty
result. Only the id and text columns are read. Shingles are told apart by 64-bit hashes.

Blocks of documents send shingles to shards as parcels, one a shard. Beyond FAN shards they go in two steps, so that a
block makes about the root of as many parcels and none gets small, however large the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh, join_small, small, store
from tidemark.llm.tokens import Vocabulary, mixed, release, rows_of, words_of

SHINGLE = 5
BLOCK_BYTES = 4_000_000
BLOCK_DOCS = 60_000
SHARD_SHINGLES = 1_200_000
FAN = 4096
CHUNK = 1000
ROUNDS = 2
#: A shingle of that many classes of a block, and of one in SPREAD of them, may be one of the MOST that are known to all tasks.
FREQUENT, SPREAD, MOST = 16, 1000, 65_536
BROADCAST_ROWS, OPEN_ROWS = 2_000_000, 200_000
#: Bits of a sieve for each row that it lets through, and at most; a fuller one lets others through too, which only costs.
SIEVE_SPREAD, SIEVE_BITS = 64, 1 << 27
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 2**64) for k in range(SHINGLE)], np.uint64)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted by both."""
    vocabulary = Vocabulary()
    numbers = [vocabulary.numbers(words_of(t)) for t in texts]
    lengths = np.array([len(x) for x in numbers], np.int64)
    word = mixed(vocabulary.array())[np.concatenate(numbers)] if lengths.sum() else np.zeros(0, np.uint64)
    del numbers
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    n = max(0, len(word) - SHINGLE + 1)
    value = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        value += word[k : k + n] * _POWERS[k]
    whole = owner[:n] == owner[SHINGLE - 1 :] if n else np.zeros(0, bool)
    owners, values = [owner[:n][whole]], [value[whole]]
    starts = np.cumsum(lengths) - lengths
    few = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(few):
        owners.append(few)
        values.append(np.array([int((word[starts[i] : starts[i] + lengths[i]] * _POWERS[: lengths[i]]).sum() + np.uint64(lengths[i])) for i in few], np.uint64))
    owner, value = np.concatenate(owners), mixed(np.concatenate(values))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def classes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set size, class) of each text, and shingles() of the texts."""
    owner, value = shingles(texts)
    size = np.bincount(owner, minlength=len(texts))
    name = np.zeros(len(texts), np.uint64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(first):
        name[owner[first]] = np.add.reduceat(mixed(value ^ np.uint64(0xA24BAED4963EE407)), first)
    return size, mixed(name + size.astype(np.uint64)), owner, value


def _blocks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows_of(batches, *names):
        held.append(row)
        size += len(row[-1] or "")
        if size > BLOCK_BYTES or len(held) >= BLOCK_DOCS:
            yield held
            held, size = [], 0
            release()
    if held:
        yield held
    release()


def _once(name: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first text of each class of a block; none for those without words."""
    once = np.zeros(len(name), bool)
    once[np.unique(name, return_index=True)[1]] = True
    return once & (size > 0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of every document, and for each block the shingles that many of its classes have, with how many."""
    for block in _blocks(batches, "doc_id", "key", "text"):
        size, name, owner, value = classes([t for *_, t in block])
        once = _once(name, size)
        items, often = np.unique(value[once[owner]], return_counts=True)
        many = often >= max(FREQUENT, once.sum() / SPREAD)
        items, often = items[many], often[many]
        n, m = len(block), len(items)
        nothing = lambda k: pa.nulls(k, pa.int64())
        parts = [
            pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in block], pa.int64()) for k in (0, 1)] + [pa.array(size), pa.array(name.view(np.int64), mask=size == 0), nothing(n), nothing(n)], _MEMBERS
            ),
            pa.RecordBatch.from_arrays([nothing(m), nothing(m), nothing(m), nothing(m), pa.array(items.view(np.int64)), pa.array(often.astype(np.int64))], _MEMBERS),
        ]
        yield from parts


_MEMBERS = ["doc_id", "key", "n", "class", "item", "c"]


class Frequent:
    """The most frequent shingles, known to all tasks: they need no shard to learn that they are shared."""

    def __init__(self, items: np.ndarray, counts: np.ndarray):
        order = np.argsort(items)
        self.items, self.ranks = items[order], np.log2(counts[order]).astype(np.uint8)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.items):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(self.items, values), len(self.items) - 1)
        return at, self.items[at] == values

    def ranks_of(self, values: np.ndarray) -> np.ndarray:
        """The ranks of values; 0 for those that are not frequent."""
        at, known = self.find(values)
        rank = np.zeros(len(values), np.uint8)
        rank[known] = self.ranks[at[known]]
        return rank


class Sieve:
    """Passes every row whose key is among the chosen ones, and few others."""

    def __init__(self, chosen: DataFrame, rows: int):
        self.bits = min(SIEVE_BITS, 1 << (SIEVE_SPREAD * (rows + 1)).bit_length())
        spot = F.pmod("key", F.lit(self.bits))
        cells = chosen.groupBy(F.shiftright(spot, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {self.bits}) & 63 AS int))")).alias("set")).toArrow()
        self.cells = np.zeros(self.bits // 64, np.uint64)
        self.cells[cells.column("cell").to_numpy()] = cells.column("set").to_numpy().view(np.uint64)

    def passed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        spot = batch.column("key").to_numpy().view(np.uint64) & np.uint64(self.bits - 1)
        return batch.filter(pa.array((self.cells[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1))


Place = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
_KINDS = (("class", np.uint64), ("n", np.uint32), ("runs", np.uint32), ("value", np.uint64), ("rank", np.uint8))
_PARCEL = "shard int, class binary, n binary, runs binary, value binary, rank binary"


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, all first ones, then all second ones...: those of small numbers compress well."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _read(b: bytes, kind: type) -> np.ndarray:
    if kind is np.uint32:
        return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.frombuffer(b, kind)


def _to_shards(shards: int) -> Place:
    """Frequent shingles, which have a rank, go by class to shards from `shards` on, others by value."""
    return lambda value, rank, name: np.where(rank > 0, np.uint64(shards) + name % np.uint64(shards), value % np.uint64(shards)).astype(np.int64)


def _to_buckets(shards: int) -> Place:
    return lambda value, rank, name: (mixed(name) % np.uint64(shards)).astype(np.int64)


def _fan(places: int) -> int:
    """How many parcels a block may make at once."""
    return places if places <= FAN else math.isqrt(places - 1) + 1


def _parcels(place: np.ndarray, name: np.ndarray, size: np.ndarray, owner: np.ndarray, value: np.ndarray, rank: np.ndarray, short: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each place, of the values there (of which 32 bits, if short) and their owners (numbers of names, in
    ascending order)."""
    order = np.argsort(place, kind="stable")
    owner, value, place, rank = owner[order], value[order], place[order], rank[order]
    value = (value >> np.uint64(32)).astype(np.uint32) if short else value
    bounds = np.flatnonzero(np.diff(place, prepend=-1, append=-2))
    rows: dict[str, list] = {k: [] for k in ("shard", *(k for k, _ in _KINDS))}
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        starts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        who = owner[a:b][starts]
        runs = np.diff(np.append(starts, b - a))
        for k, x in zip(rows, (int(place[a]), name[who].tobytes(), _planes(size[who]), _planes(runs), value[a:b].tobytes(), rank[a:b].tobytes()), strict=True):
            rows[k].append(x)
    columns = [pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in rows.items()]
    for at in range(0, len(columns[0]), 500):
        yield pa.RecordBatch.from_arrays([c.slice(at, 500) for c in columns], list(rows))


def _columns(table: pa.Table, short: bool = False) -> dict[str, np.ndarray]:
    out = {k: np.concatenate([_read(b, kind) for b in table.column(k).to_pylist()]) for k, kind in _KINDS if k != "value"}
    value = np.uint32 if short else np.uint64
    return out | {"value": np.concatenate([np.frombuffer(b, value) for b in table.column("value").to_pylist()])}


def _deal(shards: int, frequent: Frequent, sieve: Sieve):
    """Deals the shingles of each block's classes, of the rows that pass the sieve."""
    place, fan = _to_shards(shards), _fan(2 * shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(map(sieve.passed, batches), "text"):
            size, name, owner, value = classes([t for (t,) in block])
            mine = _once(name, size)[owner]
            owner, value = owner[mine], value[mine]
            rank = frequent.ranks_of(value)
            yield from _parcels(place(value, rank, name[owner]) % fan, name, size, owner, value, rank)

    return deal


def _need(size: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles must be shared. From one size to the next it grows by no more than ceil(3n/4)
    does, so that the longer of two linked sets finds its number among the first ones of the shorter, too."""
    return (size + 7) // 8


def _deal_first(shards: int, frequent: Frequent):
    """Deals the first shingles of each block's classes, with how many of them must be shared."""
    place, fan = _to_shards(shards), _fan(2 * shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "text"):
            size, name, owner, value = classes([t for (t,) in block])
            mine = _once(name, size)[owner]
            owner, value = owner[mine], value[mine]
            rank = frequent.ranks_of(value)
            order = np.argsort(2 * owner + (rank > 0), kind="stable")
            value, rank = value[order], rank[order]
            need = _need(size)
            first = np.arange(len(owner)) - np.searchsorted(owner, owner) < (size - (3 * size + 3) // 4 + need)[owner]
            owner, value, rank = owner[first], value[first], rank[first]
            yield from _parcels(place(value, rank, name[owner]) % fan, name, need, owner, value, rank, fan == 2 * shards)

    return deal


def _delivered(parcels: DataFrame, places: int, place: Place, short: bool = False) -> DataFrame:
    """Parcels at their places; those that are only known up to a bundle of places are opened and dealt again, then short."""
    if _fan(places) == places:
        return parcels

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = _columns(pa.Table.from_batches(rows))
            owner = np.repeat(np.arange(len(columns["class"])), columns["runs"])
            to = place(columns["value"], columns["rank"], columns["class"][owner])
            yield from _parcels(to, columns["class"], columns["n"], owner, columns["value"], columns["rank"], short)
            release()

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                held.append(batch.slice(at, 100))
                size += held[-1].nbytes
                if size > 2 * BLOCK_BYTES:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    return parcels.repartition(_fan(places), "shard").mapInArrow(split, _PARCEL)


def _met(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, value, number of owners) of the distinct pairs whose value two owners have or more."""
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    starts = np.ones(len(value), bool)
    starts[1:] = value[1:] != value[:-1]
    starts = np.flatnonzero(starts)
    often = np.diff(np.append(starts, len(value)))
    often = np.repeat(often, often)
    shared = often > 1
    return owner[shared], value[shared], often[shared]


def _count(shards: int, buckets: int):
    place, fan = _to_buckets(buckets), _fan(buckets)

    def count(table: pa.Table) -> pa.Table:
        """Of one shard, for each class how many of its first shingles other classes have too, as the upper half of its one
        value. Some may only look so, as 32 bits tell."""
        columns = _columns(table, True)
        names, first, number = np.unique(columns["class"], return_index=True, return_inverse=True)
        need, c = columns["n"][first], columns["runs"][first]
        if table.column("shard")[0].as_py() < shards:
            owner, value = np.repeat(number.astype(np.uint32), columns["runs"]), columns["value"]
            del columns, number
            c = np.bincount(_met(owner, value)[0], minlength=len(names))
        some = np.flatnonzero(c)
        c, none = c[some].astype(np.uint64) << np.uint64(32), np.zeros(len(some), np.uint8)
        out = pa.Table.from_batches(_parcels(place(c, none, names[some]) % fan, names, need, some, c, none, fan == buckets), _PARCEL_TYPES)
        release()
        return out

    return count


def _enough(table: pa.Table) -> pa.Table:
    """Of one bucket, the classes that have as many shared first shingles as they need."""
    columns = _columns(table, True)
    names, first, number = np.unique(columns["class"], return_index=True, return_inverse=True)
    enough = np.bincount(number, columns["value"]) >= columns["n"][first]
    release()
    return pa.table({"class": pa.array(names[enough].view(np.int64))})


def _share(shards: int):
    place, fan = _to_buckets(shards), _fan(shards)

    def sent(names, size, owner, value, rank) -> pa.Table:
        out = pa.Table.from_batches(_parcels(place(value, rank, names[owner]) % fan, names, size, owner, value, rank), _PARCEL_TYPES)
        release()
        return out

    def share(table: pa.Table) -> pa.Table:
        """Of one shard, for each class the shingles that other classes have too, with the order of magnitude of how many."""
        columns = _columns(table)
        names, first, number = np.unique(columns["class"], return_index=True, return_inverse=True)
        size = columns["n"][first]
        value, rank = columns["value"], columns["rank"]
        if table.column("shard")[0].as_py() >= shards:  # all are shared; of a class that several blocks have, the first counts
            keep = np.zeros(len(number), bool)
            keep[first] = True
            inside = np.repeat(keep, columns["runs"])
            owner, value, rank = np.repeat(number, columns["runs"])[inside], value[inside], rank[inside]
            order = np.argsort(owner, kind="stable")
            return sent(names, size, owner[order], value[order], rank[order])
        owner = np.repeat(number, columns["runs"]).astype(np.uint32)
        del columns, number
        owner, value, often = _met(owner, value)
        order = np.argsort(owner, kind="stable")
        return sent(names, size, owner[order], value[order], np.log2(often[order]).astype(np.uint8))

    return share


_PARCEL_TYPES = pa.schema([("shard", pa.int32()), *[(k, pa.binary()) for k, _ in _KINDS]])


def _gather(table: pa.Table) -> pa.Table:
    """Of one bucket, the classes of which three quarters are shared: their shared shingles, rarest first, and how many of
    them the prefix has; home is the prefix's last."""
    columns = _columns(table)
    names, first, number = np.unique(columns["class"], return_index=True, return_inverse=True)
    n = columns["n"][first].astype(np.int64)
    owner = np.repeat(number, columns["runs"])
    able = 4 * np.bincount(owner, minlength=len(names)) >= 3 * n
    inside = able[owner]
    owner, value, rank = owner[inside], columns["value"][inside], columns["rank"][inside]
    order = np.lexsort((value, rank, owner))
    owner, value = owner[order].astype(np.int64), value[order]
    ends = np.searchsorted(owner, np.append(np.flatnonzero(able), len(names)))
    names, n = names[able], n[able]
    prefix = np.diff(ends) - (3 * n + 3) // 4 + 1
    items = [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    home = value[ends[:-1] + prefix - 1] if len(names) else np.zeros(0, np.uint64)
    return pa.table({"class": pa.array(names.view(np.int64)), "n": pa.array(n), "prefix": pa.array(prefix), "home": pa.array(home.view(np.int64)), "items": pa.array(items, pa.binary())})


class Forest:
    """Components of numbers, with the smallest as root."""

    def __init__(self, roots: np.ndarray):
        self.root = roots.copy()

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root[a], self.root[b]))
        self.root[self.root == b] = a


def trie_join(sets: list[np.ndarray], sizes: np.ndarray, roots: np.ndarray, left: np.ndarray | None = None) -> tuple[Forest, list[tuple[int, int]]]:
    """Links among sets, which are in one order, most frequent first; sizes are those of the full sets. Pairs within a
    component are skipped, as are, with left, pairs on the same side. Gives the components and the links made."""
    forest, links = Forest(roots), []
    m = len(sets)
    items, _ = np.unique(np.concatenate(sets), return_inverse=True)
    rank = {}
    for s in sets:  # the order of the sets, not of the values
        for v in s.tolist():
            rank.setdefault(v, len(rank))
    number = np.array([rank[v] for v in items.tolist()], np.int64)
    local = [number[np.searchsorted(items, s)] for s in sets]
    order = sorted(range(m), key=lambda i: local[i].tolist())
    lcp = [0] * (m + 1)
    for i in range(1, m):
        a, b = local[order[i - 1]], local[order[i]]
        n = min(len(a), len(b))
        d = np.flatnonzero(a[:n] != b[:n])
        lcp[i] = int(d[0]) if len(d) else n
    place = np.array(order)
    # nodes (depth of the parent, depth, from, to) of the path-compressed trie, by a stack over common prefixes
    children: dict[int, list[int]] = {}
    nodes: list[list[int]] = []

    def node(depth: int, lo: int) -> int:
        nodes.append([depth, lo, -1])
        children[len(nodes) - 1] = []
        return len(nodes) - 1

    top = node(0, 0)
    stack = [top]
    for i in range(m):
        low, last = i, None
        while nodes[stack[-1]][0] > lcp[i]:
            last = stack.pop()
            nodes[last][2] = i
            low = nodes[last][1]
            if stack and nodes[stack[-1]][0] >= lcp[i]:
                children[stack[-1]].append(last)
                last = None
        if last is not None:
            inner = node(lcp[i], low)
            children[inner].append(last)
            stack.append(inner)
        stack.append(node(len(local[order[i]]), i) if len(local[order[i]]) > nodes[stack[-1]][0] else stack.pop())
    while len(stack) > 1:
        last = stack.pop()
        nodes[last][2] = m
        children[stack[-1]].append(last)
    nodes[top][2] = m
    length = np.array([len(local[i]) for i in order])
    size = sizes[place]
    longest = [int(length[lo:hi].max()) for _, lo, hi in nodes]
    smallest = [int(size[lo:hi].min()) for _, lo, hi in nodes]
    largest = [int(size[lo:hi].max()) for _, lo, hi in nodes]
    inside = np.zeros(len(rank), bool)
    for x in np.argsort(-sizes, kind="stable").tolist():
        inside[:] = False
        inside[local[x]] = True
        nx = int(sizes[x])
        todo = [(top, 0, 0)]
        while todo:
            v, above, overlap = todo.pop()
            depth, lo, hi = nodes[v]
            if 4 * largest[v] < 3 * nx or 4 * nx < 3 * smallest[v]:
                continue
            if (forest.root[place[lo:hi]] == forest.root[x]).all():
                continue
            if depth > above:
                overlap += int(inside[local[place[lo]][above:depth]].sum())
            # of what lies below, all could be shared: the rest of the longest set, or of this one
            if 7 * (overlap + min(longest[v] - depth, len(local[x]) - overlap)) < 3 * (nx + smallest[v]):
                continue
            for y in place[lo:hi][length[lo:hi] == depth].tolist():
                if 7 * overlap >= 3 * (nx + int(sizes[y])) and forest.root[y] != forest.root[x] and (left is None or left[y] != left[x]):
                    forest.join(x, y)
                    links.append((x, y))
            todo += [(c, depth, overlap) for c in children[v]]
    return forest, links


def _local(table: pa.Table) -> pa.Table:
    """Components within one group of classes: every class with the smallest class of its component."""
    name = table.column("class").to_numpy()
    order = np.argsort(name)
    name = name[order]
    sets = [np.frombuffer(b, np.uint64)[::-1] for b in table.column("items").to_pylist()]
    forest, _ = trie_join([sets[i] for i in order], table.column("n").to_numpy()[order], np.arange(len(name)))
    release()
    return pa.table({"class": pa.array(name), "root": pa.array(name[forest.root])})


def _across(table: pa.Table) -> pa.Table:
    """Links between components within one group, or between its two sides."""
    comp = table.column("comp").to_numpy()
    roots = np.unique(comp, return_inverse=True)[1]
    first = np.unique(roots, return_index=True)[1]
    side = table.column("side").to_numpy()
    sets = [np.frombuffer(b, np.uint64)[::-1] for b in table.column("items").to_pylist()]
    both = side.min() != side.max()
    _, links = trie_join(sets, table.column("n").to_numpy(), first[roots], side if both else None)
    return pa.table({"a": pa.array([int(comp[x]) for x, _ in links], pa.int64()), "b": pa.array([int(comp[y]) for _, y in links], pa.int64())})


def _homes(sets: DataFrame) -> DataFrame:
    """Roots of classes, joined in chunks of the group of their home shingle."""
    groups = sets.groupBy("home").agg(F.count("*").alias("_m")).where("_m > 1")
    grouped = sets.join(groups, "home")
    chunk = F.pmod(F.xxhash64("class"), F.ceil(F.col("_m") / CHUNK)).alias("chunk")
    return grouped.select("home", chunk, "class", "n", "items").groupBy("home", "chunk").applyInArrow(_local, "class long, root long")


def _close(edges: DataFrame) -> DataFrame:
    """comp and label, the smallest comp it is linked with, by spreading the smallest label over links (pre-aggregated by
    comp) and jumping to the label's label, until nothing changes."""
    both = store(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-links")
    labels = store(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        step = store(step.join(jump, "next", "left").select("a", F.col("label").alias("was"), F.least("next", F.coalesce("far", "next")).alias("label")), "jaccard-labels")
        labels = step.select("a", "label")
        if step.where("was != label").isEmpty():
            return labels


def _families(groups: DataFrame) -> DataFrame:
    """(group, class) with whole families in place of those groups that would move more rows by themselves."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("m"), F.min("class").alias("a"))
    parts = F.ceil(F.col("m") / CHUNK)
    sizes = store(sizes.withColumn("cost", F.col("m") * parts), "jaccard-sizes")
    named = groups.join(sizes.select("group", "a"), "group")
    family = store(_close(named.select("a", F.col("class").alias("b"))).select(F.col("a").alias("class"), F.col("label").alias("family")), "jaccard-families")
    whole = family.groupBy("family").agg(F.count("*").alias("m"))
    apart = sizes.join(family.select(F.col("class").alias("a"), "family"), "a").groupBy("family").agg(F.sum("cost").alias("cost"))
    taken = store(whole.join(apart, "family").select("family", (F.col("m") * parts <= F.col("cost")).alias("whole")), "jaccard-taken")
    chosen = family.join(taken, "family")
    rest = chosen.where("NOT whole").select("class")
    out = chosen.where("whole").select(F.col("family").alias("group"), "class")
    return store(out.unionByName(groups.join(rest, "class", "left_semi")), "jaccard-joined")


def _cells(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, i, j, side, class): where the classes of each group meet. A group of up to CHUNK is one cell. Larger ones
    are cut into bands, so wide that links reach no further than to the next, and bands into chunks; a chunk meets itself,
    the others of its band and those of the bands beside it. i and j name the chunks, side tells them apart."""
    many = groups.groupBy("group").agg(F.count("*").alias("_m"))
    one = groups.join(many.where(F.col("_m") <= CHUNK), "group")
    out = one.select("group", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "class")
    many = store(many.where(F.col("_m") > CHUNK), "jaccard-large")
    if many.isEmpty():
        return out
    band = F.floor(F.log("n") / math.log(4 / 3) + 1e-9).cast("long")
    large = join_small(groups, many, "group", "left_semi", BROADCAST_ROWS).join(sizes, "class").select("group", "class", band.alias("band"))
    parts = large.groupBy("group", "band").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("parts"))
    parts = store(parts, "jaccard-bands")
    below, above = (parts.select("group", (F.col("band") + by).alias("band"), F.col("parts").alias(k)) for by, k in ((1, "below"), (-1, "above")))
    about = parts.join(below, ["group", "band"], "left").join(above, ["group", "band"], "left")
    placed = join_small(large, about, ["group", "band"], "inner", BROADCAST_ROWS)
    # chunks are numbered by band and part
    wide = 1 << 32
    chunk = F.col("band") * wide + F.pmod(F.xxhash64("class"), F.col("parts"))
    row = lambda by, k: F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) - 1), lambda p: (F.col("band") + by) * wide + p)
    near = lambda by, k: F.when(F.col(k).isNotNull(), row(by, k)).otherwise(F.array().cast("array<bigint>"))
    meets = placed.withColumn("mine", chunk).withColumn("other", F.explode(F.concat(row(0, "parts"), near(-1, "below"), near(1, "above"))))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return out.unionByName(meets.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "class"))


def _able(members: DataFrame, docs: DataFrame, frequent: Frequent) -> DataFrame:
    """(key, n) of one row of each class that has enough first shingles in common with others; n is summed over the rows
    that have this key."""
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, round(total / (4 * SHARD_SHINGLES)))  # three eighths of the shingles, of half the width
    dealt = _delivered(docs.select("text").mapInArrow(_deal_first(shards, frequent), _PARCEL), 2 * shards, _to_shards(shards), True)
    buckets = -(-shards // 8)  # they hold numbers, not shingles
    counts = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_count(shards, buckets), _PARCEL)
    counts = _delivered(counts, buckets, _to_buckets(buckets), True)
    able = counts.repartition(buckets, "shard").groupBy("shard").applyInArrow(_enough, "class long")
    keys = members.where("class IS NOT NULL").groupBy("class", "key").agg(F.sum("n").alias("n"))
    keys = keys.groupBy("class").agg(F.min(F.struct("key", "n")).alias("k"))
    return store(keys.join(able, "class", "left_semi").select("k.key", "k.n"), "jaccard-able")


def components(members: DataFrame, docs: DataFrame, frequent: Frequent) -> DataFrame:
    """class and comp of the classes that are linked with others. members: (doc_id, key, n, class); docs: (key, text)."""
    chosen = _able(members, docs, frequent)
    rows, total = chosen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, round(total / SHARD_SHINGLES))
    dealt = _delivered(docs.mapInArrow(_deal(shards, frequent, Sieve(chosen, rows)), _PARCEL), 2 * shards, _to_shards(shards))
    # a partition a shard, however many there are
    shared = _delivered(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_share(shards), _PARCEL), shards, _to_buckets(shards))
    sets = store(shared.repartition(shards, "shard").groupBy("shard").applyInArrow(_gather, "class long, n long, prefix long, home long, items binary"), "jaccard-sets")

    comp = store(_homes(sets), "jaccard-roots").select("class", F.col("root").alias("comp"))
    for _ in range(ROUNDS):
        known = sets.join(comp, "class", "left").where(F.coalesce("comp", "class") == F.col("class")).select(sets.columns)
        step = store(_homes(known).where("class != root"), "jaccard-roots").select(F.col("class").alias("comp"), "root")
        grown = comp.join(step, "comp", "left").select("class", F.coalesce("root", "comp").alias("comp"))
        alone = step.join(comp.select(F.col("class").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("class"), F.col("root").alias("comp"))
        comp = store(grown.unionByName(alone), "jaccard-comps")

    named = sets.join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    items = named.select("class", "comp", "n", "prefix", "items").mapInArrow(_prefixes, "class long, comp long, item long")
    items = store(items, "jaccard-prefixes")
    # an open shingle's group is told by its holders; should two groups have one name, they are joined as one
    holders = [F.count("*").alias("m"), F.min("class").alias("a"), F.max("class").alias("z"), F.bit_xor(F.xxhash64("class")).alias("x")]
    open_items = items.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *holders).where("lo != hi")
    open_items = store(open_items.select("item", F.xxhash64("m", "a", "z", "x").alias("group")), "jaccard-open")
    if open_items.isEmpty():
        return comp
    groups = store(join_small(items.select("item", "class"), open_items, "item", "inner", OPEN_ROWS).select("group", "class").distinct(), "jaccard-groups")
    cells = _cells(_families(groups), sets.select("class", "n"))
    full = cells.join(named.select("class", "comp", "n", "items"), "class").select("group", "i", "j", "side", "class", "comp", "n", "items")
    edges = store(full.groupBy("group", "i", "j").applyInArrow(_across, "a long, b long").distinct(), "jaccard-edges")
    if edges.isEmpty():
        return comp
    label = _close(edges).select(F.col("a").alias("comp"), "label")
    grown = comp.join(label, "comp", "left").select("class", F.coalesce("label", "comp").alias("comp"))
    alone = label.join(comp.select(F.col("class").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("class"), F.col("label").alias("comp"))
    return grown.unionByName(alone)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix = batch.column("prefix").to_numpy()
        for at in range(0, batch.num_rows, 1000):
            items = [np.frombuffer(b, np.int64)[:p] for b, p in zip(batch.column("items").slice(at, 1000).to_pylist(), prefix[at : at + 1000], strict=True)]
            n = prefix[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(k).to_numpy()[at : at + 1000], n)) for k in ("class", "comp")] + [pa.array(np.concatenate(items))], ["class", "comp", "item"])


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    found = store(docs.mapInArrow(_members, "doc_id long, key long, n long, class long, item long, c long"), "jaccard-members")
    members = found.where("c IS NULL").select("doc_id", "key", "n", "class")
    often = found.where("c IS NOT NULL").groupBy("item").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "item").limit(MOST).toArrow()
    comp = components(members, docs.select("key", "text"), Frequent(often.column("item").to_numpy().view(np.uint64), often.column("c").to_numpy()))
    # a class or component of one row is its own; only the others are joined
    per_class = members.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    named = per_class.join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    groups = store(named, "jaccard-named")
    least = groups.groupBy("comp").agg(F.min("least").alias("component"), F.sum("m").alias("all")).where("all > 1")
    ids = groups.join(least, "comp").select("class", "component")
    return members.join(ids, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6(docs: DataFrame) -> DataFrame:
    return link(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns. Rows that share that id stay unless
    their texts are equal; rows without an id cannot be told apart by one and stay."""
    key = fresh(docs, "id")
    found = store(link(docs).select("doc_id", "component_id").where("doc_id <=> component_id"), "jaccard-firsts")
    ids = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("rows"))
    ids = store(ids, "jaccard-ids")

    def of(chosen: DataFrame) -> DataFrame:
        """The rows with the chosen ids; the ids are broadcast while they are few, so that texts need not be shuffled."""
        right = F.broadcast(chosen) if small(chosen, BROADCAST_ROWS) else chosen
        return docs.join(right, docs["doc_id"] == right[key], "left_semi")

    kept = of(ids.where("rows = 1").select(key)).unionByName(of(ids.where("rows > 1").select(key)).dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
