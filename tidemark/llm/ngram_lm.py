"""LM scoring: a bigram model in Elias-Fano tries, sharded so that building and querying need one exchange.

p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), is a proper distribution
over the V training tokens and one unknown token. Its logarithm splits into a part that only the trie below w has,
log(c(v w) + MU p(w)), and one that depends on v alone, -log(c(v) + MU). So every token goes to the shard of its
own word with the word before it; there it adds the first part for itself and the second in its role as the context
of the next token. A shard counts its training tokens, codes the trie's levels into one memory map (monotone pointers,
Elias-Fano levels, quantised log values), and looks up all its tokens in the coded levels by context-relative successor
search. Nothing is written to an executor's disk.

A first pass counts words per block of documents and sums them: N, V, and the HEAVY most frequent words, a number that
does not grow; any other word has at most N / HEAVY tokens. It also finds up to HEAVY likely frequent pairs, which a
second pass counts. With these counts known everywhere, frequent pairs are scored where they stand and never travel,
and the frequent words' other tokens are dealt to shards by the pair, so that no word or pair makes a shard large. Tokens
travel as blocks of documents' worth of arrays, each distinct hash once a block. Words are told apart by 64-bit hashes.

The order is two because the logarithm splits for pairs only: smoothing with three words needs the count of the middle
word, which is known where that word is, in another shard, so that each token would travel once more.

Null texts count as empty and consist of the end token alone. Texts of any length are scored whole; a longer one makes a
larger block. Rows with equal ids are scored one by one; a null id is hashed as an empty text. Equal counts are told
apart by hash where the most frequent are chosen. An empty table gives an empty result. Only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.elias_fano import Trie
from tidemark.llm.shared import store
from tidemark.llm.tokens import Vocabulary, fold_of, mixed, release, rows_of, words_of

FOLDS = 10
ALPHA = 0.1
MU = 10.0
HEAVY = 4096
#: Hashes of the end token and of what stands before the first word; no word of a text is meant by them.
END, START = 0x6F1D_5A3C_9B27_E481, 0x1B84_C7E2_36A9_5FD0
BLOCK_BYTES = 8_000_000
BLOCK_DOCS = 32_000  # a number and a mark fit into 16 bits
SHARD_TOKENS = 2_200_000
FREQUENT = 16
META, SUMS, TOKENS = 0, 1, 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Documents in blocks of bounded text."""
    ids, texts, held = [], [], 0
    for doc_id, text in rows_of(batches, "doc_id", "text"):
        ids.append(doc_id)
        texts.append(text)
        held += len(text or "")
        if held > BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
            yield ids, texts
            ids, texts, held = [], [], 0
            release()
    if ids:
        yield ids, texts
    release()


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the local vocabulary, token, token before, tokens of each text); 0 is the end, 1 the start."""
    vocabulary = Vocabulary(END, START)
    numbers = []
    for text in texts:
        numbers += [vocabulary.numbers(words_of(text)).astype(np.int32), np.zeros(1, np.int32)]
    token = np.concatenate(numbers)
    ends = np.flatnonzero(token == 0)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[0] = 1
    before[ends[:-1] + 1] = 1
    return vocabulary.array(), token, before, np.diff(ends, prepend=-1)


def _training(ids: list) -> np.ndarray:
    return np.array([fold_of(i, FOLDS) != 0 for i in ids])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the training words of each block, by hash, and of the pairs that are frequent within the block: a pair
    with a HEAVY-th of all tokens is that frequent in some block at least."""
    for ids, texts in _blocks(batches):
        hashes, token, before, lengths = _tokens(texts)
        learns = np.repeat(_training(ids), lengths)
        token, before = token[learns], before[learns]
        count = np.bincount(token, minlength=len(hashes))
        seen = np.flatnonzero(count)
        codes, often = np.unique(token.astype(np.int64) << 32 | before, return_counts=True)
        frequent = often >= max(FREQUENT, len(token) / HEAVY)
        codes, often = codes[frequent], often[frequent]
        first = np.concatenate([hashes[seen], hashes[codes >> 32]]).view(np.int64)
        second = np.concatenate([np.zeros(len(seen), np.uint64), hashes[codes & (2**32 - 1)]]).view(np.int64)
        pair = np.concatenate([np.zeros(len(seen), bool), np.ones(len(codes), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(pair), pa.array(np.concatenate([count[seen], often]).astype(np.int64))], ["h", "b", "pair", "c"])


def _pair_keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(mixed(words) ^ before)


def _count_pairs(pairs: np.ndarray):
    """Exact counts of the given pairs, by number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pairs), np.int64)
        for ids, texts in _blocks(batches):
            hashes, token, before, lengths = _tokens(texts)
            learns = np.repeat(_training(ids), lengths)
            at, there = _places(pairs, _pair_keys(hashes[token[learns]], hashes[before[learns]]))
            total += np.bincount(at[there], minlength=len(pairs))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "c"])

    return count


def _places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted values stand among the known ones, which are sorted, and whether they do."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x.nbytes for x in arrays]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at = 8 * (n + 1)
    out = []
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


class Frequent:
    """What every task knows: the totals, and the exact counts of the most frequent words and pairs."""

    def __init__(self, total: int, vocabulary: int, words: dict[int, int], pairs: dict[int, int]):
        self.total, self.vocabulary = total, vocabulary
        split = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], np.float64))
        self.words, self.word_counts = split(words)
        self.pairs, self.pair_counts = split(pairs)

    def p(self, count: np.ndarray) -> np.ndarray:
        return (count + ALPHA) / (self.total + ALPHA * (self.vocabulary + 1))


def _planes(x: np.ndarray) -> np.ndarray:
    """Numbers by bytes, most telling first, without the lowest two: they keep 37 bits, 7e-12 of their size."""
    bits = (np.ascontiguousarray(x, np.float64).view(np.uint64) + np.uint64(0x8000)) >> np.uint64(16)
    return np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 8)[:, 5::-1].T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    bits = np.zeros((planes.size // 6, 8), np.uint8)
    bits[:, 7:1:-1] = planes.reshape(6, -1).T
    return bits.view(np.float64).ravel()


def _sums(score: tuple[np.ndarray, np.ndarray] | None, base: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> bytes:
    """The sums of score, and of base and known, for those documents that have tokens here."""
    out = []
    for columns in (score, base):
        doc, *values = columns or (np.zeros(0, np.uint16), np.zeros(0), np.zeros(0))[: 2 if columns is score else 3]
        some = np.flatnonzero(np.bincount(doc)) if len(doc) else np.zeros(0, np.int64)
        sums = [np.bincount(doc, x)[some] if len(some) else np.zeros(0) for x in values]
        out += [some.astype(np.uint16), _planes(sums[0])] + [x.astype(np.uint32) for x in sums[1:]]
    return _pack(*out[:4], *_narrow(out[4]))


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low and the high halves of counts, of which the high ones are mostly zero."""
    return (counts & 0xFFFF).astype(np.uint16), (counts >> 16).astype(np.uint16)


def _role(token_is_end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What a token takes off as the context of the next one; nothing comes after the end."""
    return np.where(token_is_end, 0.0, np.log10(count + MU))


def _dealer(known: Frequent, shards: int):
    """Turns documents into blobs of tokens for each shard; frequent pairs are scored at once, as their counts are known,
    and go with the documents' own row to a shard that only passes them on."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

        def row(shard: int, block: int, kind: int, n: int, blob: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, block, kind, n, blob), schema.types, strict=True)], schema=schema)

        for serial, (ids, texts) in enumerate(_blocks(batches)):
            block = (part << 24) | serial
            hashes, token, before, lengths = _tokens(texts)
            train = _training(ids)
            doc = np.repeat((np.arange(len(ids)) << 1 | train).astype(np.uint16), lengths)  # the lowest bit marks training documents
            meta = _pack(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), train.astype(np.uint8), lengths.astype(np.int64))
            yield row(block % shards, block, META, len(ids), meta)

            place, spread = _places(known.words, hashes)
            count = np.where(spread, known.word_counts[place] if len(known.words) else 0.0, 0.0)
            there = spread[token]  # what is known of frequent words is added at once
            base = doc[there] >> 1, np.log10(count + ALPHA)[token[there]], (count > 0)[token[there]]
            at, often = _places(known.pairs, _pair_keys(hashes[token], hashes[before]))
            often &= there  # a frequent pair's word is frequent, unless others are more so
            score = None
            if often.any():
                words = token[often]
                parts = np.log10(known.pair_counts[at[often]] + MU * known.p(count[words])) - _role(words == 0, count[words])
                score = doc[often] >> 1, parts
            yield row(block % shards, block, SUMS, len(ids), _sums(score, base))
            token, before, doc = token[~often], before[~often], doc[~often]
            del base, score, there, at, often
            own = mixed(hashes)
            where = own[token]
            pairs = spread[token]
            where[pairs] = mixed(where[pairs] ^ hashes[before[pairs]])
            shard = (where % np.uint64(shards)).astype(np.int32)
            del where, pairs
            order = np.lexsort((token, shard))
            token, before, doc, shard = token[order], before[order], doc[order], shard[order]
            bounds = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                words, runs = np.unique(token[a:b], return_counts=True)
                near, place = np.unique(before[a:b], return_inverse=True)
                blob = _pack(hashes[words], runs.astype(np.uint32), hashes[near], place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy(), doc[a:b])
                yield row(int(shard[a]), block, TOKENS, len(ids), blob)

    return deal


def _scorer(known: Frequent):
    """Counts, builds and queries one shard; gives the sums of each block's documents."""

    def score(table: pa.Table) -> pa.Table:
        block, kind, size, data = (table.column(k).to_pylist() for k in ("block", "kind", "n", "data"))
        out = {"block": [], "n": [], "kind": [], "data": []}

        def put(*values) -> None:
            for k, v in zip(out, values, strict=True):
                out[k].append(v)

        parts = []
        for b, what, n, blob in zip(block, kind, size, data, strict=True):
            if what != TOKENS:
                put(b, n, what, blob)
                continue
            words, runs, near, place, doc = _unpack(blob, np.uint64, np.uint32, np.uint64, np.uint8, np.uint16)
            parts.append((b, n, words, runs, near, place.reshape(4, -1).T.copy().view(np.uint32).ravel(), doc))
        if parts:
            # parcels have each hash once: numbers are given to these, and then to the tokens
            keys, word = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            near, before = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
            word = np.repeat(word.astype(np.int32), np.concatenate([p[3] for p in parts]))
            starts = np.cumsum([0] + [len(p[4]) for p in parts])[:-1]
            before = before.astype(np.int32)[np.concatenate([p[5] + np.uint32(s) for p, s in zip(parts, starts, strict=True)])]
            doc = np.concatenate([p[6] for p in parts])
            parts = [(b, n, len(d)) for b, n, _, _, _, _, d in parts]
            learns = (doc & 1).astype(bool)
            count = np.bincount(word[learns], minlength=len(keys)).astype(np.float64)
            at, frequent = _places(known.words, keys)
            count[frequent] = known.word_counts[at[frequent]]
            p = known.p(count)
            pairs = np.sort(word[learns].astype(np.int64) << 32 | before[learns])
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            often = np.diff(np.append(first, len(pairs)))
            pairs = pairs[first]
            w, v = pairs >> 32, pairs & (2**32 - 1)
            trie = Trie.build(keys, near, w, v, np.log10(often + MU * p[w]))
            del pairs, first, often, w, v, learns
            found = trie.lookup(keys, word, near, before)
            del trie, before
            unseen = np.isnan(found)
            found[unseen] = np.log10(MU * p)[word[unseen]]
            found -= _role(keys == np.uint64(END), count)[word]
            base, seen = np.log10(count + ALPHA), count > 0
            a = 0
            for b, n, size in parts:
                z = a + size
                d, t = doc[a:z] >> 1, word[a:z]
                rare = ~frequent[t]  # the documents' own rows have the others
                put(b, n, SUMS, _sums((d, found[a:z]), (d[rare], base[t[rare]], seen[t[rare]])))
                a = z
        release()
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())]))

    return score


def _adder(total: float, vocabulary: float, documents: float):
    floor = np.log10(total + ALPHA * (vocabulary + 1)) if total + vocabulary else 0.0
    opening = np.log10(documents + MU)

    def add(table: pa.Table) -> pa.Table:
        """The rows of one block from its shards' sums."""
        n = table.column("n")[0].as_py()
        score, base, known, meta = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), None
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind == META:
                meta = _unpack(blob, np.int64, np.uint8, np.uint8, np.int64)
            else:
                some, s, rare, b, low, high = _unpack(blob, np.uint16, np.uint8, np.uint16, np.uint8, np.uint16, np.uint16)
                score[some] += _numbers(s)
                base[rare] += _numbers(b)
                known[rare] += low + (high.astype(np.int64) << 16)
        ids, there, train, tokens = meta
        return pa.table({
            "doc_id": pa.array(ids, mask=there == 0), "held_out": pa.array(train == 0), "n_tokens": pa.array(tokens), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(n, int(total))), "base_score": pa.array(base - tokens * floor), "score": pa.array(score - opening),
        })

    return add


def _unsigned(value: int) -> int:
    return value % 2**64


def statistics(docs: DataFrame) -> tuple[Frequent, int]:
    """What all tasks need to know, and the number of training documents. A bounded number of rows comes to the driver."""
    counts = store(docs.mapInArrow(_count, "h long, b long, pair boolean, c long").groupBy("h", "b", "pair").agg(F.sum("c").alias("c")), "lm-counts")
    words = counts.where("NOT pair")
    ends = F.coalesce(F.sum(F.when(F.col("h") == (END - 2**64 if END >= 2**63 else END), F.col("c"))), F.lit(0))
    total, vocabulary, documents = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), ends).first()
    top = {_unsigned(r["h"]): r["c"] for r in words.orderBy(F.desc("c"), "h").limit(HEAVY).collect()}
    likely = counts.where("pair").orderBy(F.desc("c"), "h", "b").limit(HEAVY).collect()
    keys = np.unique(_pair_keys(*(np.array([_unsigned(r[k]) for r in likely], np.uint64) for k in ("h", "b"))))
    exact = docs.mapInArrow(_count_pairs(keys), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect() if len(keys) else []
    return Frequent(total, vocabulary, top, {int(keys[r["k"]]): r["c"] for r in exact}), documents


def op2(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    known, documents = statistics(docs)
    shards = max(1, round(known.total / SHARD_TOKENS))
    dealt = docs.mapInArrow(_dealer(known, shards), "shard int, block long, kind int, n long, data binary")
    # a partition a shard, and as many for the blocks
    sums = dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_scorer(known), "block long, n long, kind int, data binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sums.repartition(shards, "block").groupBy("block").applyInArrow(_adder(known.total, known.vocabulary, documents), schema)
