import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import AWKWARD, corpus, frame
from tidemark.llm import ngram_lm as L
from tidemark.llm.elias_fano import EliasFano, Trie, quantise

END, START = object(), object()


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def brute(docs):
    held = [zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 10 == 0 for d in docs]
    words, pairs, before = Counter(), Counter(), Counter()
    for d, h in zip(docs, held):
        if not h:
            t = tokens(d["text"])
            words.update(t)
            before.update([START, *t[:-1]])
            pairs.update(zip([START, *t[:-1]], t))
    n, v = sum(words.values()), len(words)
    p = lambda w: (words[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for d, h in zip(docs, held):
        t = tokens(d["text"])
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10((pairs[u, w] + L.MU * p(w)) / (before[u] + L.MU)) for u, w in zip([START, *t[:-1]], t))
        out.append((str(d["doc_id"]), h, len(t), sum(words[w] > 0 for w in t), n, base, score))
    return sorted(out, key=lambda r: r[:4])


def check(spark_docs, docs):
    got = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in L.op2(spark_docs).collect()), key=lambda r: r[:4])
    want = brute(docs)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)  # fewer than 65,536 different values: quantised without loss


def test_awkward(spark):
    docs = frame(spark, AWKWARD)
    check(docs, docs.collect())
    check(docs.selectExpr("*", "1 AS h", "2 AS b", "3 AS block", "4 AS held_out", "5 AS n_tokens"), docs.collect())
    assert L.op2(frame(spark, [])).count() == 0


@pytest.mark.parametrize("heavy, shard, frequent", [(4096, 10**9, 16), (20, 5000, 10**9), (300, 20000, 2)])
def test_corpus(spark, sf, monkeypatch, heavy, shard, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "HEAVY", heavy)
    monkeypatch.setattr(L, "SHARD_TOKENS", shard)
    check(spark.read.parquet(f"{sf}/documents.parquet"), corpus(sf))


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = L.op2(docs).where("held_out").groupBy().sum("score", "base_score").first()
    assert held[0] > held[1]


def test_elias_fano():
    """Select and successor search on the coded form against the plain sequence."""
    rng = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], [2**64 - 1], [0, 2**64 - 1], np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64)), np.sort(rng.integers(0, 300, 2000, dtype=np.uint64)), np.arange(5000) * 7):
        values = np.array(values, np.uint64)
        coded = EliasFano.encode(values)
        at = np.arange(len(values))
        assert (coded[at] == values).all()
        near = np.concatenate([values, values + np.uint64(1), values - np.uint64(1), rng.integers(0, 2**64, 50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        place, there = coded.find(near)
        want = np.searchsorted(values, near)
        assert (place == want).all() and (there == np.isin(near, values)).all()
        if len(values) > 10:
            begin = rng.integers(0, len(values), len(near))
            end = np.minimum(begin + rng.integers(0, 9, len(near)), len(values))
            place, there = coded.find(near, begin, end)
            assert (place == np.clip(want, begin, end)).all()
            assert there.tolist() == [x in values[a:z] for x, a, z in zip(near, begin, end)]


def test_trie_and_quantiser(monkeypatch):
    from tidemark.llm import elias_fano

    monkeypatch.setattr(elias_fano, "SLICE", 100)
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 2**64, (500, 2), dtype=np.uint64) % np.uint64(60) * np.uint64(2**58), axis=0)
    values = rng.normal(size=len(pairs))
    keys, below = (np.unique(pairs[:, i], return_inverse=True) for i in (0, 1))
    trie = Trie.build(keys[0], below[0], keys[1], below[1], values)
    words, contexts = (np.unique(np.concatenate([pairs[:, i], pairs[:, i] + np.uint64(1)])) for i in (0, 1))
    w, c = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(contexts))))
    have = {(int(a), int(b)): v for (a, b), v in zip(pairs, values)}
    want = np.array([have.get((int(words[i]), int(contexts[j])), np.nan) for i, j in zip(w, c)])
    assert np.allclose(trie.lookup(words, w, contexts, c), want, equal_nan=True)
    nothing = Trie.build(*np.zeros((2, 0), np.uint64), *np.zeros((2, 0), np.int64), np.zeros(0))
    assert np.isnan(nothing.lookup(words, w, contexts, c)).all()


def test_trie_is_compact():
    """The coded levels, directory and all, take less than half of the plain arrays; queries need bounded room beside."""
    import tracemalloc

    rng = np.random.default_rng(3)
    n = 400_000
    words, contexts = np.sort(rng.integers(0, 2**64, 3000, dtype=np.uint64)), np.sort(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    code = np.unique(rng.integers(0, 3000 * 3000, n))
    w, c = words[code // 3000], contexts[code % 3000]
    trie = Trie.build(words, contexts, code // 3000, code % 3000, np.log(rng.random(len(code))))
    assert trie.size < 0.45 * (w.nbytes + c.nbytes)
    a, b = code // 3000, code % 3000
    tracemalloc.start()
    found = trie.lookup(words, a, contexts, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not np.isnan(found).any() and peak < 8 * len(code) + 200 * 200_000


def test_score_is_as_exact_as_its_quantised_parts():
    codes, centres = quantise(np.array([0.1, 0.2, 0.2, 0.7]))
    assert centres[codes].tolist() == [0.1, 0.2, 0.2, 0.7]
    rng = np.random.default_rng(5)
    many = rng.normal(size=200_000)
    codes, centres = quantise(many, 256)
    assert len(centres) == 256 and np.abs(centres[codes] - many).mean() < 0.02
