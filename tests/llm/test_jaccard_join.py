import random
import re
from collections import defaultdict

import pytest

from tests.llm.fixtures import AWKWARD, corpus, frame
from tidemark.llm import jaccard_join as J


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    """(n_shingles, component_id) of each document, by comparing every pair that shares a shingle."""
    sets = [shingle_set(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    shared = defaultdict(int)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None and sets[i]:
            least[find(i)] = min(d["doc_id"], least.get(find(i), d["doc_id"]))
    return sorted((str(d["doc_id"]), len(sets[i]), least.get(find(i)) if sets[i] else d["doc_id"]) for i, d in enumerate(docs))


def got(docs):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.op6(docs).collect())


def copies(seed, n, words, edits, families=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(n):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


def test_awkward(spark):
    docs = frame(spark, AWKWARD + ["A b C d E f", "a b c d e f", "a b c d e f g", "One Two Three"])
    assert got(docs) == brute(docs.collect())
    assert J.op6(frame(spark, [])).count() == 0


def test_corpus(spark, sf):
    assert got(spark.read.parquet(f"{sf}/documents.parquet")) == brute(corpus(sf))


@pytest.mark.parametrize("chunk", [3, 1000])
def test_near_copies_around_the_threshold(spark, monkeypatch, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    texts = copies(1, 12, 60, 4, 3) + copies(2, 8, 24, 2, 4) + copies(3, 6, 9, 1, 6)
    docs = frame(spark, texts)
    assert got(docs) == brute(docs.collect())


def test_chain_of_links(spark, monkeypatch):
    """Neighbours are linked, ends are far apart, and all share a passage."""
    monkeypatch.setattr(J, "CHUNK", 4)
    texts = [" ".join([f"x{k}" for k in range(i, i + 40)] + [f"common{k}" for k in range(12)]) for i in range(0, 60, 3)]
    docs = frame(spark, texts)
    assert got(docs) == brute(docs.collect())


def test_parcels_in_two_steps(spark, monkeypatch):
    """Many shards, each block makes few parcels."""
    monkeypatch.setattr(J, "FAN", 3)
    monkeypatch.setattr(J, "SHARD_SHINGLES", 40)
    monkeypatch.setattr(J, "BLOCK_BYTES", 3000)
    docs = frame(spark, copies(4, 10, 60, 4, 4) + AWKWARD)
    assert got(docs) == brute(docs.collect())


@pytest.mark.parametrize("chunk", [10, 1000])
def test_one_phrase_in_all_documents(spark, monkeypatch, chunk):
    """Half of the documents are mostly the phrase, so that it stands in their prefixes; few are linked."""
    monkeypatch.setattr(J, "CHUNK", chunk)
    rng = random.Random(8)
    phrase = " ".join(f"p{k}" for k in range(30))
    own = lambda n: " ".join(f"q{rng.randrange(10**9)}" for _ in range(n))
    texts = [f"{own(rng.randrange(4))} {phrase} {own(rng.randrange(16))}" for _ in range(120)] + [f"{own(90)} {phrase}" for _ in range(120)]
    docs = frame(spark, texts)
    assert got(docs) == brute(docs.collect())


def test_trie_join_against_all_pairs():
    import numpy as np

    rng = random.Random(5)
    for _ in range(150):
        bases = [rng.sample(range(1, 200), rng.randrange(1, 20)) for _ in range(3)]
        sets = []
        for _ in range(rng.randrange(1, 25)):
            s = set(rng.choice(bases))
            for _ in range(rng.randrange(4)):
                s ^= {rng.randrange(1, 200)}
            sets += [s] if s else []
        if not sets:
            continue
        often = defaultdict(int)
        for s in sets:
            for v in s:
                often[v] += 1
        arrays = [np.array(sorted(s, key=lambda v: (-often[v], v)), np.uint64) for s in sets]
        forest, _ = J.trie_join(arrays, np.array([len(s) for s in sets]), np.arange(len(sets)))
        root = J.Forest(np.arange(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 4 * len(a & b) >= 3 * len(a | b):
                    root.join(i, j)
        assert forest.root.tolist() == root.root.tolist()


def test_one_of_each(spark):
    docs = frame(spark, ["a b c d e f g"] * 5 + ["other words"] + [None, ""])
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 5, 6, 7]


def test_one_of_each_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, ["a b c d e f g"] * 3 + ["other words"])
    for name in ("_id", "id", "rows", "class", "component_id", "n"):
        docs = docs.withColumn(name, F.lit(name))
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3]
    assert sorted(r["component_id"] for r in J.op6(docs).collect()) == [0, 0, 0, 3]


def test_very_long_text(spark):
    long = " ".join(f"v{k}" for k in range(300_000))
    rows = J.op6(frame(spark, [long, long + " more", "short text of a few words only"])).collect()
    assert sorted((r["n_shingles"], r["component_id"]) for r in rows) == [(3, 2), (299_996, 0), (299_997, 0)]


def test_shuffle_with_many_shards(spark, monkeypatch):
    """With about one shingle a class and shard, as large tables have, what is shuffled stays small, and links are found."""
    monkeypatch.setattr(J, "SHARD_SHINGLES", 1000)
    rng = random.Random(11)
    own = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) for _ in range(1000)]
    docs = J.store(frame(spark, own + own[:10] + [t + " more" for t in own[10:20]]), "test")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    rows = {r["doc_id"]: r["component_id"] for r in J.op6(docs).collect()}
    assert rows == {i: i - 1000 if i >= 1000 else i for i in range(1020)}
    sent = written() - before
    assert sent < 7 * 56 * 1020  # bytes a shingle
