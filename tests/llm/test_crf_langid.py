import zlib

import numpy as np

from tests.llm.fixtures import AWKWARD, corpus, frame
from tidemark.llm import crf_langid as C


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    k, steps = 3, 4
    emit, move, start = rng.normal(size=(2, steps, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    mask = np.array([[True] * 4, [True, True, False, False]])
    post, pairs = C.forward_backward(emit, move, np.exp(start), mask)
    all_pairs = np.zeros((k, k))
    for c in range(2):
        n = int(mask[c].sum())
        total, marginal, both = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in product(range(k), repeat=n):
            w = np.exp(start[path[0]] + sum(emit[c, i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                marginal[i, y] += w
            for a, b in zip(path, path[1:]):
                both[a, b] += w
        assert np.allclose(post[c, :n], marginal / total)
        all_pairs += both / total
    assert np.allclose(pairs, all_pairs)


def test_pieces_are_one_chain():
    """Cut into pieces or not, the marginals are those of the whole chain."""
    rng = np.random.default_rng(1)
    k, steps = 3, 5
    lengths = [1, 5, 6, 23, 10, 0]
    move, start = rng.normal(size=(k, k)), rng.normal(size=k)
    pieces = np.array([-(-n // steps) for n in lengths])
    emit, mask, whole = np.zeros((pieces.sum(), steps, k)), np.zeros((pieces.sum(), steps), bool), []
    for n, first in zip(lengths, np.cumsum(pieces) - pieces, strict=True):
        one = rng.normal(size=(n, k)) * 3
        for i in range(n):
            emit[first + i // steps, i % steps], mask[first + i // steps, i % steps] = one[i], True
        if n:
            whole.append(C.forward_backward(one[None], move, np.exp(start), np.ones((1, n), bool))[0][0])
    post = C.long_chains(emit, move, start, mask, pieces)
    assert np.allclose(post[mask], np.concatenate(whole))


def plain_scores(model, text):
    """The share of each language in the marginals of a text's words, one word at a time."""
    words = [w for w in (text or "").encode().lower().split()]
    k, full = len(model.languages), 2**64
    emissions = []
    for w in words:
        marked, total, n_grams = b"\x02" + w + b"\x03", np.zeros(k), 0
        for n in range(1, C.GRAMS + 1):
            for i in range(len(marked) - n + 1):
                code = 0
                for c in marked[i : i + n]:
                    code = (code * 257 + c) % full
                h = (code * 8 + n) % full
                h ^= h >> 31
                h = h * 0x9E3779B97F4A7C15 % full
                h ^= h >> 29
                total += model.grams[h >> (64 - C.BITS)]
                n_grams += 1
        letters = any(map(str.isalpha, w.decode()))
        emissions.append((total / n_grams**0.5 + model.entries[model.lexicon.get(w, 0)]) * letters)
    votes = [any(map(str.isalpha, w.decode())) for w in words]
    forth, back = [], [np.zeros(k)]
    for i, e in enumerate(emissions):
        forth.append(e + (model.start if not i else np.logaddexp.reduce(forth[-1][:, None] + model.move, 0)))
    for e in emissions[:0:-1]:
        back.append(np.logaddexp.reduce(model.move + (e + back[-1])[None], 1))
    post = [np.exp(f + b - np.logaddexp.reduce(f + b)) for f, b in zip(forth, reversed(back), strict=False)]
    return sum((p for p, v in zip(post, votes, strict=True) if v), np.zeros(k))


def test_whole_table_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = C.fit(docs)
    got = {r["doc_id"]: r for r in C.op3(docs).collect()}
    assert len(got) == len(corpus(sf))
    for d in corpus(sf):
        share, r = plain_scores(model, d["text"]), got[d["doc_id"]]
        if not share.sum():
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] == model.languages[share.argmax()] and abs(r["score"] - share.max() / share.sum()) < 1e-4


def test_repeated_id_brings_few_rows(spark, monkeypatch):
    """20,000 equal rows are one row of the sample; long texts bring their share of words from all over."""
    seen = []
    monkeypatch.setattr(C, "train", lambda texts, langs: seen.append((texts, langs)))
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = frame(spark, [(4, "the same text", "en", None, None)]).crossJoin(spark.range(20_000).select("id")).drop("id")
    docs = docs.union(frame(spark, [(i, f"text {i}", "en", None, None) for i in range(500)] + [(7, long, "fr", None, None), (7, "again", "fr", None, None), (7, long, "fr", None, None)]))
    C.fit(docs)
    (texts, langs), = seen
    assert langs.count("en") == C.PER_LANGUAGE and langs.count("fr") == 2
    words = max(texts, key=len).split()
    assert len(words) == C.WORDS and words[0] == "w0" and words[-1] == "w59999"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in C.op3(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    docs = corpus(sf)
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert {i for i, r in rows.items() if r["held_out"]} == {d["doc_id"] for d in held}
    right = [rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held if d["lang"] and d["text"]]
    assert sum(right) / len(right) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_code_switched_words():
    docs = [d for d in corpus("/root/testdata/sf0.01") if d["lang"]][:400]
    model = C.train([d["text"] for d in docs], [d["lang"] for d in docs])
    labeller = C.Labeller(model)
    words = [C.words_of("the and of that with is"), C.words_of("der die und von nicht das")]
    owner, post, _ = labeller.marginals([words[0] * 3 + words[1] * 3])
    said = [model.languages[i] for i in post.argmax(1)]
    assert said[:16].count("en") >= 15 and said[-16:].count("de") >= 15


def test_awkward(spark):
    docs = frame(spark, ["the cat and the dog", "le chat et le chien"] + AWKWARD + ["123 456", "---"])
    rows = {}
    for r in C.op3(docs).collect():
        rows.setdefault(r["doc_id"], r)
    assert [rows[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    assert rows[len(AWKWARD) + 2]["lang_pred"] == "und" and rows[len(AWKWARD) + 2]["score"] == 0
    assert rows[0]["lang_pred"] == "en"
    clash = docs.selectExpr("*", "1 AS held_out", "2 AS score", "3 AS lang_pred", "4 AS _hash", "5 AS _rank")
    assert sorted(map(str, C.op3(clash).collect())) == sorted(map(str, C.op3(docs).collect()))
    assert C.op3(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in C.op3(frame(spark, ["some text"], lang=None)).collect()} == {"und"}


def test_split_does_not_leak(spark):
    """Prediction of a text is the same whatever its own language says."""
    docs = frame(spark, [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the and of", "en"), ("der die und", "de")] * 20)])
    flipped = frame(spark, [(r["doc_id"], r["text"], None if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r["lang"], None, None) for r in docs.collect()])
    assert sorted(map(tuple, C.op3(docs).collect())) == sorted(map(tuple, C.op3(flipped).collect()))
