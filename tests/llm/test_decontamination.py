import random

import numpy as np

from tests.llm.fixtures import AWKWARD, corpus, frame
from tidemark.llm import decontamination as D


def brute_edits(item, text):
    """Fewest edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_corpus(spark, sf):
    docs, items = corpus(sf), corpus(sf, "benchmark")
    got = {(r["doc_id"], r["item_id"]): r for r in D.op7(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in items if d["text"] and D.normal(b["text"]) in D.normal(d["text"])}
    assert set(got) == want and all(r["n_edits"] == 0 for r in got.values())
    texts = {d["doc_id"]: D.normal(d["text"]) for d in docs}
    questions = {b["item_id"]: D.normal(b["text"]) for b in items}
    for (d, i), r in got.items():
        assert texts[d][r["start"] : r["end"]] == questions[i]


def test_edits_against_full_alignment():
    rng = random.Random(7)
    letters = "abcdefgh   "
    for trial in range(40):
        item = "".join(rng.choice(letters) for _ in range(rng.randrange(40, 140)))
        item = D.normal("x" + item + "x")
        k = D.budget(len(item))
        s = list(item)
        for _ in range(rng.randrange(0, 2 * k + 2)):
            p = rng.randrange(len(s))
            kind = rng.randrange(3)
            if kind == 0:
                s[p] = rng.choice(letters)
            elif kind == 1:
                del s[p]
            else:
                s.insert(p, rng.choice(letters))
        noise = lambda: "".join(rng.choice("mnopqrst ") for _ in range(60))
        text = D.normal(noise() + "".join(s) + noise())
        found = D.Index([(1, item)]).search(text)
        true = brute_edits(item, text)
        assert bool(found) == (true <= k), (trial, true, k)
        if found:
            assert found[0][3] == true


def test_align_alone():
    item, text = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in ("kitten sitting", "the kittn siitting there"))
    assert D.align(item, text, -5, 10)[0] == 2


def test_blocks_and_awkward(spark, monkeypatch):
    passage = "What is the airspeed velocity of an unladen swallow over the channel"
    docs = frame(spark, AWKWARD + [f"pre {passage.upper()} post", passage.replace(" ", "\n\t"), "Short item", "has short item inside", passage * 3])
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "short ITEM"), (5, "something that no document has in it at all"), (None, "x")], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    n = len(AWKWARD)
    want = {(n, 1), (n + 1, 1), (n + 2, 4), (n + 3, 4), (n + 4, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in D.op7(docs, bench).collect()} == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 50)
    assert {(r["doc_id"], r["item_id"]) for r in D.op7(docs, bench).collect()} == want
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    assert D.op7(frame(spark, []), bench).count() == 0
    assert D.op7(docs, bench.where("false")).count() == 0


def test_short_items(spark):
    """Items of any length are found inside texts, whole and at word ends only."""
    texts = ["the answer is 42 of them", "the answer is 421", "What is two plus two? Four.", "what is two plus twomps?", "ab cd", "xab cdx", "42", None]
    bench = spark.createDataFrame([(1, "42"), (2, "What is two  plus two?"), (3, "AB CD"), (4, "is 42"), (5, "two plus two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["end"], r["n_edits"]) for r in D.op7(frame(spark, texts), bench).collect()}
    assert got == {(0, 1, 14, 16, 0), (6, 1, 0, 2, 0), (0, 4, 11, 16, 0), (2, 2, 0, 21, 0), (2, 5, 8, 20, 0), (4, 3, 0, 5, 0)}


def test_hot_grams(monkeypatch):
    """Many items that share a long part, and a text that repeats it: few candidates, the right ones found."""
    lead = "answer the following question about numbers as well as you can "
    items = [(i, lead + f"what comes after {i:05d} and before {i * 7 + 3:06d} in this row of numbers") for i in range(200)]
    index = D.Index(items)
    text = D.normal(lead * 20 + items[17][1] + " " + lead * 20 + items[199][1])
    monkeypatch.setattr(D, "SLICE", 500)
    found = {i: (s, e, d) for i, s, e, d in index.search(text)}
    exact = {i for i, (_, _, d) in found.items() if not d}
    assert exact == {17, 199}
    for i, (s, e, d) in found.items():
        assert d <= D.budget(len(items[i][1])) and d == brute_edits(D.normal(items[i][1]), text[s:e])


def test_rows_without_id_and_clashing_columns(spark):
    passage = "Name the longest river that flows through three capitals in turn, and say why"
    docs = frame(spark, [passage, "other words", (None, "see: " + passage, "en", None, 1), (None, "fine", None, None, None), (7, passage, None, None, None), (7, "clean text of the same id", None, None, None)])
    docs = docs.selectExpr("*", "1 AS _bad", "2 AS item_id", "3 AS start", "named_struct('a', 1) AS n_edits")
    kept = D.clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.schema == docs.schema and sorted(r["text"] for r in kept.collect()) == ["clean text of the same id", "fine", "other words"]


def test_very_long_text():
    passage = "Name the longest river that flows through three capitals in turn, and say why"
    text = "some filler words " * 100_000 + passage
    (found,) = D.Index([(1, passage)]).search(text)
    assert found[3] == 0 and text[found[1] : found[2]] == passage
