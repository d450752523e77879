import math
import re
from collections import Counter

import xxhash

from tests.llm.fixtures import AWKWARD, corpus, frame
from tidemark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}
    return out | {"base_failed": len(w) < 50 or 100 * len(inside) > 50 * len(w)}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_rules(spark):
    texts = AWKWARD + ["a b c a b c d e f", "a a a a", "one two three four one two three x one two three", "x\n\n \nx\nX\ny\ny ", "## a $%| <b> & *"]
    docs = frame(spark, texts)
    got = Q.op4(docs, labels(spark, [(7, 1, 0)])).collect()
    want = sorted((str(r["doc_id"]), sorted(base(r["text"]).items())) for r in docs.collect())
    assert sorted((str(r["doc_id"]), sorted((k, r[k]) for k in base(""))) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_corpus_against_brute_force(spark, sf):
    docs, marks = corpus(sf), corpus(sf, "labels")
    got = {r["doc_id"]: r for r in Q.op4(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert {k: got[d["doc_id"]][k] for k in base("")} == base(d["text"])
    # the ratios by plain counting of strings that the buckets stand for
    bad = {m["doc_id"] for m in marks if m["quality"] == 0}
    good = {m["doc_id"] for m in marks if m["quality"] == 1 and not m["toxic"]}
    kept = lambda ids: sum(got[i]["kept"] for i in ids) / len(ids)
    long_enough = {i for i in good if not got[i]["base_failed"]}
    assert kept(long_enough) >= 0.98 and kept(bad) <= 0.15


def test_ratios(spark):
    docs = frame(spark, ["a b", "a c", None, "", "a b c"])
    n = 50
    got = Q.log_ratios(docs, labels(spark, [(0, 1, 0), (0, 1, 0), (9, 1, 0)]), n=n)
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", Q.buckets(Q.words(F.col("text")), n).alias("g")).collect()
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(r["g"])
        target.update(r["g"] if r["doc_id"] == 0 else [])
    assert sum(raw.values()) == 3 + 3 + 5 and sum(target.values()) == 3
    for b in range(n):
        want = math.log((target[b] + 1) / (3 + n)) - math.log((raw[b] + 1) / (11 + n))
        assert abs(got[b] - want) < 1e-9
    scores = docs.select("doc_id", Q.llr(Q.words(F.col("text")), got).alias("s"), Q.buckets(Q.words(F.col("text")), n).alias("g")).collect()
    for r in scores:
        assert abs(r["s"] - (sum(got[b] for b in r["g"]) / len(r["g"]) if r["g"] else 0)) < 1e-6


def bucket(*words):
    """The engine's seeded 64-bit hash of one or two words, counted again."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return (h - 2**64 if h >= 2**63 else h) % 10_000


def brute_kept(docs, marks):
    """(llr, kept) of every document by plain counting over the whole table."""
    good = {m["doc_id"] for m in marks if m["quality"] == 1 and not m["toxic"]}
    grams = []
    for d in docs:
        w = WORD.findall(d["text"] or "")
        grams.append([bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])])
    raw, target = Counter(), Counter()
    for d, g in zip(docs, grams):
        raw.update(g)
        target.update(g if d["doc_id"] in good else [])
    n, m = sum(raw.values()) + 10_000, sum(target.values()) + 10_000
    ratio = {b: math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in raw}
    llr = [sum(ratio[b] for b in g) / len(g) if g else 0.0 for g in grams]
    return [(x, not base(d["text"])["base_failed"] and x >= -0.06) for x, d in zip(llr, docs)]


def test_whole_query_against_brute_force(spark, sf):
    docs = corpus(sf)
    got = {r["doc_id"]: r for r in Q.op4(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    for d, (llr, kept) in zip(docs, brute_kept(docs, corpus(sf, "labels")), strict=True):
        r = got[d["doc_id"]]
        assert abs(r["llr"] - llr) < 1e-6 and (r["kept"] == kept or abs(llr + 0.06) < 1e-6)


def test_without_labels_the_base_rules_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for marks in (labels(spark, []), labels(spark, [(1, 0, 0), (10**9, 1, 0), (None, 1, 0)])):
        assert all(r["kept"] != r["base_failed"] and r["llr"] == 0 for r in Q.op4(docs, marks).collect())


def test_clashing_columns_and_long_text(spark):
    docs = frame(spark, AWKWARD + ["one two three four " * 50_000])
    marks = labels(spark, [(7, 1, 0)])
    clash = docs.selectExpr("*", "1 AS _words", "2 AS _id", "3 AS kept", "4 AS llr", "5 AS quality", "6 AS _t")
    assert sorted(map(str, Q.op4(clash, marks).collect())) == sorted(map(str, Q.op4(docs, marks).collect()))


def test_empty(spark):
    assert Q.op4(frame(spark, []), labels(spark, [])).count() == 0
