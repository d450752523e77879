import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.fixtures import AWKWARD, corpus, frame
from tidemark.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Share by weight, cut at the cap, share the excess again until none is above."""
    weight = {s: 1.0 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, docs):
    sizes, source = defaultdict(int), {}
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
        source[d["doc_id"]] = d["source"]
    target = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], len(WORD.findall(d["text"] or ""))) for d in docs)
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) <= 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * M.BLOCK, (s, taken[s], target[s])


def test_awkward(spark):
    docs = frame(spark, AWKWARD)
    check(M.op10(docs).collect(), docs.collect())
    assert M.op10(frame(spark, [])).count() == 0
    assert M.op10(frame(spark, [None, ""])).count() == 2


def test_corpus_and_rerun(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = M.op10(docs).collect()
    check(rows, corpus(sf))
    again = M.op10(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_shards_and_skew(spark):
    texts = [(i, "w " * (i % 50), None, "hot" if i % 3 else f"s{i % 11}", 0) for i in range(600)] + [(5, "same words here", None, "hot", 0)] * 400
    docs = frame(spark, texts)
    rows = M.mix(docs, shard_words=500).select("doc_id", "size", "source_size", "target", "taken").collect()
    by = {(r["target"], r["source_size"]): 0 for r in rows}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["target"], r["source_size"]] += r["taken"]
    for (target, _), taken in by.items():
        assert abs(taken - target) <= 0.05 * target + 2 * M.BLOCK


def test_sainte_lague(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for g in range(30):
        votes = [rng.choice([0, 1, 5, rng.randrange(1, 10**6)]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        rows += [(g, i, v, seats) for i, v in enumerate(votes)]
        have = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            have[max(range(len(votes)), key=lambda i: (votes[i] / (2 * have[i] + 1), -i))] += 1
        want |= {(g, i): h for i, h in enumerate(have)}
    got = M.sainte_lague(spark.createDataFrame(rows, "g int, i int, v long, seats long"), ["g"], ["i"], "v", "seats").collect()
    assert {(r["g"], r["i"]): r["_seats"] for r in got} == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_duckdb(spark, size):
    docs = f"/root/testdata/{size}/documents.parquet"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{docs}')")
    cursor = connection.execute(M.ORACLE)
    assert [d[0] for d in cursor.description] == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(cursor.fetchall()) == sorted(map(tuple, M.op10(spark.read.parquet(docs)).collect()))


def test_many_sources_without_one_task_for_all(spark):
    """100,000 sources: the right targets, and no exchange into a single partition."""
    from pyspark.sql import functions as F

    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 100_000).alias("source"))
    out = M.mix(docs)
    rows = out.collect()
    sizes = Counter()
    for i in range(200_000):
        sizes[f"s{i % 100_000}"] += i % 7
    target = brute_targets(sizes)
    assert len(rows) == 200_000 and all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in rows)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 2 * M.BLOCK for s, t in target.items())
    plans = [out._jdf.queryExecution().executedPlan().toString(), M.ranked(docs.select("doc_id"), "doc_id")._jdf.queryExecution().executedPlan().toString()]
    assert not any("SinglePartition" in p for p in plans)


def test_ranked(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = sorted((r["x"], r["_rank"]) for r in M.ranked(rows, "x").collect())
    assert [k for _, k in got] == list(range(1, 5001))
    assert M.ranked(rows.limit(0), "x").count() == 0


def test_mixed_carries_the_rows(spark):
    """All columns and rows are there, with what mix() takes of them; repeats of one unit share its copies."""
    docs = frame(spark, AWKWARD + [(5, f"text {i % 3} of one size", "en", "a", i) for i in range(30)]).selectExpr("*", "1 AS _row", "'x' AS taken", "2 AS _i")
    rows, out = M.mix(docs).collect(), M.mixed(docs)
    assert out.columns == [c for c in docs.columns if c != "taken"] + ["size", "source_size", "target", "taken"]
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["source_size"], r["target"], r["taken"])
    assert Counter(map(key, rows)) == Counter(map(key, out.collect()))
    assert Counter(str(r["text"]) for r in out.collect()) == Counter(str(r["text"]) for r in docs.collect())


def test_repeats_beyond_one_array(spark, monkeypatch):
    monkeypatch.setattr(M, "REPEATS", 7)
    docs = frame(spark, [(5, "same words here", None, "hot", 0)] * 50 + [(6, "w " * 40, None, "cold", 0)])
    check(M.op10(docs).collect(), docs.collect())
