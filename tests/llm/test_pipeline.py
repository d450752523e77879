import corpus_pipeline
from tests.llm.fixtures import AWKWARD, frame
from tests.llm.test_decontamination import D
from tests.llm.test_jaccard_join import brute as near_copies
from tests.llm.test_mixing import brute_targets
from tests.llm.test_pii import brute as personal


def test_every_stage(spark, tmp_path):
    """Each stage against the brute-force version of what it decides."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf)
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(spark.read.parquet(f"{tmp_path}/{len(kept)}"))
    rows = [{r["doc_id"]: r.asDict() for r in k.collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]}
    assert len(clean & rows[1].keys()) >= 0.95 * len(clean) and len(rows[1]) < len(rows[0])
    before = list(rows[1].values())
    assert set(rows[2]) == {c for _, _, c in near_copies(before)}
    items = [D.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, d in rows[2].items() if any(x in D.normal(d["text"]) for x in items)}
    assert leaked and set(rows[3]) == set(rows[2]) - leaked
    assert set(rows[4]) == set(rows[3]) and any(personal(d["text"]) for d in rows[3].values())
    for i, d in rows[4].items():
        assert not personal(d["text"]) and d["n_chars"] == len(d["text"])
        assert d["text"] == rows[3][i]["text"] or personal(rows[3][i]["text"])
    sizes = {}
    for r in rows[5].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target = brute_targets(sizes)
    assert set(rows[5]) == set(rows[4])
    for s in sizes:
        taken = sum(r["taken"] for r in rows[5].values() if r["source"] == s)
        assert abs(taken - target[s]) <= 20
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_clashing_columns(spark):
    """Columns with the names that stages use inside pass through all of them, and the end has the texts."""
    names = ["_id", "_bad", "_row", "_text", "_base", "_spans", "_doc", "_kept", "_size", "_src", "id", "rows", "class", "item_id", "row", "h", "_key"]
    docs = frame(spark, [f"text number {i} about the sea and the tide that comes in" for i in range(6)] + AWKWARD)
    docs = docs.selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert all(r[n] == n for r in out.collect() for n in names), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in docs.collect())


def test_awkward(spark):
    docs = frame(spark, AWKWARD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()
