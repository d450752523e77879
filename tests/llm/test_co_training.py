import numpy as np

from tests.llm.fixtures import AWKWARD, frame
from tidemark.llm import co_training as C

LABELS = "doc_id long, quality int, toxic int"


def test_corpus(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = C.op9(docs, labels)
    assert rows.count() == docs.count()
    by = {(r["quality"], r["toxic"]): r["k"] for r in rows.join(labels, "doc_id").groupBy("quality", "toxic").agg({"kept": "count", "score": "avg"}).withColumnRenamed("count(kept)", "k").collect()}
    kept = {(r["quality"], r["toxic"]): r["n"] for r in rows.where("kept").join(labels, "doc_id").groupBy("quality", "toxic").count().withColumnRenamed("count", "n").collect()}
    assert kept[1, 0] >= 0.98 * by[1, 0]
    assert kept.get((0, 0), 0) <= 0.15 * by[0, 0] and kept.get((1, 1), 0) <= 0.5 * by[1, 1]
    assert all(0 <= r["score"] <= 1 for r in rows.collect())
    again = C.op9(docs.repartition(5), labels)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))


def test_logistic_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    m = C.Logistic(x, y)
    assert abs((m.beta[1:] / m.scale)[0] - 2) < 0.3 and abs((m.beta[1:] / m.scale)[1] + 1) < 0.3


def test_views_teach_each_other():
    """The view that can tell on labelled documents teaches the one that can tell on others only."""
    y = np.tile([1.0, 0.0], 50)
    aside = np.arange(100) // 2 % 2 == 1
    hidden = np.tile([1.0, 0.0], 200)

    def accuracy(seed, rounds):
        rng = np.random.default_rng(seed)
        known = [(y + rng.normal(scale=0.1, size=100))[:, None], rng.normal(size=(100, 1))]
        pool = [(hidden + rng.normal(scale=0.1, size=400))[:, None], (hidden * 2 + rng.normal(scale=0.3, size=400))[:, None]]
        q = C.Question(known, y, aside)
        for _ in range(rounds):
            for k, p in enumerate(q.sure(pool)):
                for answer, sure in ((1.0, p), (0.0, 1 - p)):
                    q.taught[1 - k] += [(answer, pool[1 - k][i]) for i in np.flatnonzero(sure >= C.SURE)[:20]]
            q.train()
        return ((q.models[1].logit(pool[1]) > 0) == (hidden == 1)).mean()

    taught, alone = ([accuracy(seed, rounds) for seed in range(8)] for rounds in (3, 0))
    assert np.mean(taught) > np.mean(alone) + 0.2 and np.mean(taught) > 0.85


def test_pseudo_labels_come_from_all_unlabelled_documents(spark, monkeypatch):
    """Those of which a view is sure, wherever they stand; the surest of them, each taught once."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = []
    real = C._confident
    monkeypatch.setattr(C, "_confident", lambda f, m, t: seen.append((f, {k: set(v) for k, v in t.items()}, [q.models for q in m.questions], real(f, m, t))) or seen[-1][-1])
    model = C.fit(docs, labels)
    assert len(seen) == C.ROUNDS
    unlabelled = docs.join(labels.select("doc_id"), "doc_id", "left_anti").select(*C.COLUMNS).distinct().count()
    cuts = np.cumsum([0, *[v.shape[1] for views in model.views(C._frame({c: [None] for c in C.COLUMNS})) for v in views]])
    for features, taught, models, found in seen:
        rows = features.collect()
        assert len(rows) == unlabelled
        keys, x = np.array([r["_key"] for r in rows]), np.array([np.frombuffer(bytes(r["_x"]), np.float32) for r in rows], float)
        for i in (0, 1):
            for k in (0, 1):
                p = 1 / (1 + np.exp(-models[i][k].logit(x[:, cuts[2 * i + k] : cuts[2 * i + k + 1]])))
                for answer, sure in ((1.0, p), (0.0, 1 - p)):
                    want = [(-s, int(key)) for s, key in zip(sure, keys, strict=True) if s >= C.SURE and key not in taught.get((i, k), ())]
                    want = {key for _, key in sorted(want)[: C._quota(len(rows))]}
                    assert {key for a, b, c, key, _ in found if (a, b, c) == (i, k, answer)} == want


def test_repeated_ids(spark):
    """One id with many rows of two texts: the same model in every order, few rows at the driver."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'good' if i % 2 else 'bad'}{x}" for x in rng.integers(0, 30, 12)) for i in range(200)]
    rows = frame(spark, texts + [(5, "first of two texts", "en", "a", 1), (5, "second of two texts", "en", "b", 2)] * 2000)
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(150)], LABELS)
    one, two = ({(r["doc_id"], r["score"]) for r in C.op9(d, labels).collect()} for d in (rows, rows.repartition(7, "text")))
    assert one == two


def test_rare_answer_is_learned(spark, monkeypatch):
    """Few toxic documents, of which a small sample by hash would hold none, or too few for both of its halves."""
    monkeypatch.setattr(C, "LABELLED", 40)
    rng = np.random.default_rng(3)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 200, k))
    docs = frame(spark, [f"{word(20)} vile scum filth {word(3)}" if i % 50 == 0 else word(26) for i in range(1100)])
    labels = spark.createDataFrame([(i, 1, int(i % 50 == 0)) for i in range(1000)], LABELS)
    rows = {r["doc_id"]: r for r in C.op9(docs, labels).collect()}
    assert sum(not rows[i]["kept"] for i in range(0, 1000, 50)) >= 18
    assert sum(r["kept"] for i, r in rows.items() if i < 1000 and i % 50) >= 970 and all(r["p_quality"] == 1 for r in rows.values())


def test_constant_only_where_labels_have_one_value(spark):
    docs = frame(spark, [f"word{i % 7} text number {i}" for i in range(60)])
    for toxic in (3, 4):
        labels = spark.createDataFrame([(i, 1, int(i == toxic)) for i in range(50 if toxic == 3 else 60)], LABELS)
        assert C.fit(docs, labels).constant == [1.0, None]
        assert all(0 <= r["score"] <= 1 for r in C.op9(docs, labels).collect())
    assert C.fit(docs, labels.where("toxic = 0")).constant == [1.0, 1.0]


def test_sample_restores_shares():
    assert sum(C._quotas([9000, 10, 2000, 5000])) == C.LABELLED and C._quotas([3, 7]) == [3, 7]


def test_awkward(spark):
    docs = frame(spark, AWKWARD)
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (3, None, 0), (99, 1, 0)], LABELS)
    for labels in (none, one):
        rows = C.op9(docs, labels).collect()
        assert len(rows) == len(AWKWARD)
    assert all(r["kept"] for r in C.op9(docs, none).collect())
    assert C.op9(frame(spark, []), none).count() == 0
    clash = docs.selectExpr("*", "1 AS _kept", "2 AS quality", "'x' AS _luck")
    kept = C.accept(clash, none)
    assert kept.columns == clash.columns and kept.count() == len(AWKWARD)


def plain_scores(model, d):
    """p_quality and p_harmless of one document, one number at a time."""
    import math

    raw = (d["text"] or "").encode()
    words = "".join(" " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in raw.decode("latin-1")).encode("latin-1").lower().split()
    n, size, lines = len(words), max(1, len(raw)), raw.split(b"\n")
    plain = [math.log1p(n), len(set(words)) / max(1, n), sum(b in b"#*$%&|<>!@^~{}[]\\" for b in raw) / size, sum(65 <= b <= 90 for b in raw) / size, 1 - len(set(lines)) / len(lines), n / size]
    answers = []
    for i, q in enumerate(model.questions):
        if q is None:
            answers.append(model.constant[i])
            continue
        odds = [float(model.text.odds[model.text.lexicon.get(w, 0), i]) for w in words] or [0.0]
        text = [sum(odds) / len(odds)]
        for side in ([x for x in odds if x > C.STRONG], [-x for x in odds if x < -C.STRONG]):
            text += [math.log1p(len(side)), len(side) / max(1, n), math.log1p(sum(side)), max(side, default=0.0)]
        lang, source = model.meta[i].tables
        length = math.log1p(max(0, d["n_chars"])) if d["n_chars"] is not None else 0.0
        meta = [lang.get(d["lang"], 0.0), source.get(d["source"], 0.0), length, length * length, float(d["n_chars"] is None)]
        line = lambda m, x: max(-30, min(30, m.beta[0] + sum(b * (v - mean) / s for b, v, mean, s in zip(m.beta[1:], x, m.mean, m.scale))))
        both = [line(c, [line(m, x)]) for c, m, x in zip(q.calibration, q.models, (text + plain, meta))]
        answers.append(1 / (1 + math.exp(-line(q.blend, both))))
    return answers


def test_whole_table_against_a_plain_version(spark, sf):
    import pyarrow.parquet as pq

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = C.fit(docs, labels)
    got = {r["doc_id"]: r for r in C.op9(docs, labels).collect()}
    table = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(got) == len(table)
    for d in table:
        p, q = plain_scores(model, d)
        r = got[d["doc_id"]]
        assert abs(r["p_quality"] - p) < 1e-9 and abs(r["p_harmless"] - q) < 1e-9 and r["score"] == min(r["p_quality"], r["p_harmless"])
        assert r["kept"] == (min(p, q) >= 0.5) or abs(min(p, q) - 0.5) < 1e-9
