"""Quality classifier by co-training on two views of a document.

The text view sees words (naive-Bayes log odds of words that MIN_DF documents or more have, summed up as means, counts and
extremes) and plain measures of the text; the metadata view sees language, source and length. Two questions are
asked, quality and toxicity, each with a logistic model a view. Over ROUNDS rounds each view labels all unlabelled
documents; those of which it is sure (probability SURE) are pseudo-labels, and the other view trains on these too. Each
view is then calibrated on labelled documents kept aside, and a logistic model over the calibrated views gives the
probability of each answer. A document is kept when it is likelier good than not, and likelier harmless than not; both
at exactly one half count as yes.

The words' odds are counts over all labelled documents of one half, by hash of the id, kept for the LEXICON words that
tell most. The features of every unlabelled document are stored once, equal rows once, and scored in every round. The
models are fitted on bounded samples of labelled rows: at most LABELLED documents of the other half, and of each view's
pseudo-labels with each answer SHARE as many a round as there are unlabelled rows, at most TAUGHT, the surest. The labelled ones are drawn from each
pair of answers in equal numbers as far as there are, and split alike; pairs with fewer than FEW in that half take some of
the first half too, and an answer that only one document gives stands on both sides. Each is weighted by the labelled
documents it stands for, half of those with its pair, so that the pairs' shares are restored. Only where all labels of
documents have one value (or there are none), the answer is that value (or good).

Null texts count as empty, null metadata is a value of its own. Texts of any length are scored in full. Repeated rows and
rows without an id are scored one by one; of rows with one id the sample has one, the least by hash of the text and then
by its columns, so reruns agree. An empty table gives an empty result. Columns other than the five of documents are
carried by accept() and not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import join_small, store
from tidemark.llm.tokens import release

LABELLED, TAUGHT, FEW = 4000, 100, 4
ROUNDS, SHARE, SURE, BUCKETS = 3, 0.05, 0.97, 64
MIN_DF, STRONG, LEXICON = 5, 2.5, 30_000
#: Ids are 8 bytes each; so many, about 50 MB as a hash table, may be broadcast.
FLUSH_WORDS, BROADCAST_ROWS = 80_000, 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_PUNCTUATION = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def _words(raw: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return raw.lower().translate(_PUNCTUATION).split()


class Lexicon(dict):
    """Numbers of known words; all others are number 0, whose odds are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Text:
    """The text view: for each question, log odds of words' presence in documents with that answer, summed up, and plain
    measures of the text. counts has, for known words, how many documents have them and how many of those give each answer;
    totals the same for all documents."""

    def __init__(self, counts: dict[bytes, list[int]], totals: list[int]):
        known = sorted(counts)
        self.lexicon = Lexicon((w, i + 1) for i, w in enumerate(known))
        table = np.array([counts[w] for w in known], float).reshape(len(known), len(totals))
        have, total = table[:, :1], totals[0]
        yes, every = table[:, 1:], np.array(totals[1:], float)
        odds = np.log((yes + 0.5) / (every + 1)) - np.log((have - yes + 0.5) / (total - every + 1))
        self.odds = np.concatenate([np.zeros((1, len(every))), odds])

    def __call__(self, text: str | None) -> list[np.ndarray]:
        raw = _raw(text)
        words = _words(raw)
        n, size = len(words), max(1, len(raw))
        r = self.odds[np.fromiter(map(self.lexicon.__getitem__, words), np.int64, n)] if n else np.zeros((1, self.odds.shape[1]))
        letters = np.frombuffer(raw, np.uint8)
        lines = raw.split(b"\n")
        plain = [
            np.log1p(n), len(set(words)) / max(1, n), 1 - len(raw.translate(None, _SYMBOLS)) / size, ((letters >= 65) & (letters <= 90)).sum() / size,
            1 - len(set(lines)) / len(lines), n / size,
        ]
        out = []
        for k in range(r.shape[1]):
            x = r[:, k]
            up, down = x[x > STRONG], -x[x < -STRONG]
            out.append(np.array([x.mean(), *(f for y in (up, down) for f in (np.log1p(len(y)), len(y) / max(1, n), np.log1p(y.sum()), y.max(initial=0.0))), *plain]))
        return out


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a partition have each word, in all and by answer; the empty word stands for all documents."""

    def out(counts: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        table = np.array(list(counts.values()))
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *[pa.array(table[:, k]) for k in range(3)]], ["word", "n", "good", "harmless"])

    counts: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for text, *answers in zip(*[batch.column(c).to_pylist() for c in ("text", "good", "harmless")], strict=True):
            one = np.array([1, *answers], np.int64)
            for word in {*_words(_raw(text)), b""}:
                have = counts.get(word)
                counts[word] = one if have is None else have + one
            if len(counts) > FLUSH_WORDS:
                yield out(counts)
                counts = {}
    if counts:
        yield out(counts)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SYMBOLS = b"#*$%&|<>!@^~{}[]\\"


class Meta:
    """The metadata view: log odds of language and source, and the length."""

    def __init__(self, rows: pd.DataFrame, y: np.ndarray, weight: np.ndarray):
        self.tables = []
        for column in ("lang", "source"):
            values = rows[column].where(rows[column].notna(), None)
            good, bad = Counter(), Counter()
            for v, answer, w in zip(values, y, weight, strict=True):
                (good if answer == 1 else bad)[v] += w
            n, m = max(1, good.total()), max(1, bad.total())
            self.tables.append({v: float(np.log((good[v] + 2) / (n + 2)) - np.log((bad[v] + 2) / (m + 2))) for v in good.keys() | bad.keys()})

    def __call__(self, lang, source, n_chars) -> np.ndarray:
        known = n_chars is not None and n_chars == n_chars
        size = np.log1p(max(0.0, float(n_chars))) if known else 0.0
        return np.array([self.tables[0].get(lang, 0.0), self.tables[1].get(source, 0.0), size, size * size, float(not known)])


class Logistic:
    """Logistic regression on standardised features by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.ones(len(x)) if weight is None else weight
        keep = np.eye(z.shape[1]) * ridge
        keep[0, 0] = 1e-6
        self.beta = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + keep, z.T @ (w * (y - p)) - keep @ self.beta)
            self.beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        # summed row by row, so that a row's score does not depend on its batch
        return np.clip(self.beta[0] + ((x - self.mean) / self.scale * self.beta[1:]).sum(1), -30, 30)


class Question:
    """One answer from two co-trained views of labelled documents (known). What a view is taught weighs half as much as the
    known documents with that answer do on average."""

    def __init__(self, known: list[np.ndarray], y: np.ndarray, aside: np.ndarray, fit: np.ndarray | None = None, weight: np.ndarray | None = None):
        self.known, self.y, self.aside = known, y, aside
        self.fit = ~aside if fit is None else fit
        self.weight = np.ones(len(y)) if weight is None else weight
        self.taught: list[list[tuple[float, np.ndarray]]] = [[], []]
        self.train()

    def train(self) -> None:
        """Both models on what is known and taught."""
        y, weight = self.y[self.fit], self.weight[self.fit]
        half = {a: 0.5 * float(weight[y == a].mean()) for a in (0.0, 1.0)}
        self.models = []
        for known, taught in zip(self.known, self.taught, strict=True):
            more = [np.array(t) for t in zip(*taught, strict=True)] or [np.zeros(0), np.zeros((0, known.shape[1]))]
            self.models.append(Logistic(np.concatenate([known[self.fit], more[1]]), np.concatenate([y, more[0]]), np.concatenate([weight, [half[a] for a in more[0]]])))

    def sure(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Each view's probability of yes."""
        return [1 / (1 + np.exp(-m.logit(v))) for m, v in zip(self.models, views, strict=True)]

    def calibrate(self) -> None:
        """Calibration and blend of the trained views; the samples are not needed any more."""
        y, weight = self.y[self.aside], self.weight[self.aside]
        logits = [m.logit(v[self.aside]) for m, v in zip(self.models, self.known, strict=True)]
        self.calibration = [Logistic(s[:, None], y, weight) for s in logits]
        self.blend = Logistic(np.column_stack([c.logit(s[:, None]) for c, s in zip(self.calibration, logits, strict=True)]), y, weight)
        del self.known, self.y, self.aside, self.fit, self.weight, self.taught

    def __call__(self, views: list[np.ndarray]) -> np.ndarray:
        both = np.column_stack([c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.calibration, self.models, views, strict=True)])
        return 1 / (1 + np.exp(-self.blend.logit(both)))


class Classifier:
    """Both questions over shared views. cells has the pair of answers of each document of the sample, and counts how many
    documents there are with each pair."""

    def __init__(self, text: Text, sample: pd.DataFrame, cells: np.ndarray, counts: np.ndarray):
        pairs = np.array([[c // 2, c % 2] for c in range(4)], float)
        n = pairs.shape[1]
        share = [[counts[pairs[:, i] == a].sum() for a in (0, 1)] for i in range(n)]
        self.constant = [None if min(s) > 0 else float(s[1] > 0 or s[0] == 0) for s in share]
        if all(c is not None for c in self.constant):
            return
        answers, drawn = pairs[cells], np.bincount(cells, minlength=4)
        # half to fit, half aside, in turn along the pairs, neighbours of which share an answer
        aside = np.zeros(len(cells), bool)
        aside[np.argsort(np.array([0, 1, 3, 2])[cells], kind="stable")[1::2]] = True
        self.text = text
        weight = (counts / np.maximum(1, drawn))[cells] / 2
        sides = []
        for i in range(n):
            fit, kept = ~aside, aside.copy()
            for a in (0, 1):
                for side in (fit, kept):
                    if not (side & (answers[:, i] == a)).any():
                        side |= answers[:, i] == a
            sides.append((fit, kept))
        self.meta = [Meta(sample[sides[i][0]], answers[sides[i][0], i], weight[sides[i][0]]) for i in range(n)]
        known = self.views(sample)
        self.questions = [None if c is not None else Question(known[i], answers[:, i], sides[i][1], sides[i][0], weight) for i, c in enumerate(self.constant)]

    def views(self, rows: pd.DataFrame) -> list[list[np.ndarray]]:
        """For each question, the features of both views."""
        text = [self.text(t) for t in rows["text"]]
        out = []
        for i, meta in enumerate(self.meta):
            x = np.array([t[i] for t in text]).reshape(len(rows), -1 if len(rows) else 0)
            out.append([x, np.array([meta(a, b, c) for a, b, c in zip(rows["lang"], rows["source"], rows["n_chars"], strict=True)]).reshape(len(rows), -1 if len(rows) else 0)])
        return out

    def __call__(self, rows: pd.DataFrame) -> list[np.ndarray]:
        views = self.views(rows) if any(c is None for c in self.constant) else None
        return [np.full(len(rows), c) if c is not None else self.questions[i](views[i]) for i, c in enumerate(self.constant)]


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


def _odds(docs: DataFrame, marks: DataFrame) -> Text:
    """Word counts over the labelled documents of the first half; the LEXICON words that tell most come to the driver."""
    half = marks.where("_part < 2").select("doc_id", (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 0).cast("int").alias("harmless"))
    rows = join_small(docs.select("doc_id", "text"), half, "doc_id", "inner", BROADCAST_ROWS).select("text", "good", "harmless")
    counts = rows.mapInArrow(_present, "word binary, n long, good long, harmless long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "good", "harmless")])
    counts = store(counts.where((F.col("n") >= MIN_DF) | (F.length("word") == 0)), "quality-words")
    first = counts.where(F.length("word") == 0).first()
    totals = [first["n"], first["good"], first["harmless"]] if first else [0, 0, 0]
    # how far the share of an answer among a word's documents is from its share among all, in standard errors
    off = [F.abs(F.col(c) / F.col("n") - F.lit(t / max(1, totals[0]))) * F.sqrt("n") for c, t in (("good", totals[1]), ("harmless", totals[2]))]
    top = counts.where(F.length("word") > 0).orderBy(F.greatest(*off).desc(), "word").limit(LEXICON).collect()
    return Text({bytes(r["word"]): [r["n"], r["good"], r["harmless"]] for r in top}, totals)


def _quotas(have: list[int]) -> list[int]:
    """LABELLED dealt out evenly over the pairs of answers; what one cannot use goes to the others."""
    out, left = [0] * len(have), LABELLED
    for rank, i in enumerate(sorted(range(len(have)), key=lambda i: have[i])):
        out[i] = min(have[i], max(1, left // (len(have) - rank)))
        left -= out[i]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of quality and harmlessness: word counts over half of the labelled documents, models from a bounded
    sample of the other half."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    marks = marks.where(F.col("quality").isNotNull()).withColumn("_cell", (F.col("quality") == 1).cast("int") * 2 + (F.col("toxic") == 0).cast("int"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().join(marks, "doc_id", "left")
    ids = store(ids.withColumn("_part", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(4))).withColumn("_luck", F.xxhash64(F.lit(17), "doc_id")), "quality-ids")
    marks = ids.where(F.col("_cell").isNotNull())
    second = F.col("_part") >= 2
    have = {r["_cell"]: (r["n"], r["m"]) for r in marks.groupBy("_cell").agg(F.count("*").alias("n"), F.count_if(second).alias("m")).collect()}
    counts = np.array([have.get(c, (0, 0))[0] for c in range(4)], float)
    drawn = []
    for cell, quota in zip(have, _quotas([m for _, m in have.values()]), strict=True):
        for part, most in ((second, quota), (~second, FEW - have[cell][1])):
            if most > 0:
                drawn.append(marks.where((F.col("_cell") == cell) & part).orderBy("_luck", "doc_id").limit(most).select("doc_id", "_cell", "_luck"))
    if not drawn:
        return Classifier(None, pd.DataFrame(), np.zeros(0, int), counts)
    wanted = reduce(DataFrame.unionByName, drawn)
    row = F.struct(F.xxhash64("text").alias("h"), *COLUMNS[1:])
    table = docs.select("doc_id", row.alias("row")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "_cell", "_luck").agg(F.min("row").alias("row"))
    table = table.select("doc_id", "_cell", "_luck", "row.*").drop("h").toArrow()  # at most LABELLED rows and a few
    sample = _frame({c: table.column(c).to_pylist() for c in table.column_names}).sort_values(["_luck", "doc_id"], kind="stable").reset_index(drop=True)
    model = Classifier(_odds(docs, marks), sample, sample["_cell"].astype(int).to_numpy(), counts)
    del table, sample
    open_ = [q for q in getattr(model, "questions", ()) if q is not None]
    if open_:
        others = _features(join_small(docs.select(*COLUMNS), marks.select("doc_id"), "doc_id", "left_anti", BROADCAST_ROWS), model)
        taught: dict[tuple[int, int], set[int]] = {}
        for _ in range(ROUNDS):
            for i, k, answer, key, x in _confident(others, model, taught):
                model.questions[i].taught[1 - k].append((answer, x))
                taught.setdefault((i, k), set()).add(key)
            for q in open_:
                q.train()
        for q in open_:
            q.calibrate()
    release()
    return model


def _features(docs: DataFrame, model: Classifier) -> DataFrame:
    """_key and _x, the features of all questions and views one after the other, of every different row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.concatenate([v for views in shared.value.views(_frame({c: part.column(c).to_pylist() for c in COLUMNS})) for v in views], 1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array([r.tobytes() for r in x], pa.binary())], ["_key", "_x"])
            release()

    keyed = docs.withColumn("_key", F.xxhash64(F.lit(17), *COLUMNS)).mapInArrow(run, "_key long, _x binary")
    return store(keyed.groupBy("_key").agg(F.min("_x").alias("_x")), "quality-features")


def _quota(unlabelled: int) -> int:
    """How many pseudo-labels with one answer a view may give in a round."""
    return max(1, min(TAUGHT, int(SHARE * unlabelled)))


def _confident(features: DataFrame, model: Classifier, taught: dict[tuple[int, int], set[int]]) -> list[tuple[int, int, float, int, np.ndarray]]:
    """(question, view, answer, key, features for the other view) of pseudo-labels: of all documents of which the view is
    sure and that it has not taught yet, the surest, by key where equally sure. Each partition gives its own surest, of which
    buckets and then all are merged."""
    quota = _quota(features.count())
    questions = [(i, q.models) for i, q in enumerate(model.questions) if q is not None]
    cuts = np.cumsum([0, *[v.shape[1] for views in model.views(_frame({c: [None] for c in COLUMNS})) for v in views]])
    known = {slot: np.array(sorted(keys), np.int64) for slot, keys in taught.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, float], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            x = np.frombuffer(b"".join(batch.column("_x").to_pylist()), np.float32).reshape(len(keys), -1)
            for i, models in questions:
                views = [x[:, cuts[2 * i + k] : cuts[2 * i + k + 1]] for k in (0, 1)]
                for k in (0, 1):
                    p = 1 / (1 + np.exp(-models[k].logit(views[k].astype(float))))
                    new = ~np.isin(keys, known.get((i, k), ()))
                    for answer, sure in ((1.0, p), (0.0, 1 - p)):
                        at = np.flatnonzero(new & (sure >= SURE))
                        have = best.get((i, k, answer), (keys[:0], p[:0], views[1 - k][:0]))
                        have = tuple(np.concatenate([a, b]) for a, b in zip(have, (keys[at], sure[at], views[1 - k][at]), strict=True))
                        first = np.lexsort((have[0], -have[1]))[:quota]
                        best[i, k, answer] = tuple(a[first] for a in have)
        for (i, k, answer), (keys, sure, x) in best.items():
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.full(n, k)), pa.array(np.full(n, answer)), pa.array(keys), pa.array(sure), pa.array([r.tobytes() for r in x], pa.binary())], ["i", "k", "answer", "key", "sure", "x"])

    slot = ["i", "k", "answer"]
    rows = features.mapInArrow(run, "i long, k long, answer double, key long, sure double, x binary").withColumn("bucket", F.pmod("key", F.lit(BUCKETS)))
    for by in ([*slot, "bucket"], slot):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "key"))).where(F.col("rank") <= quota).drop("rank")
    found = rows.select(*slot, "key", "x").collect()  # at most the quota a slot, of which there are eight
    return [(r["i"], r["k"], r["answer"], r["key"], np.frombuffer(bytes(r["x"]), np.float32).astype(float)) for r in sorted(found, key=lambda r: tuple(r)[:4])]


def score(docs: DataFrame, model: Classifier, carry: bool = False) -> DataFrame:
    """p_quality, p_harmless, score (the lesser) and kept for every document; with carry, after its own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                p, q = shared.value(_frame({c: part.column(c).to_pylist() for c in COLUMNS}))
                s = np.minimum(p, q)
                own = part.columns if carry else [part.column("doc_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array(q), pa.array(s), pa.array(s >= 0.5)], [*(part.schema.names if carry else ["doc_id"]), *ADDED])
            release()

    added = [T.StructField(k, T.BooleanType() if k == ADDED[-1] else T.DoubleType()) for k in ADDED]
    own = list(docs.schema.fields) if carry else [docs.schema["doc_id"]]
    source = docs if carry else docs.select(*COLUMNS)
    return source.mapInArrow(run, T.StructType(own + added))


ADDED = ("_p_quality", "_p_harmless", "_score", "_kept")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", *[F.col(c).alias(c[1:]) for c in ADDED])


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    packed = docs.select(*COLUMNS, F.struct(*[F.col(c) for c in docs.columns if c not in COLUMNS]).alias("_more")) if set(docs.columns) - set(COLUMNS) else docs.select(*COLUMNS)
    out = score(packed, fit(docs, labels), carry=True).where("_kept")
    return out.select(*[F.col(c) if c in COLUMNS else F.col("_more").getField(c).alias(c) for c in docs.columns])
