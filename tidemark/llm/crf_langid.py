"""Language ID: a linear-chain conditional random field over the words of a text.

A word's emission scores come from hashed character n-grams of one to four bytes of the word between boundary marks
(those at a mark are its affixes) and from a lexicon, the words that training documents of a language have most
often. Transitions between the languages of neighbouring words are learned with them, by the gradient of the
conditional likelihood from forward-backward, on chains of which half are cut together from documents of several
languages, as code-switched text is. A text is one chain, whatever its length: it is cut into pieces of CHAIN words, of
each of which the product of its transition and emission matrices is taken; messages run over these from piece to piece,
and then within all pieces at once, which gives every word's exact distribution over languages. A text's language is the
one with the largest sum over the words that have a letter, its score the share of that sum.

The model is fitted on a bounded sample: of the LANGUAGES languages with the most training documents, PER_LANGUAGE
documents each (those with the lowest hash of id, then of text, among documents with a text and a language outside fold
0), and of a longer one WORDS words in pieces of CHAIN that are spread evenly over it. Rows that are equal count once in
the sample, so a repeated id brings no more rows to the driver. Every document is labelled. Prediction reads the text
alone. A null text or one without a letter is `und` with score 0, as is everything when no training documents exist. Ties
go to the first language by code point. Repeated rows and rows without an id are labelled one by one; an empty table
gives an empty result. Only doc_id, text and lang are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fold, let, words
from tidemark.llm.tokens import mixed, release, words_of

FOLDS = 5
PER_LANGUAGE, LANGUAGES, WORDS = 120, 256, 6400
CHAIN = 64
BITS = 15
GRAMS = 4
LEXICON = 2000
EPOCHS, RATE, RIDGE = 25, 0.05, 1e-4
CACHE = 300_000
SEED = 5


def gram_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed n-gram) of all n-grams of the words between boundary marks."""
    parts = [b"\x02" + w + b"\x03" for w in words]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    code = np.zeros(len(raw), np.uint64)
    owners, hashes = [], []
    for n in range(1, GRAMS + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(257) + raw[n - 1 :]
        inside = owner[:m] == owner[n - 1 :]
        owners.append(owner[:m][inside])
        hashes.append((mixed(code[inside] * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(hashes)


def forward_backward(emit: np.ndarray, move: np.ndarray, entry: np.ndarray, mask: np.ndarray, leave: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, steps, languages) and, with count, expected transition counts of chains. emit holds log scores;
    entry has the weights before the first word, leave what lies behind the last one, for all chains or for each. Masked
    steps lie at the end of their chain."""
    n, steps, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    t = np.exp(move)
    alpha = np.empty_like(e)
    a = entry * e[:, 0]
    for i in range(steps):
        if i:
            a = np.where(mask[:, i, None], (alpha[:, i - 1] @ t) * e[:, i], alpha[:, i - 1])
        alpha[:, i] = a / a.sum(1, keepdims=True)
    beta = np.ones((n, k)) if leave is None else leave
    post = np.empty_like(e)
    pairs = np.zeros((k, k))
    for i in range(steps - 1, -1, -1):
        g = alpha[:, i] * beta
        post[:, i] = g / g.sum(1, keepdims=True)
        if i:
            m = mask[:, i]
            below = e[:, i] * beta
            if count:
                q = alpha[:, i - 1][m][:, :, None] * t[None] * below[m][:, None, :]
                pairs += (q / q.sum((1, 2), keepdims=True)).sum(0)
            back = below @ t.T
            beta = np.where(m[:, None], back / np.maximum(1e-300, back.sum(1, keepdims=True)) * k, beta)
    return post, pairs


def long_chains(emit: np.ndarray, move: np.ndarray, start: np.ndarray, mask: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Marginals of chains that are cut into pieces, pieces[i] of them in a row for the i-th chain."""
    n, steps, k = emit.shape
    last = np.cumsum(pieces)
    first = last - pieces
    opens = np.zeros(n, bool)
    opens[first[pieces > 0]] = True
    t, begin = np.exp(move), np.exp(start - start.max())
    entry, leave, passed = np.tile(begin, (n, 1)), np.ones((n, k)), np.zeros((len(pieces), k))
    if pieces.max(initial=0) > 1:
        e = np.exp(emit - emit.max(2, keepdims=True))
        whole = np.where(opens[:, None, None], np.eye(k), t) * e[:, 0][:, None, :]  # of all words of a piece
        for i in range(1, steps):
            m = mask[:, i, None, None]
            whole = np.where(m, (whole @ t) * e[:, i][:, None, :], whole)
            whole /= whole.max((1, 2), keepdims=True)
        for j in range(int(pieces.max()) - 1):  # from piece to piece, of all chains at once
            longer = pieces > j + 1
            at = first[longer] + j
            out = (entry[at][:, None, :] @ whole[at])[:, 0] if j == 0 else (passed[longer][:, None, :] @ whole[at])[:, 0]
            passed = np.zeros((len(pieces), k))
            passed[longer] = out / out.sum(1, keepdims=True)
            entry[at + 1] = passed[longer] @ t
            at = last[longer] - 1 - j
            back = (whole[at] @ leave[at][:, :, None])[:, :, 0]
            leave[at - 1] = back / back.sum(1, keepdims=True)
    return forward_backward(emit, move, entry, mask, leave, False)[0]


class Model:
    """Weights of the hashed n-grams, of the lexicon's words, and of transitions."""

    def __init__(self, languages: list[str], lexicon: dict[bytes, int]):
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.grams = np.zeros((1 << BITS, k), np.float32)
        self.entries = np.zeros((len(lexicon) + 1, k), np.float32)
        self.move, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        owner, gram = gram_features(words)
        n = len(words)
        size = np.sqrt(np.bincount(owner, minlength=n))
        out = np.stack([np.bincount(owner, self.grams[gram, j], minlength=n) for j in range(len(self.languages))], 1) / size[:, None]
        return out + self.entries[[self.lexicon.get(w, 0) for w in words]]


def _chains(texts: list[list[bytes]], labels: list[int], rng: np.random.Generator) -> list[tuple[list[bytes], np.ndarray]]:
    """Chains with a language for each word: every document cut into chains, and as many chains cut together."""
    out = []
    for words, y in zip(texts, labels, strict=True):
        out += [(words[a : a + CHAIN], np.full(len(words[a : a + CHAIN]), y)) for a in range(0, len(words), CHAIN)]
    plain = len(out)
    for _ in range(plain):
        words, marks = [], []
        while len(words) < CHAIN:
            source, y = out[int(rng.integers(plain))]
            n = int(rng.integers(4, 25))
            a = int(rng.integers(max(1, len(source) - n + 1)))
            words += source[a : a + n]
            marks += [int(y[0])] * len(source[a : a + n])
        out.append((words[:CHAIN], np.array(marks[:CHAIN])))
    return out


def train(texts: list[str], langs: list[str]) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    tokens = [words_of(t) for t in texts]
    labels = [languages.index(x) for x in langs]
    tops: set[bytes] = set()
    for j in range(len(languages)):
        seen = Counter(w for t, y in zip(tokens, labels, strict=True) if y == j for w in t)
        tops.update(w for w, c in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if c > 1)
    model = Model(languages, {w: i + 1 for i, w in enumerate(sorted(tops))})
    if len(languages) == 1:
        return model
    chains = _chains(tokens, labels, np.random.default_rng(SEED))
    vocabulary = sorted({w for words, _ in chains for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    n, k = len(chains), len(languages)
    ids, gold, mask = np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), bool)
    for i, (words, marks) in enumerate(chains):
        ids[i, : len(words)] = [number[w] for w in words]
        gold[i, : len(words)] = marks
        mask[i, : len(words)] = True
    owner, gram = gram_features(vocabulary)
    size = np.sqrt(np.bincount(owner, minlength=len(vocabulary)))
    entry = np.array([model.lexicon.get(w, 0) for w in vocabulary])
    onehot = np.eye(k)
    wanted_moves = np.zeros((k, k))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(wanted_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    params = {"grams": model.grams, "entries": model.entries, "move": model.move, "start": model.start}
    first, second = ({p: np.zeros(v.shape) for p, v in params.items()} for _ in (0, 1))
    total = mask.sum()
    for epoch in range(1, EPOCHS + 1):
        scores = np.stack([np.bincount(owner, model.grams[gram, j], minlength=len(vocabulary)) for j in range(k)], 1) / size[:, None] + model.entries[entry]
        post, pairs = forward_backward(scores[ids], model.move, np.exp(model.start - model.start.max()), mask)
        error = (onehot[gold] - post) * mask[:, :, None]
        by_word = np.stack([np.bincount(ids.ravel(), error[:, :, j].ravel(), minlength=len(vocabulary)) for j in range(k)], 1)
        shared = by_word / size[:, None]
        grads = {
            "grams": np.stack([np.bincount(gram, shared[owner, j], minlength=1 << BITS) for j in range(k)], 1),
            "entries": np.stack([np.bincount(entry, by_word[:, j], minlength=len(model.entries)) for j in range(k)], 1),
            "move": wanted_moves - pairs, "start": error[:, 0].sum(0),
        }
        grads["entries"][0] = 0
        for p, v in params.items():  # Adam, upwards
            g = grads[p] / total - RIDGE * v / 100
            first[p] = 0.9 * first[p] + 0.1 * g
            second[p] = 0.99 * second[p] + 0.01 * g * g
            v += (RATE * 4 * (first[p] / (1 - 0.9**epoch)) / (np.sqrt(second[p] / (1 - 0.99**epoch)) + 1e-8)).astype(v.dtype)
    return model


class Labeller:
    """Labels texts; keeps the emissions of the words it has met, up to CACHE of them."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.voting = np.zeros(0, bool)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHE:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            at = len(self.number)
            self.number.update((w, at + i) for i, w in enumerate(new))
            self.scores = np.concatenate([self.scores, self.model.emissions(new).astype(np.float32)])
            self.voting = np.concatenate([self.voting, [any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))) for w in new]])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def marginals(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, marginals, whether it has a letter) of every word of the texts."""
        lengths = np.array([len(t) for t in texts])
        ids = self._ids([w for t in texts for w in t])
        chains = -(-lengths // CHAIN)
        first = np.cumsum(chains) - chains
        owner = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row, column = first[owner] + place // CHAIN, place % CHAIN
        k = len(self.model.languages)
        emit, mask = np.zeros((int(chains.sum()), CHAIN, k)), np.zeros((int(chains.sum()), CHAIN), bool)
        emit[row, column] = np.where(self.voting[ids, None], self.scores[ids], 0)
        mask[row, column] = True
        post = long_chains(emit, self.model.move, self.model.start, mask, chains)
        return owner, post[row, column], self.voting[ids]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [words_of(t) for t in texts]
        sums = np.zeros((len(texts), len(self.model.languages)))
        a = 0
        while a < len(texts):  # about 200,000 words at a time
            z, held = a, 0
            while z < len(texts) and (z == a or held + len(words[z]) <= 200_000):
                held += len(words[z])
                z += 1
            if held:
                owner, post, votes = self.marginals(words[a:z])
                for j in range(sums.shape[1]):
                    sums[a:z, j] = np.bincount(owner[votes], post[votes, j], minlength=z - a)
            a = z
        total = sums.sum(1)
        best = sums.argmax(1)
        score = np.where(total > 0, sums[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0)
        return [self.model.languages[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)], np.minimum(score, 1.0)


def _spread(text: Column) -> Column:
    """The text's words; of a text with more than WORDS, pieces of CHAIN words that are spread evenly over it."""

    def cut(w: Column) -> Column:
        n = WORDS // CHAIN
        piece = lambda i: F.slice(w, (1 + F.floor(i * (F.size(w) - CHAIN) / (n - 1))).cast("int"), CHAIN)
        return F.when(F.size(w) <= WORDS, w).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), piece)))

    return F.array_join(let(words(text), cut), " ")


def fit(docs: DataFrame) -> Model | None:
    """A model from a bounded sample: the limit for each language is applied in every partition before the shuffle, and to
    keys only; at most LANGUAGES * PER_LANGUAGE texts of WORDS words come to the driver."""
    known = docs.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = ["doc_id", "lang", "_hash"]
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("_hash"))
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    luck = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "_hash")
    # dense ranks: equal rows share one
    chosen = known.select(*key).withColumn("_rank", F.dense_rank().over(luck)).where(F.col("_rank") <= PER_LANGUAGE).select(*key).distinct()
    chosen = chosen.join(F.broadcast(most), "lang").select(*[F.col(c).alias("_" + c) for c in key])
    match = known["doc_id"].eqNullSafe(chosen["_doc_id"]) & (known["lang"] == chosen["_lang"]) & (known["_hash"] == chosen["__hash"])
    rows = known.join(F.broadcast(chosen), match, "left_semi").select(*key, _spread(F.col("text")).alias("text")).groupBy(*key).agg(F.min("text").alias("text")).toArrow()
    table = sorted(zip(*[rows.column(c).to_pylist() for c in ("doc_id", "lang", "text")], strict=True), key=str)
    return train([t for _, _, t in table], [x for _, x, _ in table])


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column("text").to_pylist()
                langs, score = labeller(texts) if labeller else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3(docs: DataFrame) -> DataFrame:
    out = label(docs, fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score")
