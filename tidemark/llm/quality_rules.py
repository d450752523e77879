"""Quality rules: hashed n-gram importance by log-likelihood ratio, in native expressions.

Words and word pairs of every document are hashed into BUCKETS. Two multinomials over the buckets are estimated with
add-SMOOTH: one from the trusted target (documents with label quality = 1 and not toxic), one from the raw corpus (all
documents). A document's score is the mean over its n-grams of log p_target - log p_raw, and it is kept when the score
reaches THRESHOLD, a fixed number, so that every document is decided alike in every run. The base rules count symbols,
repeated lines and repeated word windows and reject documents before the score is asked.

A null text has no words and fails the base rules. Texts of any length are counted whole. A score at THRESHOLD is kept.
Repeated rows and rows without an id are counted and decided row by row; ids that are null match no label. Without a
trusted document there is nothing to compare with: all ratios are 0 and the base rules alone decide. An empty table gives
an empty result. Only the id and text columns are read, so others cannot clash. Repeated windows are told by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WS, join_small, let, words

BUCKETS = 10_000
SMOOTH = 1.0
THRESHOLD = -0.06
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Labels are 8 bytes each; so many, about 50 MB as a hash table, may be broadcast.
BROADCAST_ROWS = 1_000_000


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that the text has twice or more. Windows are compared by a 64-bit hash: sorted alone
    first, as few texts repeat any; then with their places, where neighbours in sorted order tell the repeats."""

    def windows(w: Column) -> Column:
        last = F.size(w) - 2
        return F.when(last < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(places: Column) -> Column:
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("n"), (p + 3).alias("end"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("end")), step, lambda acc: acc["n"])

    def placed(h: Column) -> Column:
        def repeats(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeats)

    return let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(placed(h))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _words and the base counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_words", words(F.col(text_col)))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": repeated_lines(text),
        "n_repeat_words": repeated_words(F.col("_words")),
    })
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def buckets(w: Column, n: int = BUCKETS) -> Column:
    """Bucket numbers of the words and of the pairs of neighbours."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int"))
    two = F.transform(w, lambda x, i: F.pmod(F.xxhash64(x, F.get(w, i + 1)), F.lit(n)).cast("int"))
    return F.concat(one, F.slice(two, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = BUCKETS) -> list[float]:
    """log p_target - log p_raw of each bucket. trusted has the ids of the target's documents in id_col. The counts cover
    all documents; one row a bucket comes to the driver, n in all. Nothing is returned without a trusted n-gram."""
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    trusted = trusted.select(F.col(id_col).alias("_id"), F.lit(1).alias("_t")).where(F.col("_id").isNotNull()).distinct()
    flagged = join_small(flagged, trusted, "_id", "left", BROADCAST_ROWS)
    grams = flagged.select("_t", let(words(F.col("_text")), lambda w: buckets(w, n)).alias("_g")).select("_t", F.explode("_g").alias("_b"))
    counts = grams.groupBy("_b").agg(F.count("*").alias("raw"), F.count("_t").alias("target")).collect()
    raw, target = [SMOOTH] * n, [SMOOTH] * n
    for r in counts:
        raw[r["_b"]] += r["raw"]
        target[r["_b"]] += r["target"]
    if sum(target) == SMOOTH * n:
        return []
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def llr(w: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the n-grams of the words; 0 without any. The table is one foldable literal of
    len(ratios) numbers."""
    if not ratios:
        return F.lit(0.0)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return let(buckets(w, len(ratios)), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total(g) / F.size(g)))


def trusted_target(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base counts, base_failed, llr and kept of every document."""
    docs = docs.select("doc_id", "text")
    ratios = log_ratios(docs, trusted_target(labels))
    out = base_rules(docs).withColumn("llr", llr(F.col("_words"), ratios))
    return out.withColumn("kept", ~F.col("base_failed") & ((F.col("llr") >= THRESHOLD) | F.lit(not ratios))).drop("_words", "text")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
