"""PII: information-theoretic sanitisation in native expressions.

Identifiers (email, ip, card, phone) are found by fixed patterns. They are the protected entities, each as a kind and as
a value. Around every identifier the words within WINDOW characters are its context. A term's disclosure of an entity is
its pointwise mutual information with the entity as a share of the entity's information content, PMI(term; entity) /
IC(entity), with probabilities from document frequencies over the whole corpus; it is 1 when the term never appears away
from the entity. A kind supports a term that stands in the contexts of at least MIN_VALUES different identifiers, a value
one that stands in at least MIN_CONTEXTS of its contexts with different terms. A supported term whose disclosure reaches
GENERALISE is generalised, from REMOVE on removed, wherever it stands. A word between blanks stands for two terms, its
letters without what is around them (zone7 for zone) and the whole word without marks around it (ACC-7, O'Neil).

Copies of a document share their identifiers and contexts, and so support a term once; near copies do so too where the
words around the identifier are the same. What a row reveals depends on nothing but its text: rows without an id and
rows that share one are served like any other. Null texts count as empty and stay null.
Repeated rows each keep their row. Of a word's two terms the stronger action holds; a span that meets an identifier gives
way to it. Texts of any length are read whole. An empty table gives an empty result. sanitize() carries the other columns
of the input in a struct, so their names cannot clash with those used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans as S
from tidemark.llm.shared import WS, join_small, let, store

# Kinds in the order in which ties are listed, and their patterns. A possessive quantifier or a
# look-behind matches what the plain pattern does and keeps long runs linear and free of recursion.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

WINDOW = 64
MIN_VALUES, MIN_CONTEXTS = 5, 5
GENERALISE, REMOVE = 0.85, 0.95
BROADCAST_ROWS, BROADCAST_TERMS, IN_ROW = 1_000_000, 200_000, 2000
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def _ip_ok(v: Column) -> Column:
    def part_ok(p: Column) -> Column:
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(v, r"\."), part_ok)


def _luhn_ok(v: Column) -> Column:
    def checked(digits: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, -i, 1).cast("int")
            twice = d * 2
            return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

        return F.when(F.length(digits).between(12, 19), F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(False)

    return let(F.translate(v, " -", ""), checked)


def _phone_ok(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> Column:
    """Identifiers of a text that is not null, by start, then kind."""
    digit = text.rlike("[0-9]")
    return S.ordered(
        S.find(text, EMAIL, 0, "email", None, F.contains(text, F.lit("@"))),
        S.find(text, IP, 1, "ip", _ip_ok, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        S.find(text, CARD, 2, "card", _luhn_ok, digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        S.find(text, PHONE, 3, "phone", _phone_ok, text.rlike(r"\+[0-9]")),
    )


def _forms(low: Column) -> Column:
    """The terms of a lower-cased word: its letters, where it has three or more and nothing else between them, and the word
    without marks around it, where it has a letter, three characters (two, if not ASCII) and is no address. Empty where
    there is none, or the second is the first; most words are nothing but letters and need one look."""
    letters = F.regexp_replace(low, r"^[^\p{L}]++|[^\p{L}]++$", "")
    whole = F.regexp_replace(low, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", "")
    fits = whole.rlike(r"\p{L}") & ~F.contains(whole, F.lit("@")) & ((F.length(whole) >= 3) | whole.rlike(r"^[^\x00-\x7F]{2}$"))
    both = F.array(F.when(letters.rlike(r"^\p{L}{3,}$"), letters).otherwise(""), F.when(fits, whole).otherwise(""))
    return F.when(low.rlike(r"^\p{L}{3,}$"), F.array(low, F.lit(""))).otherwise(both)


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.split(F.lower(text), WS, -1)), _forms))), "")


def _key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _contexts(docs: DataFrame) -> DataFrame:
    """(_doc, kind, value, context) of every identifier; a word cut by the window's edge is left out. Texts are cut once
    for a block of identifiers, and do not travel with each of them."""

    def beside(block: Column) -> Column:
        low = F.greatest(F.get(block, F.lit(0))["start"] - WINDOW, F.lit(0))

        def sides(raw: Column) -> Column:
            def context(s: Column) -> Column:
                start, end = s["start"], s["end"]
                left = F.substring(raw, F.greatest(start - WINDOW, F.lit(0)) - low + 1, F.least(start, F.lit(WINDOW)))
                right = F.substring(raw, end - low + 1, F.lit(WINDOW))
                left = F.when(start > WINDOW, F.regexp_replace(left, r"^[^\x20\x09-\x0D]*+", "")).otherwise(left)
                right = F.when(F.length(right) == WINDOW, F.regexp_replace(right, r"[^\x20\x09-\x0D]*$", "")).otherwise(right)
                return F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), F.concat_ws(" ", left, right).alias("context"))

            return F.transform(block, context)

        return let(F.substring(F.col("_text"), low + 1, F.array_max(F.transform(block, lambda s: s["end"])) + WINDOW - low), sides)

    hits = docs.withColumn("_s", base_spans(F.col("_text"))).where(F.size("_s") > 0)
    return hits.select("_doc", F.explode(F.flatten(F.transform(S.blocks(F.col("_s")), beside))).alias("_c")).select("_doc", "_c.*")


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(terms, hits): terms with entity, support, near, df, disclosure and action; hits, the terms of each text, by _key.

    The corpus is read for the contexts of identifiers and, if any term is supported, for the document frequencies of
    those that are. Only these are shuffled; while they are few, texts are searched for them row by row."""
    docs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    contexts = store(_contexts(docs.withColumn("_doc", F.monotonically_increasing_id())), "pii-contexts")  # numbers of rows, fixed by being stored
    found_by = contexts.withColumn("_terms", F.array_sort(_terms(F.col("context"))))
    kind = F.struct(F.col("kind").alias("entity"), F.col("value").alias("by"), F.lit(MIN_VALUES).alias("least"))
    value = F.struct(F.concat_ws(":", "kind", "value").alias("entity"), F.xxhash64("_terms").cast("string").alias("by"), F.lit(MIN_CONTEXTS).alias("least"))
    entities = found_by.select("_doc", "_terms", F.explode(F.array(kind, value)).alias("_e")).select("_doc", "_terms", "_e.*")
    near = entities.select("_doc", "entity", "by", "least", F.explode("_terms").alias("term"))
    # distinct values or contexts, then distinct documents, each pre-aggregated by its own key: no group is gathered
    support = near.select("entity", "least", "term", "by").distinct().groupBy("entity", "least", "term").agg(F.count("*").alias("support")).where(F.col("support") >= F.col("least")).drop("least")
    n_near = near.select("entity", "term", "_doc").distinct().groupBy("entity", "term").agg(F.count("*").alias("near"))
    candidates = store(support.join(n_near, ["entity", "term"]), "pii-candidates")
    holders = entities.select("entity", "_doc").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    with_entity = store(join_small(holders, candidates.select("entity").distinct(), "entity", "left_semi", BROADCAST_ROWS), "pii-entities")

    wanted = candidates.select("term").distinct().limit(IN_ROW + 1).collect()
    terms_of, docs = _terms(F.col("_text")), docs.withColumn("_doc", _key(F.col("_text")))
    if len(wanted) <= IN_ROW:  # few: each text keeps those it has
        known = [r["term"] for r in wanted]
        found = docs.select("_doc", F.explode(F.filter(terms_of, lambda t: t.isin(known))).alias("term")) if known else docs.select("_doc", F.lit("").alias("term")).limit(0)
    else:
        found = join_small(docs.select("_doc", F.explode(terms_of).alias("term")), candidates.select("term").distinct(), "term", "left_semi", BROADCAST_ROWS)
    found = store(found, "pii-found")
    total = docs.count() if wanted else 0
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    ic = -F.log2(F.col("with_entity") / F.lit(float(max(total, 1))))
    pmi = F.log2(F.col("near") * F.lit(float(max(total, 1))) / (F.col("df") * F.col("with_entity")))
    scored = join_small(candidates.join(df, "term"), with_entity, "entity", "inner", BROADCAST_ROWS).withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)))
    action = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    terms = store(scored.where(F.col("disclosure") >= GENERALISE).withColumn("action", action), "pii-terms")
    strongest = terms.groupBy("term").agg(F.max("action").alias("action"))
    hits = join_small(found, strongest, "term", "inner", BROADCAST_ROWS).groupBy("_doc").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("_terms"))
    return terms, store(hits, "pii-hits")


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of the disclosing terms of a text that do not meet an identifier."""
    of = lambda w: F.greatest(*[F.try_element_at(terms, F.get(_forms(F.lower(w)), F.lit(i))) for i in (0, 1)])
    known = S.find(text, r"[^\x20\x09-\x0D]++", 4, "term", lambda w: of(w).isNotNull())
    named = F.transform(known, lambda s: S.span(s["start"], 4, s["end"], "term", of(s["value"])))
    return S.apart(base, named, lambda p: p["rank"] < 4)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per input row: _row (all its columns), _text, _base (spans of identifiers) and _spans (those and the
    disclosing terms')."""
    _, hits = disclosing_terms(docs, text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    weight = hits.agg(F.coalesce(F.sum(1 + F.size("_terms")), F.lit(0))).first()[0]
    if not weight:
        return rows.select("_row", "_text", "_base", F.col("_base").alias("_spans"))
    rows = rows.withColumn("_doc", _key(F.col("_text"))).join(F.broadcast(hits) if weight <= BROADCAST_TERMS else hits, "_doc", "left")
    extra = F.when(F.col("_terms").isNotNull(), _term_spans(F.col("_text"), F.col("_terms"), F.col("_base"))).otherwise(S.empty())
    return rows.select("_row", "_text", "_base", S.ordered(F.col("_base"), extra).alias("_spans"))


def sanitize(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the same columns: identifiers masked, disclosing terms generalised to <TERM> or removed. A null text
    stays null."""

    def mask(s: Column) -> Column:
        out = F.when((s["kind"] == "term") & (s["value"] == "remove"), "")
        for kind, by in MASKS.items():
            out = out.when(s["kind"] == kind, by)
        return out.otherwise("<TERM>")

    text = F.col("_row").getField(text_col)
    clean = F.when(text.isNull() | (F.size("_spans") == 0), text).otherwise(S.replace(F.col("_text"), F.col("_spans"), mask))
    return with_spans(docs, text_col).select(*[clean.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest of with_spans()."""
    found = with_spans(docs.select("doc_id", "text"))
    doc_id = F.col("_row.doc_id").alias("doc_id")
    base, spans = F.col("_base"), F.col("_spans")
    counts = [S.count(base, k).alias(f"n_{k}") for k in KINDS]
    return found.select(doc_id, *counts, S.digest(base).alias("base_sha256"), S.as_text(spans).alias("spans"), S.count(spans, "term").alias("n_term"))
