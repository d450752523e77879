import hashlib
import re

from pyspark.sql import functions as F

from tests.llm.fixtures import AWKWARD, corpus, frame
from tidemark.llm import pii

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
TRICKY = [
    "a@b.c_d@e.f x@y.z.w, q@@r.s a@b..c 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111  1111 1111 1111 41111111111111111111 +1 (234) 555-0000 +1.(2",
    "5500005555555559 +49 30 1234567 x+1(23)4567890- 12 3 4 5 6 7 8 9 0 1 2 3 4 5 \U0001f600 z@q.com 10.0.0.1",
    "1-2-3-4-5-6-7-8-9-0-1-2 +123456789012345678 a.b+c%d@e-f.gh.i- _@x.y 0000000000000000",
    "@".join("abc") * 200 + " " + "9" * 3000 + " " + "1.1.1.1." * 500,
]


def luhn(v):
    total = 0
    for i, d in enumerate(reversed(v)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, v):
    digits = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return sorted(found)


def check(rows, texts):
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts:
        spans = brute(text)
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        for r in by_id[doc_id]:
            assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (doc_id, text[:100])
            assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(s[3] == k for s in spans) for k, _ in PATTERNS]
            assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_base_spans(spark):
    docs = frame(spark, TRICKY + AWKWARD)
    rows = pii.op1(docs).collect()
    assert len(rows) == len(TRICKY + AWKWARD)
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_corpus(spark, sf):
    rows = pii.op1(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    docs = corpus(sf)
    assert len(rows) == len(docs)
    check(rows, [(d["doc_id"], d["text"]) for d in docs])


def test_disclosing_terms(spark):
    names = ["plain", "quiet", "other", "common", "simple", "round"]
    texts = [f"{names[i % 6]} {names[i // 6 % 6]} hotline zone{i} +1 (234) 555-{1000 + i} {names[i // 2 % 6]}" for i in range(12)]
    texts += [f"{names[i % 6]} {names[(i + 1) % 6]} nothing private" for i in range(40)]
    docs = frame(spark, texts + ["call the hotline now"])
    terms, _ = pii.disclosing_terms(docs)
    assert {r["term"] for r in terms.collect()} == {"hotline", "zone"}
    out = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert "hotline" not in out[0] and "<PHONE>" in out[0] and "hotline" not in out[52]
    assert out[20] == texts[20] and out[52].startswith("call the ")


def test_copies_support_once(spark):
    docs = frame(spark, ["hotline +1 (234) 555-1000 only here"] * 30 + ["clean text"] * 30)
    assert pii.disclosing_terms(docs)[0].count() == 0


def test_one_person_one_address(spark):
    names = ["plain", "quiet", "other", "common", "simple", "round", "early"]
    around = lambda i: f"{names[i % 7]} {names[i // 7 % 7]}"
    texts = [f"{around(i)} Quimby quimby@corp.example {around(i + 3)}" for i in range(40)]
    texts += [f"{around(i)} copied once@corp.example" for i in [2] * 30] + [f"{around(i)} nothing private" for i in range(80)]
    docs = frame(spark, [*texts, "ask Quimby about it"])
    terms, _ = pii.disclosing_terms(docs)
    assert {(r["entity"], r["term"]) for r in terms.collect()} == {("email:quimby@corp.example", "quimby")}
    out = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert not any("Quimby" in t for t in out.values()) and out[150] == "ask  about it" and out[80] == texts[80]
    assert {r["doc_id"]: r["n_term"] for r in pii.op1(docs).collect()}[3] == 1


def test_rows_without_an_id(spark):
    """What a row reveals depends on its text alone, whatever its id."""
    names = ["plain", "quiet", "other", "common", "simple", "round"]
    texts = [f"{names[i % 6]} {names[i // 6 % 6]} hotline zone{i} +1 (234) 555-{1000 + i} {names[i // 2 % 6]}" for i in range(12)]
    texts += [f"{names[i % 6]} {names[(i + 1) % 6]} nothing private" for i in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "call the hotline now", None, None, None), (3, "one more hotline", None, None, None), (3, "plain text", None, None, None)]
    got = pii.op1(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["n_term"] for r in got if r["doc_id"] is None} == {None: 1}
    assert sorted(r["n_term"] for r in got if r["doc_id"] == 3) == [0, 1, 2]
    texts = [r["text"] for r in pii.sanitize(frame(spark, rows)).collect()]
    assert not any("hotline" in t for t in texts) and "plain text" in texts


def test_words_with_marks_and_digits(spark):
    names = ["plain", "quiet", "other", "common", "simple", "round", "early"]
    around = lambda i: f"{names[i % 7]} {names[i // 7 % 7]}"
    texts = [f"{around(i)} O'Quimby-Hale (ACC-10442) \u5f20\u4f1f quimby@corp.example {around(i + 3)}" for i in range(40)] + [f"{around(i)} ACC-10443 nothing private" for i in range(80)]
    terms, _ = pii.disclosing_terms(frame(spark, texts))
    assert {r["term"] for r in terms.collect() if ":" in r["entity"]} == {"o'quimby-hale", "acc-10442", "\u5f20\u4f1f"}


def test_planted_terms_at_table_size(spark):
    """A name planted beside one address in many documents of a whole table is found there, and nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = docs.withColumn("text", F.when(F.col("doc_id") % 25 == 3, F.concat("text", *[F.concat(F.lit(" x"), F.substring(F.md5(F.concat("text", F.lit(k))), 1, 6)) for k in "abcdefgh"], F.lit(" Zebulonia zeb@corp.example"))).otherwise(F.col("text")))
    planted = planted.withColumn("text", F.when(F.col("doc_id") % 250 == 4, F.concat("text", F.lit(" ask Zebulonia."))).otherwise(F.col("text")))
    before = {r["doc_id"]: r["n_term"] for r in pii.op1(docs).collect()}
    after = {r["doc_id"]: r["n_term"] for r in pii.op1(planted.where("text IS NOT NULL")).collect()}
    assert all(after[i] == before[i] + (i % 25 == 3 or i % 250 == 4) for i in after)


def test_many_identifiers_in_one_text(spark):
    """Long texts take time in proportion."""
    import time

    one = "write to someone@corp.example or 10.0.0.1 now "
    took = []
    for n in (300, 3_000, 30_000):
        began = time.time()
        (row,) = pii.op1(frame(spark, [one * n])).collect()
        took.append(time.time() - began)
        assert row["n_email"] == row["n_ip"] == n
    assert took[2] < 60


def test_sanitize_keeps_columns_and_nulls(spark):
    docs = frame(spark, AWKWARD).withColumn("_base", F.lit("clash")).withColumn("_doc", F.lit(1)).withColumn("term", F.lit(2))
    out = pii.sanitize(docs)
    assert out.columns == docs.columns and out.count() == len(AWKWARD)
    assert sum(r["text"] is None for r in out.collect()) == 1
    assert pii.op1(frame(spark, [])).count() == 0

