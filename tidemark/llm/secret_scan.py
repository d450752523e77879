"""Secret scans: multipart credential linking in native expressions.

Strong secrets (assign, access, hex) are found by fixed patterns and always reported. Weak candidates are identifiers
(an upper-case key id, or a value assigned to a user, client or account name), secrets (a mixed run as long as a key,
or a value assigned to a weaker word such as pwd) and endpoints (a URL, or a host assigned to a name). Within a
document the parts' intervals, widened by SCOPE code points, are joined with each other as a sweep along the sorted
starts, forwards and backwards, which carries the nearest part of every role: a weak identifier is reported when a
secret, strong or weak, lies within its scope, a weak secret when an identifier or an endpoint does. Endpoints only
link. The join is inside the row, so a document's parts never meet another's and nothing is shuffled.

Null texts count as empty, repeated rows and rows without an id keep their rows, an empty table gives an empty result, and
only the id and text columns are read, so others cannot clash. Parts with one start are swept by rank, then end; a part at
exactly SCOPE counts. Texts of any length are read whole, in time about linear in their parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans as S
from tidemark.llm.shared import let

# Kinds in the order in which ties are listed, and their patterns. Runs that are too short are dropped by
# the pattern where that cannot move other matches.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)$"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KEY_ID = r"[A-Za-z0-9]{16,}+"
NAMED_ID = r"""(?i:user(?:name)?|login|account|client|tenant|access_key)(?i:[_-]?id)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
RUN = r"[A-Za-z0-9+/_-]{20,}+"
NAMED_SECRET = r"""(?i:pwd|passphrase|pass|auth|credential|private_key|signature)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"',;]{4,}+"""
URL = r"""(?i:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{3,}+"""
NAMED_HOST = r"""(?i:host(?:name)?|endpoint|server|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}+"""
#: (rank, kind, pattern, patterns that a match must have)
WEAK = (
    (3, "weak_id", KEY_ID, ("^[A-Z][A-Z0-9]+$", "[0-9]")), (3, "weak_id", NAMED_ID, ()),
    (4, "weak_secret", RUN, ("[0-9]", "[A-Z]", "[a-z]")), (4, "weak_secret", NAMED_SECRET, ()),
    (5, "endpoint", URL, ()), (5, "endpoint", NAMED_HOST, ()),
)

SCOPE = 200
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


def base_spans(text: Column) -> Column:
    """Strong secrets of a text that is not null."""
    long_value = lambda v: F.length(F.regexp_extract(v, VALUE, 1)) >= 8
    return S.ordered(
        S.find(text, ASSIGN, 0, "assign", long_value, text.rlike(r"(?i:password|passwd|secret|token|api_?key)")),
        S.find(text, ACCESS, 1, "access", None, F.contains(text, F.lit("AKIA"))),
        S.find(text, HEX, 2, "hex", None, text.rlike(HEX)),
    )


def weak_spans(text: Column) -> Column:
    def keep(tests: tuple[str, ...]):
        return (lambda v: reduce(lambda a, b: a & b, [v.rlike(t) for t in tests])) if tests else None

    return F.array_distinct(S.ordered(*[S.find(text, p, rank, kind, keep(tests), text.rlike(p)) for rank, kind, p, tests in WEAK]))


def _role(s: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, role in ROLES.items():
        out = F.when(s["kind"] == kind, role).otherwise(out)
    return out


def linked(base: Column, weak: Column, scope: int = SCOPE) -> Column:
    """The weak identifiers and secrets that have a complementary part within scope and do not meet a strong one."""
    strong = lambda p: p["kind"].isin(*KINDS)

    def sweep(parts: Column, forwards: bool) -> Column:
        """For each part, 1 if it has a partner before it, and 2 if a strong one overlaps it."""
        sees = {r: (lambda p, r=r: F.when(_role(p) == r, p["end"] if forwards else -p["start"])) for r in ("id", "secret", "endpoint")}

        def emit(acc: Column, p: Column) -> Column:
            role, begin = _role(p), p["start"] if forwards else -p["end"]
            close = lambda r: begin - acc[r] <= scope
            hit = F.when(role == "id", close("secret")).when(role == "secret", close("id") | close("endpoint")).otherwise(False)
            return hit.cast("int") + 2 * S.meets(p, acc, forwards).cast("int")

        return S.scan(parts, sees | {"edge": S.edge(strong, forwards)}, emit)

    def join(parts: Column) -> Column:
        both = F.zip_with(sweep(parts, True), F.reverse(sweep(F.reverse(parts), False)), lambda a, b: a.bitwiseOR(b))
        return let(both, lambda flags: F.filter(parts, lambda p, i: p["kind"].isin("weak_id", "weak_secret") & (F.get(flags, i) == 1)))

    return F.when(F.size(weak) == 0, S.empty()).otherwise(let(F.array_sort(F.concat(base, weak)), join))


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _base (strong secrets) and _spans (those and the linked weak ones) of every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_base", base_spans(F.col("_text"))).withColumn("_weak", weak_spans(F.col("_text")))
    return rows.select("doc_id", "_base", S.ordered(F.col("_base"), linked(F.col("_base"), F.col("_weak"))).alias("_spans"))


def op8(docs: DataFrame) -> DataFrame:
    found = with_spans(docs)
    base, spans = F.col("_base"), F.col("_spans")
    counts = [S.count(base, k).alias(f"n_{k}") for k in KINDS]
    weak = F.size(F.filter(spans, lambda s: s["kind"].startswith("weak_"))).cast("long").alias("n_linked")
    return found.select("doc_id", *counts, S.digest(base).alias("base_sha256"), S.as_text(spans).alias("spans"), weak)
