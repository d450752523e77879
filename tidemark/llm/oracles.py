"""op1 and op8 in DuckDB's SQL, with patterns and numbers of their own, so that a wrong one in an operator shows."""

from __future__ import annotations

# The patterns of the contract, in a form without groups, and those of the weak parts of credentials.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
KEY_ID = r"[A-Za-z0-9]{16,}"
NAMED_ID = r"""(?i:user(?:name)?|login|account|client|tenant|access_key)(?i:[_-]?id)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
RUN = r"[A-Za-z0-9+/_-]{20,}"
NAMED_SECRET = r"""(?i:pwd|passphrase|pass|auth|credential|private_key|signature)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"',;]{4,}"""
URL = r"""(?i:https?|ftp|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{3,}"""
NAMED_HOST = r"""(?i:host(?:name)?|endpoint|server|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}"""
WEAK = (
    (3, "weak_id", KEY_ID, ("^[A-Z][A-Z0-9]+$", "[0-9]")), (3, "weak_id", NAMED_ID, ()),
    (4, "weak_secret", RUN, ("[0-9]", "[A-Z]", "[a-z]")), (4, "weak_secret", NAMED_SECRET, ()),
    (5, "endpoint", URL, ()), (5, "endpoint", NAMED_HOST, ()),
)
WINDOW, LEAST, GENERALISE, SCOPE = 64, 5, 0.85, 200
WS = r"[\x20\x09-\x0D]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _find(name: str, regex: str, rank: int, kind: str, keep: str = "true", source: str = "docs") -> str:
    """Spans of one pattern: gaps between matches and the matches themselves add up to positions."""
    r = _quote(regex)
    return f"""
{name}_a AS (SELECT rid, string_split_regex(text, {r}) AS gaps, regexp_extract_all(text, {r}) AS hits FROM {source} WHERE regexp_matches(text, {r})),
{name}_b AS (SELECT rid, unnest(hits) AS value, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM {name}_a),
{name}_c AS (SELECT rid, value, sum(length(gap)) OVER w + sum(length(value)) OVER w - length(value) AS start FROM {name}_b WINDOW w AS (PARTITION BY rid ORDER BY i)),
{name} AS (SELECT rid, CAST(start AS BIGINT) AS start, {rank} AS rank, CAST(start + length(value) AS BIGINT) AS stop, {_quote(kind)} AS kind, value FROM {name}_c WHERE {keep})"""


_DOCS = "docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)"
_SAID = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"


def _counts(kinds: tuple[str, ...]) -> str:
    return ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)


def _result(kinds: tuple[str, ...], more: str, more_name: str) -> str:
    columns = ", ".join(f"coalesce(b.n_{k}, 0) AS n_{k}" for k in kinds)
    return f"""
b AS (SELECT rid, {_counts(kinds)}, {_SAID} AS said FROM base GROUP BY rid),
a AS (SELECT rid, {more} AS more, {_SAID} AS said FROM spans GROUP BY rid)
SELECT d.doc_id, {columns}, sha256(coalesce(b.said, '')) AS base_sha256, coalesce(a.said, '') AS spans, coalesce(a.more, 0) AS {more_name}
FROM docs d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1),
 lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) * 2
 - CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_IP_OK = """len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')) = 0"""


def _forms(word: str) -> str:
    """Both terms of a word as a list, empty texts where there is none."""
    letters = f"regexp_replace(lower({word}), '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')"
    whole = f"regexp_replace(lower({word}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
    fits = f"regexp_matches({whole}, '\\p{{L}}') AND NOT contains({whole}, '@') AND (length({whole}) >= 3 OR regexp_full_match({whole}, '[^\\x00-\\x7F]{{2}}'))"
    return f"[CASE WHEN regexp_full_match({letters}, '\\p{{L}}{{3,}}') THEN {letters} ELSE '' END, CASE WHEN {fits} THEN {whole} ELSE '' END]"


def _terms(column: str, keys: str, source: str) -> str:
    """Distinct terms of each row; keys name the row."""
    return f"SELECT DISTINCT {keys}, term FROM (SELECT {keys}, unnest({_forms('w')}) AS term FROM (SELECT {keys}, unnest(string_split_regex({column}, '{WS}+')) AS w FROM {source})) WHERE term <> ''"


OP1 = f"""WITH {_DOCS},
{_find("email", EMAIL, 0, "email")},
{_find("ip", IP, 1, "ip", _IP_OK)},
{_find("card", CARD, 2, "card", _LUHN)},
{_find("phone", PHONE, 3, "phone", f"length({_DIGITS}) BETWEEN 9 AND 15")},
base AS (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone),
sides AS (SELECT b.rid, b.kind, lower(b.value) AS value,
 CASE WHEN start > {WINDOW} THEN regexp_replace(substr(d.text, start - {WINDOW} + 1, {WINDOW}), '^[^\\x20\\x09-\\x0D]*', '') ELSE substr(d.text, 1, start) END AS l,
 substr(d.text, stop + 1, {WINDOW}) AS r FROM base b JOIN docs d USING (rid)),
contexts AS (SELECT row_number() OVER () AS cid, rid, kind, value, l || ' ' || CASE WHEN length(r) = {WINDOW} THEN regexp_replace(r, '[^\\x20\\x09-\\x0D]*$', '') ELSE r END AS context FROM sides),
beside AS ({_terms("context", "cid, rid, kind, value", "contexts")}),
shape AS (SELECT cid, string_agg(term, ' ' ORDER BY term) AS shape FROM beside GROUP BY cid),
near AS (SELECT rid, kind AS entity, value AS by_what, term FROM beside UNION ALL SELECT rid, kind || ':' || value, shape, term FROM beside JOIN shape USING (cid)),
candidates AS (SELECT entity, term, count(DISTINCT rid) AS near FROM near GROUP BY ALL HAVING count(DISTINCT by_what) >= {LEAST}),
holders AS (SELECT entity, count(DISTINCT rid) AS with_entity FROM (SELECT kind AS entity, rid FROM contexts UNION ALL SELECT kind || ':' || value, rid FROM contexts) GROUP BY entity),
terms_of AS ({_terms("text", "rid", "docs")}),
df AS (SELECT term, count(*) AS df FROM terms_of WHERE term IN (SELECT term FROM candidates) GROUP BY term),
scored AS (SELECT term, -log2(with_entity / (SELECT count(*) FROM docs)) AS ic, log2(near * CAST((SELECT count(*) FROM docs) AS DOUBLE) / (df * with_entity)) AS pmi
 FROM candidates JOIN df USING (term) JOIN holders USING (entity)),
flagged AS (SELECT DISTINCT term FROM scored WHERE ic > 0 AND pmi / ic >= {GENERALISE}),
wanted AS (SELECT DISTINCT d.rid, d.text FROM docs d JOIN terms_of t USING (rid) JOIN flagged USING (term)),
{_find("word", r"[^\x20\x09-\x0D]+", 4, "term", source="wanted")},
extra AS (SELECT w.* FROM word w WHERE list_has_any({_forms("w.value")}, (SELECT list(term) FROM flagged)) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.start < w.stop AND w.start < b.stop)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
{_result(("email", "ip", "card", "phone"), "count(*) FILTER (WHERE kind = 'term')", "n_term")}"""

_VALUE = _quote(VALUE)
_WEAK = [
    (f"weak{i}", _find(f"weak{i}", pattern, rank, kind, " AND ".join(f"regexp_matches(value, {_quote(t)})" for t in tests) or "true"))
    for i, (rank, kind, pattern, tests) in enumerate(WEAK)
]
_ROLE = "CASE WHEN kind IN ('assign', 'hex', 'weak_secret') THEN 'secret' WHEN kind IN ('access', 'weak_id') THEN 'id' ELSE 'endpoint' END"
_ORDER = "PARTITION BY rid ORDER BY start, rank, stop, value"
_BEFORE, _AFTER = f"({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"({_ORDER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def _close(role: str) -> str:
    return f"(start - max(stop) FILTER (WHERE role = '{role}') OVER {_BEFORE} <= {SCOPE} OR min(start) FILTER (WHERE role = '{role}') OVER {_AFTER} - stop <= {SCOPE})"


OP8 = f"""WITH {_DOCS},
{_find("assign", ASSIGN, 0, "assign", f"length(regexp_extract(value, {_VALUE}, 1)) >= 8")},
{_find("access", r"AKIA[A-Z0-9]+", 1, "access", "length(value) >= 16")},
{_find("hex", "[0-9a-f]+", 2, "hex", "length(value) >= 32")},
{",".join(cte for _, cte in _WEAK)},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
weak AS ({" UNION ".join(f"SELECT * FROM {n}" for n, _ in _WEAK)}),
parts AS (SELECT *, {_ROLE} AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
near AS (SELECT *, {_close("id")} AS by_id, {_close("secret")} AS by_secret, {_close("endpoint")} AS by_endpoint FROM parts),
extra AS (SELECT rid, start, rank, stop, kind, value FROM near n WHERE (kind = 'weak_id' AND by_secret OR kind = 'weak_secret' AND (coalesce(by_id, false) OR coalesce(by_endpoint, false)))
 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = n.rid AND b.start < n.stop AND n.start < b.stop)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
{_result(("assign", "access", "hex"), "count(*) FILTER (WHERE starts_with(kind, 'weak_'))", "n_linked")}"""
