"""Functions whose name or result in the Hive dialect differs from Spark's, as rewrites of their calls.

Each entry takes the arguments (lists of nodes) and gives the nodes of the replacement, or None to leave the call as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from tidemark.plans.sqltree import DialectError, Leaf, Node, literal, sql, value_of

Arguments = list[list[Node]]
Build = Callable[[Arguments], list[Node] | None]


def _list(arguments: Arguments) -> list[Node]:
    out: list[Node] = []
    for i, a in enumerate(arguments):
        out += [Leaf("symbol", ","), *a] if i else a
    return out


def _renamed(name: str) -> Build:
    return lambda a: sql(f"{name}(?)", _list(a))


def _as_string(name: str) -> Build:
    """Date functions that give a string."""
    return lambda a: sql(f"CAST({name}(?) AS STRING)", _list(a))


def _constant(form: str) -> Build:
    return lambda a: sql(form)


def _one(form: str) -> Build:
    """A form in which every ? is the only argument."""

    def build(a: Arguments) -> list[Node]:
        if len(a) != 1:
            raise DialectError("one argument is expected")
        return sql(form, *[a[0]] * form.count("?"))

    return build


def _trunc(a: Arguments) -> list[Node] | None:
    return sql("CAST(trunc(?) AS STRING)", _list(a)) if len(a) == 2 else None


def _pad(name: str) -> Build:
    """An empty pad gives null."""
    return lambda a: sql(f"{name}(?, ?, nullif(?, ''))", *a) if len(a) == 3 else None


#: The bins of a histogram: each value with its count while there are no more values than bins. Spark's histogram_numeric, taken
#: for more values, keeps a bin of a value for each part of the table and moves values by roundings where it joins them. The
#: sketch's counts are exact if it took nothing off them (its offset, bytes 25 to 32, is zero) and they make the histogram's
#: total, as a part that lost all its counts leaves no offset.
_BINS = """element_at(transform(array(struct(histogram_numeric(CAST(? AS DOUBLE) + 0D, ?) ? AS h,
  approx_top_k_accumulate(CAST(? AS DOUBLE) + 0D, CAST(least(?, 999999) + 1 AS INT)) ? AS s)), _g -> element_at(transform(array(
  sort_array(transform(filter(approx_top_k_estimate(_g.s, CAST(least(?, 999999) + 1 AS INT)), _t -> _t.item IS NOT NULL), _t -> struct(_t.item AS x, CAST(_t.count AS DOUBLE) AS y)))), _e -> CASE
 WHEN size(_e) <= ? AND hex(substring(_g.s.sketch, 25, 8)) = repeat('0', 16)
  AND aggregate(_e, CAST(0 AS DOUBLE), (_t, _b) -> _t + _b.y) = aggregate(_g.h, CAST(0 AS DOUBLE), (_t, _b) -> _t + _b.y) THEN _e
 ELSE _g.h END), 1)), 1)"""


def _bins(value: list[Node], bins: list[Node], over: list[Node]) -> list[Node]:
    return sql(_BINS, value, bins, over, value, bins, over, bins, bins)


#: Linear interpolation over the bins of a histogram h at share q of the total, as Hive's approximate percentile has it.
_QUANTILE = """aggregate(sequence(1, size(_h)), struct(CAST(0 AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS v), (_a, _i) -> CASE
 WHEN _a.v IS NOT NULL THEN _a
 WHEN _a.c + element_at(_h, _i).y >= ? * aggregate(_h, CAST(0 AS DOUBLE), (_t, _b) -> _t + _b.y) THEN struct(_a.c AS c,
  CASE WHEN _i = 1 THEN element_at(_h, 1).x ELSE element_at(_h, _i - 1).x + (? * aggregate(_h, CAST(0 AS DOUBLE), (_t, _b) -> _t + _b.y) - _a.c)
   * (element_at(_h, _i).x - element_at(_h, _i - 1).x) / element_at(_h, _i).y END AS v)
 ELSE struct(_a.c + element_at(_h, _i).y AS c, _a.v AS v) END, _a -> _a.v)"""


def _percentile_approx(a: Arguments, over: list[Node]) -> list[Node]:
    if len(a) not in (2, 3):
        raise DialectError("percentile_approx takes two or three arguments")
    bins = a[2] if len(a) == 3 else sql("10000")
    many = a[1] and a[1][0].up == "ARRAY"
    share = sql("_p") if many else a[1]
    quantile = sql(_QUANTILE, share, share)
    if many:
        quantile = sql("transform(?, _p -> ?)", a[1], quantile)
    return sql("element_at(transform(array(?), _h -> CASE WHEN size(_h) > 0 THEN ? END), 1)", _bins(a[0], bins, over), quantile)


def _mask(form: str) -> Build:
    """mask_first_n and its kin: the count, then the masks."""

    def build(a: Arguments) -> list[Node]:
        n = a[1] if len(a) > 1 else sql("4")
        more: list[Node] = []
        for x in a[2:5]:
            more += [Leaf("symbol", ","), *x]
        parts = {"s": a[0], "n": n, "m": more}
        return sql(form, *[parts[c] for c in _ORDER[form]])

    return build


_FIRST = "concat(mask(left(?, ?) ?), substring(?, ? + 1))"
_LAST = "concat(left(?, greatest(length(?) - ?, 0)), mask(right(?, ?) ?))"
_SHOW_FIRST = "concat(left(?, ?), mask(substring(?, ? + 1) ?))"
_SHOW_LAST = "concat(mask(left(?, greatest(length(?) - ?, 0)) ?), right(?, ?))"
_ORDER = {_FIRST: "snmsn", _LAST: "ssnsnm", _SHOW_FIRST: "snsnm", _SHOW_LAST: "ssnmsn"}


def _field(a: Arguments) -> list[Node]:
    if len(a) < 2:
        raise DialectError("field takes two arguments or more")
    return sql("coalesce(CAST(array_position(array(?), ?) AS INT), 0)", _list(a[1:]), a[0])


def _truncate(a: Arguments) -> list[Node]:
    """Digits are cut off in decimal, exactly; the type stays. Numbers beyond decimals have no digits to cut off."""
    digits = a[1] if len(a) > 1 else sql("0")
    fixed = all(isinstance(x, Leaf) and (x.kind == "number" or x.text == "-") for x in digits)
    if not fixed:
        return sql("(sign(?) * floor(abs(?) * power(10, ?)) / power(10, ?))", a[0], a[0], digits, digits)
    cut = sql("CASE WHEN ? < 0 THEN ceil(CAST(? AS DECIMAL(38, 18)), ?) ELSE floor(CAST(? AS DECIMAL(38, 18)), ?) END", a[0], a[0], digits, a[0], digits)
    return sql("(CASE WHEN false OR abs(?) >= 1e19 THEN ? ELSE ? END)", a[0], a[0], cut)


def _url_parts(a: Arguments) -> list[Node]:
    """parse_url_tuple(url, part, ...): a row with a column for each part."""
    columns: list[Node] = []
    for i, part in enumerate(a[1:]):
        columns += ([Leaf("symbol", ",")] if i else []) + (sql("parse_url(?, 'QUERY', substring(?, 7)) AS ?", a[0], part, sql(f"c{i}")) if value_of(part[0]).upper().startswith("QUERY:") else sql("parse_url(?, ?) AS ?", a[0], part, sql(f"c{i}")))
    return sql("inline(array(struct(?)))", columns)


def _replicated(a: Arguments) -> list[Node]:
    """replicate_rows(n, ...): n and the other arguments as a row, n times."""
    return sql("inline(array_repeat(struct(?), CAST(? AS INT)))", _list(a), a[0])


def _date_format(a: Arguments) -> list[Node] | None:
    """The day number of the week, which Spark's patterns lack."""
    if len(a) == 2 and len(a[1]) == 1 and isinstance(a[1][0], Leaf) and a[1][0].kind == "text" and value_of(a[1][0]) == "u":
        return sql("CAST(weekday(?) + 1 AS STRING)", a[0])
    return None


def _sort_array_by(a: Arguments) -> list[Node]:
    """sort_array_by(array of structs, 'field', ..., 'ASC' or 'DESC')."""
    names = [value_of(x[0]) for x in a[1:]]
    down = names[-1].upper() == "DESC"
    names = names[:-1] if names[-1].upper() in ("ASC", "DESC") else names
    less, more = ("1", "-1") if down else ("-1", "1")
    tests = " ".join(f"WHEN _l.`{n}` < _r.`{n}` THEN {less} WHEN _l.`{n}` > _r.`{n}` THEN {more}" for n in names)
    return sql(f"array_sort(?, (_l, _r) -> CASE {tests} ELSE 0 END)", a[0])


def _histogram(a: Arguments, over: list[Node]) -> list[Node]:
    if len(a) != 2:
        raise DialectError("histogram_numeric takes two arguments")
    return _bins(*a, over)


def _unsupported(name: str) -> Build:
    def build(a: Arguments) -> list[Node]:
        raise DialectError(f"{name} is not supported; register the Hive class to use it")

    return build


FUNCTIONS: dict[str, Build] = {
    **{n: _as_string(n) for n in ("to_date", "date_add", "date_sub", "add_months", "last_day", "next_day")},
    "trunc": _trunc,
    "date_format": _date_format,
    **{f"floor_{u}": _one(f"CAST(date_trunc('{u.upper()}', ?) AS TIMESTAMP_NTZ)") for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")},
    "yearweek": _renamed("weekofyear"),
    "interval_day_time": _one("CAST(? AS INTERVAL DAY TO SECOND)"),
    "interval_year_month": _one("CAST(? AS INTERVAL YEAR TO MONTH)"),
    "std": _renamed("stddev_pop"),
    "stddev": _renamed("stddev_pop"),
    "variance": _renamed("var_pop"),
    "covariance": _renamed("covar_pop"),
    "$sum0": _one("coalesce(sum(?), 0)"),
    "collect": _renamed("collect_list"),
    "fusion": _one("flatten(collect_list(?))"),
    "element": _one("element_at(?, 1)"),
    "sqrt": _one("nullif(sqrt(?), CAST('NaN' AS DOUBLE))"),
    "udfdegrees": _renamed("degrees"),
    "truncate": _truncate,
    "parse_url_tuple": _url_parts,
    "replicate_rows": _replicated,
    "lpad": _pad("lpad"),
    "rpad": _pad("rpad"),
    "field": _field,
    "index": lambda a: sql("(?)[?]", *a),
    "varchar": lambda a: sql("CAST(? AS STRING)", a[0]),
    "array_contains": lambda a: sql("coalesce(array_contains(?), false)", _list(a)),
    "sort_array_by": _sort_array_by,
    "mask_first_n": _mask(_FIRST),
    "mask_last_n": _mask(_LAST),
    "mask_show_first_n": _mask(_SHOW_FIRST),
    "mask_show_last_n": _mask(_SHOW_LAST),
    "mask_hash": _one("sha2(?, 256)"),
    "logged_in_user": _constant("current_user()"),
    "new": _unsupported("NEW"),
    **{n: _unsupported(n) for n in ("create_union", "extract_union", "in_file", "reflect2", "compute_stats", "ngrams", "context_ngrams", "sq_count_check", "cardinality_violation", "internal_interval", "ewah_bitmap", "ewah_bitmap_and", "ewah_bitmap_or", "ewah_bitmap_empty")},
}

#: Aggregates within other calls, which take the window that follows their call, if any, as well.
AGGREGATES: dict[str, Callable[[Arguments, list[Node]], list[Node]]] = {"histogram_numeric": _histogram, "percentile_approx": _percentile_approx}

__all__ = ["AGGREGATES", "FUNCTIONS", "literal"]
