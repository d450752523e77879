"""Positions of regular-expression matches, in native expressions only.

Spark has no function for the positions of matches. As matches do not overlap, the texts between them (split)
and the matches themselves (regexp_extract_all) have them: a running sum of lengths over both gives start and
end in code points.

Arrays are walked in blocks of BLOCK elements: a walk that appends to its result copies it with every step, so walks of
whole arrays would cost the square of their length. Blocks are short, and what they need to know of those before is
carried from block to block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.shared import let

BLOCK, FAR = 256, -(10**9)
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
NONE = f"array<{SPAN}>"


def span(start: Column, rank: int | Column, end: Column, kind: str | Column, value: Column) -> Column:
    as_column = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(start.cast("int").alias("start"), as_column(rank, "int").alias("rank"), end.cast("int").alias("end"), as_column(kind, "string").alias("kind"), value.alias("value")).cast(SPAN)


def empty() -> Column:
    return F.array().cast(NONE)


def blocks(items: Column) -> Column:
    """The array cut into arrays of BLOCK elements; none if it is empty."""
    n = F.ceil(F.size(items) / F.lit(BLOCK)).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda b: F.slice(items, (b - 1) * BLOCK + 1, BLOCK))
    return F.when(n > 0, cut).otherwise(F.transform(F.array().cast("array<int>"), lambda b: F.slice(items, 1, 0)))


def find(text: Column, regex: str, rank: int, kind: str, keep: Callable[[Column], Column] | None = None, only_if: Column | None = None) -> Column:
    """All leftmost non-overlapping matches whose text satisfies keep, as an array of spans. only_if is a cheap
    necessary condition on the text; text must not be null."""
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"))
    begin = F.struct(F.lit(0).alias("pos"), empty().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"])
        return F.struct(end.alias("pos"), F.when(good, F.concat(acc["out"], F.array(span(start, rank, end, kind, x["hit"])))).otherwise(acc["out"]).alias("out"))

    def long(pairs: Column) -> Column:
        def joined(parts: Column) -> Column:
            zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
            starts = F.aggregate(parts, zero, lambda acc, x: F.struct((acc["pos"] + x["pos"]).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])
            moved = lambda x, by: F.transform(x["out"], lambda s: span(s["start"] + by, s["rank"], s["end"] + by, s["kind"], s["value"]))
            return F.flatten(F.zip_with(parts, starts, moved))

        return let(F.transform(blocks(pairs), lambda b: F.aggregate(b, begin, step)), joined)

    found = let(pairs, lambda p: F.when(F.size(p) <= BLOCK, F.aggregate(p, begin, step, lambda acc: acc["out"])).otherwise(long(p)))
    return F.when(only_if, found).otherwise(empty()) if only_if is not None else found


def scan(parts: Column, sees: dict[str, Callable[[Column], Column]], emit: Callable[[Column, Column], Column]) -> Column:
    """emit(state, part), an int, for each part in order; the state has under each name the largest of sees[name](part) over
    the parts before, FAR if there are none."""
    far = F.lit(FAR)
    grown = lambda acc, p: [F.greatest(acc[n], F.coalesce(see(p), far)).cast("int").alias(n) for n, see in sees.items()]
    start = F.struct(*[far.alias(n) for n in sees])

    def one(part: Column, state: Column) -> Column:
        begin = F.struct(*[state[n].alias(n) for n in sees], F.array().cast("array<int>").alias("out"))
        step = lambda acc, p: F.struct(*grown(acc, p), F.concat(acc["out"], F.array(emit(acc, p).cast("int"))).alias("out"))
        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    def many(part: Column) -> Column:
        tops = F.transform(part, lambda b: F.aggregate(b, start, lambda acc, p: F.struct(*grown(acc, p))))
        begin = F.struct(*[far.alias(n) for n in sees], F.slice(F.array(start), 1, 0).alias("out"))
        before = lambda acc: F.struct(*[acc[n].alias(n) for n in sees])
        step = lambda acc, t: F.struct(*[F.greatest(acc[n], t[n]).alias(n) for n in sees], F.concat(acc["out"], F.array(before(acc))).alias("out"))
        return F.flatten(F.zip_with(part, F.aggregate(tops, begin, step, lambda acc: acc["out"]), one))

    return F.when(F.size(parts) <= BLOCK, one(parts, start)).otherwise(let(blocks(parts), many))


def meets(p: Column, acc: Column, forwards: bool) -> Column:
    """Whether a base span before p, of which the state has the furthest edge as `edge`, overlaps it."""
    return (acc["edge"] > p["start"]) if forwards else (-acc["edge"] < p["end"])


def edge(is_base: Callable[[Column], Column], forwards: bool) -> Callable[[Column], Column]:
    return lambda p: F.when(is_base(p), p["end"] if forwards else -p["start"])


def apart(base: Column, others: Column, is_base: Callable[[Column], Column]) -> Column:
    """The others that overlap no base span."""

    def chosen(parts: Column) -> Column:
        sweep = lambda x, forwards: scan(x, {"edge": edge(is_base, forwards)}, lambda acc, p: meets(p, acc, forwards))
        both = F.zip_with(sweep(parts, True), F.reverse(sweep(F.reverse(parts), False)), lambda a, b: a + b)
        kept = lambda flags: F.filter(parts, lambda p, i: ~is_base(p) & (F.get(flags, i) == 0))
        return let(both, kept)

    return F.when(F.size(others) == 0, empty()).otherwise(let(ordered(base, others), chosen))


def ordered(*spans: Column) -> Column:
    """All spans by start, then by the rank of their kind, then by end."""
    return F.array_sort(F.concat(*spans))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(as_text(spans), 256)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replace(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with every span replaced by mask(span); spans that overlap an earlier one lengthen it. spans are in order."""

    def piece(part: Column, at: Column) -> Column:
        """The text from at to the furthest end of the part's spans or at."""

        def local(raw: Column) -> Column:
            begin = F.struct(at.alias("pos"), F.lit("").alias("out"))

            def step(acc: Column, s: Column) -> Column:
                fresh = s["start"] >= acc["pos"]
                more = F.concat(acc["out"], F.substring(raw, acc["pos"] - at + 1, s["start"] - acc["pos"]), mask(s))
                return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

            return F.aggregate(part, begin, step, lambda acc: acc["out"])

        return let(F.substring(text, at + 1, F.array_max(F.transform(part, lambda s: s["end"])) - at), local)

    def joined(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
        far = lambda acc, b: F.greatest(acc["pos"], F.array_max(F.transform(b, lambda s: s["end"])))
        ends = F.aggregate(part, zero, lambda acc, b: F.struct(far(acc, b).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")))
        return let(ends, lambda e: F.concat(F.array_join(F.zip_with(part, e["out"], piece), ""), F.substring(text, e["pos"] + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(blocks(spans), joined))
