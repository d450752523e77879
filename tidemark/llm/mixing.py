"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its weight's share of all words, at most CAP times its own words; what that cuts off is shared
again by weight among the others, round by round, until none is above its cap. The mix is made of blocks of BLOCK words.
Sainte-Lague gives sources integer numbers of blocks by highest quotients target/(2s+1), and again each source's blocks to
its shards, whose size is bounded. In a shard the documents stand in seeded order on a line of words; whole rounds of the
line are taken first, then the run of blocks that starts at a seeded block, around the end of the line if need be. A
document's share of the run is what it adds.

Sums are aggregates, and orders over all sources, or over the quotients that are still in question, are made by ranges
with the number of rows before each, so no window spans a source or the table; windows are within shards.

Null texts have no words and no words are taken from them; a null source is a source of its own, the last; repeated
rows are laid side by side and each keeps its row, as do rows without an id. Equal quotients go to the source (shard) that
comes first. Texts of any length count whole; one that is longer than a shard makes its shard longer. An empty table gives
an empty result. Only doc_id, source and text are read; mixed() carries the other columns, in place of which its own
come if they have the same name. All hashes are seeded by values, so reruns agree however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WS, join_small, store

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 8
SHARD_WORDS = 500_000
SEED = 20_240_229
BROADCAST_ROWS, REPEATS = 100_000, 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, _src (a key without nulls) and size; the text is read here."""
    return docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_src"), _words_in(F.col("text")).alias("size"))


def _words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WS.replace("[", "[^"))).cast("long")


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with _rank, the number of its row in the order, from 1. The order must tell all rows apart."""
    names = [f"_o{i}" for i in range(len(order))]
    df = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order, strict=True)})
    parts = store(df.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    upto, before = 0, []
    for r in parts.groupBy("_range").count().orderBy("_range").collect():  # a row a range
        before.append((r["_range"], upto))
        upto += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*names)) + F.col("_before")
    return parts.join(F.broadcast(starts), "_range").withColumn("_rank", place).drop("_range", "_before", *names)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """_src, source_size and target of each source, stored. The level to which the sources that are not capped rise is
    found by rounds, of one aggregate each."""
    per = ranked(sized.groupBy("_src").agg(F.sum("size").alias("source_size")), F.col("_src") == "", "_src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    per = store(per.select("_src", "source_size", weight.alias("_w"), (F.col("source_size") * float(cap)).alias("_cap")), "mix-sources")
    level, new = -1.0, 0.0
    while new > level:
        level = new
        above = F.col("_cap") < level * F.col("_w")
        total, cut, left = per.agg(F.sum("source_size"), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_w")))).first()
        new = (total - (cut or 0.0)) / left if left else level
    return store(per.select("_src", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target")), "mix-targets")


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """parties with _seats: per group, `seats` seats by the highest quotients votes/(2s+1), ties by key.

    Rounding votes * seats / total gives all quotients above a common bound. What that lacks, or has too much, is settled
    by ranking the next quotients beyond or before it; a party needs at most its share of them and two more, so the
    ranked rows are as many as the parties, not the seats."""
    of = lambda df, how: df.groupBy(*group).agg(*how)
    with_ = lambda df, more: join_small(df, more, group, "inner", BROADCAST_ROWS)
    v = F.col(votes).cast("double")
    p = with_(parties, of(parties, [F.sum(v).alias("_total"), F.count("*").alias("_n")]))
    p = p.withColumn("_base", F.when(F.col("_total") > 0, F.floor(v * F.col(seats) / F.col("_total") + 0.5)).otherwise(0).cast("long"))
    p = with_(p, of(p, [F.sum("_base").alias("_given")]))
    p = store(p.withColumn("_lack", F.when(F.col("_total") > 0, F.col(seats) - F.col("_given")).otherwise(0)), "mix-parties")
    reach = F.when(F.col("_lack") == 0, 0).otherwise(F.ceil(v / F.col("_total") * (F.abs("_lack") + F.col("_n"))) + 2)
    reach = F.when(F.col("_lack") < 0, F.least(reach, F.col("_base"))).otherwise(reach).cast("int")
    steps = p.where(F.col("_lack") != 0).withColumn("_k", F.explode(F.when(reach > 0, F.sequence(F.lit(1), reach))))
    seat = F.when(F.col("_lack") > 0, F.col("_base") + F.col("_k") - 1).otherwise(F.col("_base") - F.col("_k"))
    quotient = v / (2 * seat + 1)
    keys = list(dict.fromkeys(group + key))
    steps = steps.select(*keys, "_lack", "_k", F.when(F.col("_lack") > 0, -quotient).otherwise(quotient).alias("_first"))
    rows = store(ranked(steps, *group, "_first", *key, "_k"), "mix-steps")
    rows = with_(rows, of(rows, [F.min("_rank").alias("_start")])).where(F.col("_rank") - F.col("_start") < F.abs("_lack"))
    moves = rows.groupBy(*keys).agg(F.sum(F.signum("_lack")).cast("long").alias("_move"))
    out = join_small(p, moves, keys, "left", BROADCAST_ROWS)
    return out.withColumn("_seats", F.col("_base") + F.coalesce("_move", F.lit(0))).drop("_total", "_n", "_base", "_given", "_lack", "_move")


def seeded(seed: int, *values: Column) -> Column:
    """Sixty bits of the md5 of the values, which any SQL engine can make."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _placed(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int, shard_words: int, seed: int) -> DataFrame:
    """A row for each different (doc_id, source, size): how often it is there (_m), where its first copy stands on its
    shard's line (_at), and what the shard takes of the line."""
    sized = store(sizes(docs), "mix-sizes")
    aims = targets(sized, weights, cap)
    total = aims.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    blocks = F.floor(F.lit(total) / F.lit(float(block)) + 0.5).cast("long")  # targets add up to all words
    all_of = aims.withColumn("_all", F.lit(1)).withColumn("_blocks", blocks)
    quotas = sainte_lague(all_of, ["_all"], ["_src"], "target", "_blocks").select("_src", "source_size", "target", F.col("_seats").alias("_quota"))

    # equal rows form one unit, so that a document repeated ever so often is one row of its shard
    units = sized.groupBy("doc_id", "source", "_src", "size").agg(F.count("*").alias("_m"))
    units = join_small(units, quotas, "_src", "inner", BROADCAST_ROWS)
    luck = seeded(seed, F.col("doc_id"), F.col("size"))
    n_shards = F.ceil((F.col("source_size") + 1) / F.lit(float(shard_words)))
    units = store(units.withColumn("_luck", luck).withColumn("_shard", seeded(seed + 1, F.col("doc_id"), F.col("size")) % n_shards), "mix-units")

    shards = units.groupBy("_src", "_shard", "_quota").agg(F.sum(F.col("size") * F.col("_m")).alias("_line"))
    shards = sainte_lague(shards, ["_src"], ["_shard"], "_line", "_quota")
    words = F.least(F.col("_seats") * block, F.col("_line") * cap)
    n_blocks = F.ceil((F.col("_line") + 1) / F.lit(float(block)))
    start = seeded(seed + 2, F.col("_src"), F.col("_shard")) % n_blocks * block
    some = F.col("_line") > 0
    shards = shards.select("_src", "_shard", "_line",
        F.when(some, F.floor(words / F.col("_line"))).otherwise(0).cast("long").alias("_rounds"),
        F.when(some, words % F.col("_line")).otherwise(0).cast("long").alias("_rest"),
        F.when(some, start % F.col("_line")).otherwise(0).cast("long").alias("_start"),
    )

    line = Window.partitionBy("_src", "_shard").orderBy("_luck", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("_at", F.coalesce(F.sum(F.col("size") * F.col("_m")).over(line), F.lit(0)))
    return join_small(placed, shards, ["_src", "_shard"], "inner", BROADCAST_ROWS)


def _taken(copy: Column) -> Column:
    """The words that the mix takes of the given copy of a unit, counted from 0."""
    at = F.col("_at") + copy * F.col("size")

    def meets(shift: Column | int) -> Column:
        """Words of the row inside the run of blocks, moved by shift."""
        a, b = F.col("_start") + shift, F.col("_start") + F.col("_rest") + shift
        return F.greatest(F.lit(0), F.least(at + F.col("size"), b) - F.greatest(at, a))

    return (F.col("_rounds") * F.col("size") + meets(0) + meets(-F.col("_line"))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row."""
    placed = _placed(docs, weights, cap, block, shard_words, seed)
    # copies are counted off in two steps, so that no array grows with them
    many = placed.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / REPEATS))))
    rows = many.withColumn("_i", F.explode(F.sequence(F.col("_c") * REPEATS, F.least((F.col("_c") + 1) * REPEATS, F.col("_m")) - 1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("_i")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The rows with all their columns, and after them size, source_size, target and taken. Rows with one doc_id, source and
    size are numbered by their texts, others have no need of it. Texts are shuffled once, by these three."""
    placed = _placed(docs, weights, cap, block, shard_words, seed).drop("_src", "_shard", "_quota", "_luck")
    placed = store(placed.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), *[c for c in placed.columns if c not in ("doc_id", "source")]), "mix-placed")
    rows = docs.select(F.struct("*").alias("_row"), _words_in(F.col("text")).alias("_size"))
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]

    def of(units: DataFrame, copy: Column) -> DataFrame:
        same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("size"))
        joined = rows.join(units, same).withColumn("_copy", copy)
        return joined.select(*[F.col("_row").getField(c).alias(c) for c in own], "size", "source_size", "target", _taken(F.col("_copy")).alias("taken"))

    once, again = placed.where("_m = 1"), placed.where("_m > 1")
    out = of(once, F.lit(0))
    if again.isEmpty():
        return out
    return out.unionByName(of(again, F.row_number().over(Window.partitionBy("_id", "_source", "size").orderBy(F.xxhash64("_row.text"))) - 1))


def op10(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _lague(name: str, source: str, group: str, votes: str, seats: str, key: str, more: str) -> str:
    """sainte_lague() as common table expressions that end in one of the given name."""
    over = f"OVER ({'PARTITION BY ' + group if group else ''})"
    by = ", ".join(filter(None, [group, key]))
    return f"""
{name}_a AS (SELECT *, CAST({votes} AS DOUBLE) AS v, CAST(sum({votes}) {over} AS DOUBLE) AS tot, count(*) {over} AS n FROM {source}),
{name}_b AS (SELECT *, CAST(CASE WHEN tot > 0 THEN floor(v * {seats} / tot + 0.5) ELSE 0 END AS BIGINT) AS base FROM {name}_a),
{name}_c AS (SELECT *, CAST(CASE WHEN tot > 0 THEN {seats} - sum(base) {over} ELSE 0 END AS BIGINT) AS lack FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN lack = 0 THEN 0 WHEN lack > 0 THEN CAST(ceil(v / tot * (abs(lack) + n)) AS BIGINT) + 2 ELSE least(CAST(ceil(v / tot * (abs(lack) + n)) AS BIGINT) + 2, base) END AS reach FROM {name}_c),
{name}_e AS (SELECT {by}, v, base, lack, unnest(range(1, reach + 1)) AS k FROM {name}_d WHERE reach > 0),
{name}_f AS (SELECT *, row_number() OVER ({'PARTITION BY ' + group if group else ''} ORDER BY CASE WHEN lack > 0 THEN -(v / (2 * (base + k - 1) + 1)) ELSE v / (2 * (base - k) + 1) END, {key}, k) AS rk FROM {name}_e),
{name}_g AS (SELECT {by}, CAST(sum(sign(lack)) AS BIGINT) AS move FROM {name}_f WHERE rk <= abs(lack) GROUP BY {by}),
{name} AS (SELECT {more}, base + coalesce(move, 0) AS got FROM {name}_d LEFT JOIN {name}_g USING ({by}))"""


def _seeded_sql(seed: int, *values: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', " + ", ".join(f"coalesce(CAST({v} AS VARCHAR), '')" for v in values) + ")), 1, 15) AS BIGINT)"


#: op10() over documents in DuckDB's SQL.
ORACLE = f"""
WITH sized AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
weighed AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY src = '', src) - 1) % {len(WEIGHTS)} AS DOUBLE) AS w, CAST(source_size * {CAP} AS DOUBLE) AS cap FROM per),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
chosen AS (SELECT level FROM levels WHERE cap >= level * w ORDER BY cap / w, src LIMIT 1),
targets AS (SELECT src, source_size, least(cap, coalesce((SELECT level FROM chosen) * w, 0)) AS target,
 CAST(floor(CAST(sum(source_size) OVER () AS DOUBLE) / {BLOCK} + 0.5) AS BIGINT) AS blocks FROM levels),
{_lague("quotas", "targets", "", "target", "blocks", "src", "src, source_size, target")},
units AS (SELECT doc_id, source, src, size, count(*) AS m FROM sized GROUP BY ALL),
dealt AS (SELECT u.*, q.source_size, q.target, q.got AS quota, {_seeded_sql(SEED, "doc_id", "size")} AS luck,
 {_seeded_sql(SEED + 1, "doc_id", "size")} % CAST(ceil((q.source_size + 1) / {SHARD_WORDS}.0) AS BIGINT) AS shard FROM units u JOIN quotas q USING (src)),
lines AS (SELECT src, shard, quota, CAST(sum(size * m) AS BIGINT) AS line FROM dealt GROUP BY ALL),
{_lague("seats", "lines", "src", "line", "quota", "shard", "src, shard, line")},
runs AS (SELECT *, least(got * {BLOCK}, line * {CAP}) AS words, {_seeded_sql(SEED + 2, "src", "shard")} % CAST(ceil((line + 1) / {BLOCK}.0) AS BIGINT) * {BLOCK} AS begin FROM seats),
parts AS (SELECT src, shard, line, CASE WHEN line > 0 THEN words // line ELSE 0 END AS rounds, CASE WHEN line > 0 THEN words % line ELSE 0 END AS rest, CASE WHEN line > 0 THEN begin % line ELSE 0 END AS start FROM runs),
placed AS (SELECT *, coalesce(sum(size * m) OVER (PARTITION BY src, shard ORDER BY luck, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM dealt),
spread AS (SELECT *, unnest(range(0, m)) AS i FROM placed),
laid AS (SELECT s.doc_id, s.size, s.source_size, s.target, s.pos + s.i * s.size AS pos, p.* EXCLUDE (src, shard) FROM spread s JOIN parts p USING (src, shard))
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(pos + size, start + rest) - greatest(pos, start))
 + greatest(0, least(pos + size, start + rest - line) - greatest(pos, start - line)) AS BIGINT) AS taken FROM laid"""
