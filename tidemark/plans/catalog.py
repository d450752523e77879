"""The registered queries of the SQL engine and their DuckDB counterparts.

Every query is a statement of the dialect, run through the table environment over whole Parquet tables. Where DuckDB takes the
same text, it is its own counterpart.
"""

from __future__ import annotations

import datetime
import sqlite3
import types
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.env import TableEnv
from tidemark.plans import statements
from tidemark.ship import ship
from tidemark.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def environment(spark: SparkSession, sf_dir: str, tables: str) -> TableEnv:
    """An environment with the named Parquet tables; schema.table registers a table in a schema."""
    env = TableEnv(spark)
    for name in tables.split():
        schema, _, table = name.rpartition(".")
        df = env.spark.read.parquet(f"{sf_dir}/{table}.parquet")
        env.register_table(schema, table, df) if schema else env.register_table(table, df)
    return env


def _statement(tables: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: environment(spark, sf_dir, tables).sql(sql)


for _name, _tables, _sql, _duck in statements.STATEMENTS:
    QUERIES[_name] = _statement(_tables, _sql)
    if _duck is not None:
        ORACLES[_name] = _duck or _sql


class _Words:
    def eval(self, text: str):
        for word in (text or "").split(" "):
            yield (word,)


class _Product:
    """The product of 1 + x / 10, which no order of the rows changes but for rounding."""

    def init(self) -> float:
        return 1.0

    def add(self, state: float, value: float) -> float:
        return state * (1 + value / 10)


def _with_functions(tables: str, sql: str, *functions: tuple) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        env = environment(spark, sf_dir, tables)
        for name, function, returns in functions:
            env.add_function(name, function, returns=returns)
        return env.sql(sql)

    return run


def _ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = TableEnv(spark)
    rows = [{"id": 1, "Price": 0.1, "at": 0}, {"ID": 2, "price": "2.5"}, {}]
    env.register_table("rows", env.from_rows(rows, {"id": "BIGINT", "price": "DOUBLE", "at": "TIMESTAMP"}))
    return env.sql("SELECT id, price, at AS moment FROM rows")


def _ingest_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = TableEnv(spark)
    items = [SimpleNamespace(itemId=1, name="a", ok=True), SimpleNamespace(itemId=2, name=None, ok=None)]
    env.register_table("items", env.from_objects(items, upper_underscore=True))
    return env.sql("SELECT item_id, name, ok FROM items")


QUERIES["function_scalar"] = _with_functions("nation", "SELECT n_nationkey, tagged(n_name) AS h FROM nation", ("tagged", lambda x: f"[{x.lower()}]", "string"))
ORACLES["function_scalar"] = "SELECT n_nationkey, '[' || lower(n_name) || ']' AS h FROM nation"
QUERIES["function_expression"] = _with_functions("lineitem", "SELECT l_orderkey, l_linenumber, net(l_extendedprice, l_discount) AS n FROM lineitem", ("net", "(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)", None))
ORACLES["function_expression"] = "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS n FROM lineitem"
QUERIES["function_table"] = _with_functions("part", "SELECT p.p_partkey, w.word FROM part p, LATERAL TABLE(words(p.p_name)) AS w(word)", ("words", _Words, "word string"))
ORACLES["function_table"] = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"
QUERIES["function_aggregate"] = _with_functions("supplier", "SELECT s_nationkey, round(product(CAST(s_nationkey AS DOUBLE)), 6) AS p FROM supplier GROUP BY s_nationkey", ("product", _Product, "double"))
ORACLES["function_aggregate"] = "SELECT s_nationkey, round(product(1 + s_nationkey / 10), 6) AS p FROM supplier GROUP BY s_nationkey"
QUERIES["ingest_rows"] = _ingest_rows
ORACLES["ingest_rows"] = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0.1 AS DOUBLE), TIMESTAMP '1970-01-01'), (2, 2.5, NULL), (NULL, NULL, NULL)) AS v(id, price, moment)"
QUERIES["ingest_objects"] = _ingest_objects
ORACLES["ingest_objects"] = "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', true), (2, NULL, NULL)) AS v(item_id, name, ok)"
QUERIES["stream_event_windows"] = windows.event_windows
ORACLES["stream_event_windows"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


class _Weighted:
    """The sum of products of two columns."""

    def init(self) -> float:
        return 0.0

    def add(self, state: float, weight: float, value: float) -> float:
        return state + weight * value


QUERIES["function_aggregate_columns"] = _with_functions("supplier", "SELECT s_nationkey % 5 AS g, round(weighted(NULLIF(s_nationkey, 3), s_acctbal), 4) AS w FROM supplier GROUP BY s_nationkey % 5", ("weighted", _Weighted, "double"))
ORACLES["function_aggregate_columns"] = "SELECT s_nationkey % 5 AS g, round(coalesce(sum(NULLIF(s_nationkey, 3) * s_acctbal), 0), 4) AS w FROM supplier GROUP BY 1"


def _shapes() -> types.ModuleType:
    """A module of two functions and a helper that is not registered."""
    module = types.ModuleType("shapes")

    def doubled(x: int) -> int:
        return None if x is None else 2 * x

    def shouted(x: str) -> str:
        return None if x is None else x.upper() + "!"

    for f in (doubled, shouted):
        f.__module__ = "shapes"
        setattr(module, f.__name__, f)
    return module


def _env_query(tables: str, run: Callable[[TableEnv], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(environment(spark, sf_dir, tables))

    return query


def _module(env: TableEnv) -> DataFrame:
    env.add_function("shapes", _shapes(), kind="module")
    return env.sql("SELECT n_nationkey, doubled(n_regionkey) AS d, shouted(n_name) AS s FROM nation")


def _macro(env: TableEnv) -> DataFrame:
    env.add_function("southern", lambda spark: spark.sql("SELECT * FROM nation WHERE n_regionkey < 2"), kind="macro")
    return env.sql("SELECT n_name FROM southern")


def _override(env: TableEnv) -> DataFrame:
    text = "SELECT n_name FROM nation"
    env.override(text, lambda spark: spark.sql("SELECT upper(n_name) AS n_name FROM nation WHERE n_nationkey < 9"))
    return env.sql(text)


def _cached(env: TableEnv) -> DataFrame:
    """A statement that is planned once, and again after its table has changed."""
    text = "SELECT count(*) AS n FROM t"
    counts = []
    for limit in (5, 9):
        env.register_table("t", env.sql(f"SELECT * FROM nation WHERE n_nationkey < {limit}"))
        counts += env.sql_query(text).to_map_list() + env.sql_query(text).to_map_list()
    return env.from_rows(counts, {"n": "BIGINT"}).df


def _cursor(env: TableEnv) -> DataFrame:
    connection = sqlite3.connect(":memory:")
    connection.executescript("CREATE TABLE sea (id INTEGER, name TEXT, depth REAL); INSERT INTO sea VALUES (1, 'north', 95.5), (2, 'south', NULL), (3, NULL, 1000)")
    env.register_table("sea", env.from_cursor(connection.execute("SELECT id, name, depth FROM sea")))
    return env.sql("SELECT CAST(id AS BIGINT) AS id, name, CAST(depth AS DOUBLE) AS depth FROM sea")


def _values(env: TableEnv) -> DataFrame:
    kinds = {"a": "DECIMAL", "b": "BOOLEAN", "c": "DATE", "d": "INT", "e": "VARCHAR", "f": "DOUBLE"}
    rows = [{"a": "1.25", "b": True, "c": datetime.date(2020, 2, 29), "d": 7, "e": 12, "f": 3}, {"A": 2, "B": None, "D": "8", "F": "0.5"}]
    env.register_table("v", env.from_rows(rows, kinds))
    return env.sql("SELECT CAST(a AS DOUBLE) AS a, b, c, d, e, f FROM v")


def _csv(env: TableEnv) -> DataFrame:
    path = windows.folder(env.spark)
    env.sql("SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) AS r FROM nation").write.option("header", True).option("sep", "|").csv(path)
    env.register_table("c", env.from_csv(path, header=True, sep="|", schema="n_nationkey INT, n_name STRING, r INT"))
    return env.sql("SELECT n_nationkey, n_name, r FROM c")


def _described(env: TableEnv) -> DataFrame:
    return env.sql("DESCRIBE nation").select("col_name", "data_type")


def _explained(env: TableEnv) -> DataFrame:
    plan = env.sql_query("EXPLAIN PLAN FOR SELECT n_name FROM nation WHERE n_nationkey < 3").to_map_list()[0]["plan"]
    code = env.execution_code("SELECT n_nationkey + 1 AS k FROM nation")
    return env.from_rows([{"scan": "Scan parquet" in plan, "pushed": "LessThan(n_nationkey,3)" in plan, "code": "codegen" in code.lower()}], {"scan": "BOOLEAN", "pushed": "BOOLEAN", "code": "BOOLEAN"}).df


def _maps(env: TableEnv) -> DataFrame:
    """Results as maps, given back as a table: the last of two columns with one name counts."""
    rows = env.sql_query("SELECT n_nationkey AS K, n_name AS a, upper(n_name) AS A FROM nation").to_map_list()
    return env.from_rows(rows, {"k": "INT", "a": "VARCHAR"}).df


def _settings(env: TableEnv) -> DataFrame:
    return env.sql("SET tidemark.note = tide").unionByName(env.sql("SET tidemark.note"))


_SEVEN = "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000"
for _name, _tables, _run, _duck in (
    ("statement_markers", "orders", lambda env: env.sql_query("SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ?", [7, 1000.0]).df, _SEVEN),
    ("statement_named_markers", "orders", lambda env: env.sql_query("SELECT o_orderkey FROM orders WHERE o_custkey = :who AND o_totalprice > :least", {"who": 7, "least": 1000.0}).df, _SEVEN),
    ("statement_describe", "nation", _described, "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS v(col_name, data_type)"),
    ("statement_explain", "nation", _explained, "SELECT true AS scan, true AS pushed, true AS code"),
    ("statement_settings", "", _settings, "SELECT 'tidemark.note' AS key, 'tide' AS value FROM range(2)"),
    ("function_module", "nation", _module, "SELECT n_nationkey, CAST(2 * n_regionkey AS BIGINT) AS d, upper(n_name) || '!' AS s FROM nation"),
    ("function_macro", "nation", _macro, "SELECT n_name FROM nation WHERE n_regionkey < 2"),
    ("plan_override", "nation", _override, "SELECT upper(n_name) AS n_name FROM nation WHERE n_nationkey < 9"),
    ("plan_cache", "nation", _cached, "SELECT CAST(n AS BIGINT) AS n FROM (VALUES (5), (5), (9), (9)) AS v(n)"),
    ("ingest_cursor", "", _cursor, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'north', CAST(95.5 AS DOUBLE)), (2, 'south', NULL), (3, NULL, 1000)) AS v(id, name, depth)"),
    ("ingest_value_conversion", "", _values, "SELECT * FROM (VALUES (CAST(1.25 AS DOUBLE), true, DATE '2020-02-29', 7, '12', CAST(3 AS DOUBLE)), (2, NULL, NULL, 8, NULL, 0.5)) AS v(a, b, c, d, e, f)"),
    ("ingest_csv", "nation", _csv, "SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) AS r FROM nation"),
    ("result_maps", "nation", _maps, "SELECT n_nationkey AS k, upper(n_name) AS a FROM nation"),
):
    QUERIES[_name], ORACLES[_name] = _env_query(_tables, _run), _duck


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_theta_outer_complex"](spark, sf_dir)
