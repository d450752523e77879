"""The table environment: a case-insensitive catalog with one level of schemas, functions, and queries."""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import registry
from tidemark.operators.table import DataTable
from tidemark.plans.dialect import Dialect, view_name
from tidemark.plans.sqltree import DialectError
from tidemark.sources import ingest


class EngineError(RuntimeError):
    """A query that failed; names the registered tables."""


@dataclass
class TableConfig:
    """time_zone is the session's; plan_cache_size bounds the cache of rewritten statements, 0 turns it off; conf has
    further Spark settings."""

    time_zone: str = "UTC"
    plan_cache_size: int = 200
    conf: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ExecutionPlan:
    """What a statement runs as: Spark SQL, or a Python function put in its place."""

    sql: str
    override: Callable[[SparkSession], DataFrame] | None = None


class TableEnv:
    """Tables, functions and queries of one session.

    The plan cache keeps rewritten text, not DataFrames: a table registered anew is seen by the next run of a cached
    statement. hive=False leaves statements as they are."""

    def __init__(self, spark: SparkSession, config: TableConfig | None = None, hive: bool = True):
        self.config = config or TableConfig()
        self.spark = spark.newSession()
        # casts that fail, indexes out of range and divisions by zero give null in this dialect
        profile = {"spark.sql.ansi.enabled": "false", "spark.sql.caseSensitive": "false", "spark.sql.session.timeZone": self.config.time_zone, "spark.sql.parser.escapedStringLiterals": "false"}
        for key, value in (profile | self.config.conf).items():
            self.spark.conf.set(key, value)
        self.hive = hive
        self._tables: dict[tuple[str, str], DataTable] = {}
        self._schemas: set[str] = set()
        self._overrides: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self._plans: OrderedDict[str, ExecutionPlan] = OrderedDict()
        self._dialect = Dialect(lambda: [k for k in self._tables if k[0]])

    # -- catalog ----------------------------------------------------------------------------------------------------

    def add_sub_schema(self, name: str) -> None:
        self._schemas.add(name.upper())

    def register_table(self, *args: Any) -> None:
        """register_table(name, table) or register_table(schema, name, table); a table of that name is replaced."""
        schema, name, table = ("", *args) if len(args) == 2 else args
        table = table if isinstance(table, DataTable) else DataTable(table)
        df = self.adopt(table.df)
        df.createOrReplaceTempView(f"`{view_name(schema, name)}`" if schema else name)
        if schema:
            self._schemas.add(schema.upper())
        self._tables[schema.upper(), name.upper()] = DataTable(df)
        self._plans.clear()

    def adopt(self, df: DataFrame) -> DataFrame:
        """The DataFrame as one of this environment's session, so that its settings hold."""
        if df.sparkSession is self.spark:
            return df
        jvm_df = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().analyzed()) if hasattr(self.spark, "_jsparkSession") else None
        return DataFrame(jvm_df, self.spark) if jvm_df is not None else df

    def get_table(self, *args: str) -> DataTable:
        schema, name = ("", *args) if len(args) == 1 else args
        try:
            return self._tables[schema.upper(), name.upper()]
        except KeyError:
            raise EngineError(f"no table {'.'.join(args)}; {self._known()}") from None

    def table_names(self, schema: str = "") -> list[str]:
        return sorted(n for s, n in self._tables if s == schema.upper())

    def _known(self) -> str:
        return f"registered tables: {', '.join(sorted('.'.join(filter(None, k)) for k in self._tables)) or 'none'}"

    # -- sources ----------------------------------------------------------------------------------------------------

    def from_rows(self, rows: list[dict[str, Any]], types: dict[str, str]) -> DataTable:
        return DataTable(ingest.from_rows(self.spark, rows, types))

    def from_objects(self, objects: list[Any], rename: dict[str, str] | None = None, upper_underscore: bool = False) -> DataTable:
        return DataTable(ingest.from_objects(self.spark, objects, rename, upper_underscore))

    def from_jdbc(self, url: str, query: str, **options: Any) -> DataTable:
        return DataTable(ingest.from_jdbc(self.spark, url, query, **options))

    def from_cursor(self, cursor: Any) -> DataTable:
        return DataTable(ingest.from_cursor(self.spark, cursor))

    def from_csv(self, path: str, **options: Any) -> DataTable:
        return DataTable(ingest.from_csv(self.spark, path, **options))

    def from_parquet(self, path: str) -> DataTable:
        return DataTable(self.spark.read.parquet(path))

    # -- functions --------------------------------------------------------------------------------------------------

    def add_function(self, name: str, function: Any, kind: str | None = None, returns: Any = None, schema: str = "") -> None:
        """See tidemark.functions.registry.add_function."""
        if schema:
            self._schemas.add(schema.upper())
        registry.add_function(self.spark, name, function, kind, returns)
        self._plans.clear()

    def register_hive_function(self, name: str, class_name: str, jar: str | None = None) -> None:
        registry.register_hive_function(self.spark, name, class_name, jar)
        self._plans.clear()

    # -- queries ----------------------------------------------------------------------------------------------------

    def sql_query(self, sql: str, args: list[Any] | dict[str, Any] | None = None) -> DataTable:
        """Run a statement, with values for its ? or :name markers; the result is lazy."""
        try:
            plan = self.execution_plan(sql) or self._plan(sql)
            return DataTable(plan.override(self.spark) if plan.override else self.spark.sql(plan.sql, args=args))
        except Exception as e:
            raise EngineError(f"{e}; {self._known()}") from e

    def sql(self, sql: str) -> DataFrame:
        return self.sql_query(sql).df

    def rewrite(self, sql: str) -> str:
        """The Spark SQL that a statement runs as."""
        return self._dialect.rewrite(sql) if self.hive else sql

    def _plan(self, sql: str) -> ExecutionPlan:
        override = self._overrides.get(sql)
        plan = ExecutionPlan("" if override else self.rewrite(sql), override)
        if self.config.plan_cache_size > 0:
            self._plans[sql] = plan
            while len(self._plans) > self.config.plan_cache_size:
                self._plans.popitem(last=False)
        return plan

    # -- plans ------------------------------------------------------------------------------------------------------

    def execution_plan(self, sql: str) -> ExecutionPlan | None:
        """The cached plan of a statement."""
        if sql in self._plans:
            self._plans.move_to_end(sql)
        return self._plans.get(sql)

    def clear_execution_plans(self) -> None:
        self._plans.clear()

    def execution_code(self, sql: str) -> str:
        """The physical plan and the code that Spark generates for a statement."""
        return self.spark.sql(f"EXPLAIN CODEGEN {self.rewrite(sql)}").first()[0]

    def explain(self, sql: str, mode: str = "FORMATTED") -> str:
        return self.spark.sql(f"EXPLAIN {mode} {self.rewrite(sql)}").first()[0]

    def override(self, sql: str, run: Callable[[SparkSession], DataFrame]) -> None:
        """Use a function in place of a statement."""
        self._overrides[sql] = run
        self._plans.pop(sql, None)


hive_env = functools.partial(TableEnv, hive=True)

__all__ = ["DialectError", "EngineError", "ExecutionPlan", "TableConfig", "TableEnv", "hive_env"]
