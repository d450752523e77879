"""User functions: scalar, table, macro and aggregate."""

from __future__ import annotations

import inspect
import types
import typing
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark types of Python annotations.
TYPES: dict[Any, T.DataType] = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}
KINDS = ("scalar", "table", "macro", "aggregate", "expression")


def _type(annotation: Any) -> T.DataType | None:
    if isinstance(annotation, T.DataType):
        return annotation
    if isinstance(annotation, str):
        return T._parse_datatype_string(annotation)
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(annotation) if a is not type(None)]
        return _type(rest[0]) if len(rest) == 1 else None
    if typing.get_origin(annotation) is list:
        return T.ArrayType(_type(typing.get_args(annotation)[0]))
    return TYPES.get(annotation)


def _kind(function: Any) -> str:
    """In the order table function, macro, all of a module, scalar, aggregate."""
    if isinstance(function, str):
        return "expression"
    if inspect.isclass(function):
        if hasattr(function, "eval") and inspect.isgeneratorfunction(function.eval):
            return "table"
        if hasattr(function, "init") and hasattr(function, "add"):
            return "aggregate"
        if hasattr(function, "eval"):
            return "scalar"
    if isinstance(function, types.ModuleType):
        return "module"
    if callable(function):
        return "table" if inspect.isgeneratorfunction(function) else "scalar"
    raise ValueError("a function, a class with eval or with init and add, a module or an SQL expression is expected")


def _scalar(function: Any, returns: Any) -> Any:
    """Vectorised when the function takes and gives pandas series, else a function of single values over Arrow batches."""
    hints = typing.get_type_hints(function)
    if pd.Series in hints.values():
        return F.pandas_udf(function, _type(returns) or T.StringType())
    return F.udf(function, _type(returns) or _type(hints.get("return")) or T.StringType(), useArrow=True)


def _aggregate(cls: Any, returns: Any) -> Any:
    """A class with init(), add(state, value, ...), and result(state) if the state is not the result. Each group is folded
    row by row by one worker that holds its columns: for what no native aggregate can say. Groups that may be large are
    better split first, by an inner GROUP BY with a hash of a key, where the states can be combined."""
    target = cls() if inspect.isclass(cls) else cls
    hints = typing.get_type_hints(target.result) if hasattr(target, "result") else typing.get_type_hints(target.init)
    kind = _type(returns) or _type(hints.get("return")) or T.DoubleType()

    def run(*columns):
        state = target.init()
        for values in zip(*columns, strict=True):
            if not any(v is None or v != v for v in values):  # rows with a null are not seen
                state = target.add(state, *values)
        return target.result(state) if hasattr(target, "result") else state

    return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)  # of any number of columns


def add_function(spark: SparkSession, name: str, function: Any, kind: str | None = None, returns: Any = None) -> None:
    """Register a function for SQL under a case-insensitive name.

    scalar: a function or a class with eval; table: a generator function or a class whose eval yields rows; macro: a
    function of the session that gives a DataFrame, registered as a view when it takes nothing else; aggregate: a class
    with init, add and maybe result, over one or more columns; expression: SQL text "(x INT) RETURNS INT RETURN x + 1". A module
    registers all its public functions. returns is a type, where annotations don't tell."""
    kind = kind or _kind(function)
    if kind == "module":
        for key, value in vars(function).items():
            if inspect.isfunction(value) and not key.startswith("_") and value.__module__ == function.__name__:
                add_function(spark, key, value, returns=returns)
    elif kind == "expression":
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {function}")
    elif kind == "scalar":
        target = function().eval if inspect.isclass(function) else function
        spark.udf.register(name, _scalar(target, returns))
    elif kind == "table":
        handler = function if inspect.isclass(function) else type(function.__name__, (), {"eval": staticmethod(function)})
        spark.udtf.register(name, F.udtf(handler, returnType=returns or "value string"))
    elif kind == "macro":
        function(spark).createOrReplaceTempView(name)
    elif kind == "aggregate":
        spark.udf.register(name, _aggregate(function, returns))
    else:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")


def register_hive_function(spark: SparkSession, name: str, class_name: str, jar: str | None = None) -> None:
    """A Hive UDF, GenericUDF, UDAF or UDTF class; needs a session with Hive support."""
    using = f" USING JAR '{jar}'" if jar else ""
    spark.sql(f"CREATE TEMPORARY FUNCTION {name} AS '{class_name}'{using}")
