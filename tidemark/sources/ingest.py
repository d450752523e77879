"""Tables from Python rows and objects, JDBC, database cursors and CSV files."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL type names and the types they stand for. A decimal has room for 20 digits before and 18 after the point.
SQL_TYPES: dict[str, T.DataType] = {
    "VARCHAR": T.StringType(), "CHAR": T.StringType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "INT": T.IntegerType(),
    "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "DECIMAL": T.DecimalType(38, 18), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(),
}
_PYTHON: dict[type, T.DataType] = {
    str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), Decimal: T.DecimalType(38, 18), dt.datetime: T.TimestampNTZType(), dt.date: T.DateType(), bytes: T.BinaryType(),
}


def type_of(name: str) -> T.DataType:
    """A type by SQL name; anything else is read as Spark's own notation."""
    return SQL_TYPES.get(name.strip().upper()) or T._parse_datatype_string(name)


def _zone(spark: SparkSession) -> dt.tzinfo:
    from zoneinfo import ZoneInfo

    return ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))


def convert(value: Any, kind: T.DataType, zone: dt.tzinfo) -> Any:
    """A value as the type has it: numbers are widened, booleans are 1 and 0 as numbers, times are wall-clock times of the
    zone, also from milliseconds; nulls stay."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(kind, T.BooleanType):
        return value.strip().lower() == "true" if isinstance(value, str) else bool(value)
    if isinstance(kind, T.IntegralType):
        return int(Decimal(value.strip())) if isinstance(value, str) else int(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        if isinstance(value, bool) or isinstance(value, (int, float)):
            return dt.datetime.fromtimestamp(value / 1000, zone).replace(tzinfo=None)
        if isinstance(value, str):
            value = dt.datetime.fromisoformat(value)
        if isinstance(value, dt.datetime):
            return value.astimezone(zone).replace(tzinfo=None) if value.tzinfo else value
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(kind, T.DateType):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return dt.datetime.fromtimestamp(value / 1000, zone).date()
        if isinstance(value, str):
            return dt.date.fromisoformat(value[:10])
        return value.date() if isinstance(value, dt.datetime) else value
    if isinstance(kind, T.ArrayType):
        return [convert(v, kind.elementType, zone) for v in value]
    if isinstance(kind, T.StructType):
        get = value.get if isinstance(value, dict) else lambda n: getattr(value, n, None)
        return tuple(convert(get(f.name), f.dataType, zone) for f in kind)
    return value


def from_rows(spark: SparkSession, rows: list[dict[str, Any]], types: dict[str, str]) -> DataFrame:
    """Rows as maps, with a type name for each column; names are lower-cased, missing keys are null, and columns come in the
    order of the types."""
    schema = T.StructType([T.StructField(n.lower(), type_of(t), True) for n, t in types.items()])
    zone = _zone(spark)
    lowered = [{k.lower(): v for k, v in r.items()} for r in rows]
    return spark.createDataFrame([tuple(convert(r.get(f.name), f.dataType, zone) for f in schema) for r in lowered], schema)


def column_name(name: str, rename: dict[str, str] | None, upper_underscore: bool) -> str:
    """The renamed field, then lowerCamel as UPPER_UNDERSCORE if asked for."""
    name = (rename or {}).get(name, name)
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).upper() if upper_underscore else name


def _fields(value: Any) -> dict[str, Any]:
    """Names and values of an object's public fields, those of its base classes included."""
    if dataclasses.is_dataclass(value):
        return {f.name: getattr(value, f.name) for f in dataclasses.fields(value) if not f.name.startswith("_") and not f.metadata.get("transient")}
    return {k: v for k, v in vars(value).items() if not k.startswith("_")}


def _kind(values: list[Any], hint: Any) -> T.DataType:
    known = [v for v in values if v is not None]
    if known and isinstance(known[0], (list, tuple)):
        inner = [x for v in known for x in v]
        return T.ArrayType(_kind(inner, None))
    if known and (dataclasses.is_dataclass(known[0]) or hasattr(known[0], "__dict__")) and type(known[0]) not in _PYTHON:
        names = list(_fields(known[0]))
        return T.StructType([T.StructField(n, _kind([getattr(v, n) for v in known], None)) for n in names])
    if known:
        return _PYTHON.get(type(known[0]), T.StringType())
    return next((t for p, t in _PYTHON.items() if hint is not None and (hint is p or getattr(p, "__name__", "") in str(hint))), T.StringType())


def from_objects(spark: SparkSession, objects: list[Any], rename: dict[str, str] | None = None, upper_underscore: bool = False) -> DataFrame:
    """Objects of one class, a column for each field; all columns are nullable."""
    if not objects:
        raise ValueError("an empty list has no columns; use from_rows with types")
    if len({type(o) for o in objects}) > 1:
        raise ValueError("all objects must have the same class")
    names = list(_fields(objects[0]))
    hints = getattr(type(objects[0]), "__annotations__", {})
    kinds = [_kind([getattr(o, n) for o in objects], hints.get(n)) for n in names]
    schema = T.StructType([T.StructField(column_name(n, rename, upper_underscore), k, True) for n, k in zip(names, kinds, strict=True)])
    zone = _zone(spark)
    return spark.createDataFrame([tuple(convert(getattr(o, n), k, zone) for n, k in zip(names, kinds, strict=True)) for o in objects], schema)


def widened(df: DataFrame) -> DataFrame:
    """Upper-cased labels; small integers as integers, as for result sets."""
    small = (T.ShortType, T.ByteType)
    return df.select(*[(F.col(f"`{f.name}`").cast("int") if isinstance(f.dataType, small) else F.col(f"`{f.name}`")).alias(f.name.upper()) for f in df.schema])


def from_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, lower: Any = None, upper: Any = None, partitions: int = 1, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A query over JDBC, split by ranges of a column where one is given, so that the read is distributed."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    if column is None:
        return widened(reader.option("query", query).load())
    return widened(reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load())


def from_cursor(spark: SparkSession, cursor: Any) -> DataFrame:
    """All rows of an executed DB-API cursor. The cursor is the driver's, so this is for results that fit into it; from_jdbc
    reads on the executors."""
    names = [d[0].upper() for d in cursor.description]
    rows = [tuple(r) for r in cursor.fetchall()]
    kinds = [_kind([r[i] for r in rows], None) for i in range(len(names))]
    zone = _zone(spark)
    schema = T.StructType([T.StructField(n, k, True) for n, k in zip(names, kinds, strict=True)])
    return spark.createDataFrame([tuple(convert(v, k, zone) for v, k in zip(r, kinds, strict=True)) for r in rows], schema)


def from_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str = "|", header: bool = False) -> DataFrame:
    """A separated file, with a schema if possible: without one every column is a string."""
    reader = spark.read.option("sep", sep).option("header", header)
    return (reader.schema(schema) if schema is not None else reader).csv(path)
