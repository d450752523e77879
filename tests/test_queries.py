"""Every registered statement against DuckDB, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return connection


def plain(rows):
    return sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_duckdb(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    assert name in catalog.ORACLES
    cursor = duck.execute(catalog.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(df.columns) == sorted(kinds)
    want = cursor.fetchall()
    order = [list(kinds).index(c) for c in df.columns]
    assert plain(map(tuple, df.collect())) == plain(tuple(r[i] for i in order) for r in want)
    for f in df.schema:
        assert KINDS.get(f.dataType.simpleString(), f.dataType.simpleString().upper()).replace(" ", "") == kinds[f.name].replace(" ", "")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_outer_join_keeps_one_join_and_prunes(spark, sf):
    """Equality and bound are one join condition, and the scans read only what is used."""
    plan = catalog.environment(spark, sf, "orders lineitem").explain("SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderkey < 1000")
    assert plan.count("Join ") + plan.count("Join\n") and "NestedLoop" not in plan and "l_extendedprice" not in plan
    plan = catalog.environment(spark, sf, "lineitem").explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49" in plan and "l_comment" not in plan
