"""Sources, catalog, functions and the plan cache."""

import dataclasses
import datetime as dt
import sqlite3
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import types as T

from tidemark.operators.env import EngineError, TableConfig, TableEnv
from tidemark.sources import ingest


@dataclasses.dataclass
class Base:
    a: int | None
    itemName: str


@dataclasses.dataclass
class Thing(Base):
    price: Decimal | None = None
    at: dt.datetime | None = None
    ok: bool | None = None
    parts: list | None = None
    _hidden: int = 0


@dataclasses.dataclass
class Part:
    n: int
    s: str


@pytest.fixture
def env(spark):
    return TableEnv(spark)


def test_rows_with_types(env):
    t = env.from_rows([{"C1": 2, "c2": 0.2, "c3": 0}, {}], {"c1": "BIGINT", "c2": "DECIMAL", "c3": "TIMESTAMP"})
    assert [f.dataType for f in t.schema] == [T.LongType(), T.DecimalType(38, 18), T.TimestampNTZType()] and all(f.nullable for f in t.schema)
    env.register_table("t", t)
    assert env.sql_query("select * from T").row_count() == 2
    assert t.to_map_list() == [{"c1": 2, "c2": Decimal("0.2"), "c3": dt.datetime(1970, 1, 1)}, {"c1": None, "c2": None, "c3": None}]


def test_times_are_wall_clock(spark):
    env = TableEnv(spark, TableConfig(time_zone="Asia/Shanghai"))
    moment = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    rows = [{"a": moment}, {"a": int(moment.timestamp() * 1000)}, {"a": "2020-01-01T08:00:00"}]
    assert {r["a"] for r in env.from_rows(rows, {"a": "TIMESTAMP"}).to_map_list()} == {dt.datetime(2020, 1, 1, 8)}


def test_objects(env):
    things = [Thing(1, "x", Decimal("1.5"), dt.datetime(2020, 1, 1), True, [Part(1, "p")]), Thing(None, "y")]
    t = env.from_objects(things, rename={"a": "alpha"}, upper_underscore=True)
    assert t.columns == ["ALPHA", "ITEM_NAME", "PRICE", "AT", "OK", "PARTS"]
    rows = t.to_map_list()
    assert rows[0]["item_name"] == "x" and rows[0]["parts"][0]["s"] == "p" and rows[1]["alpha"] is None
    with pytest.raises(ValueError, match="same class"):
        env.from_objects([Part(1, "a"), Thing(1, "b")])
    with pytest.raises(ValueError, match="empty"):
        env.from_objects([])


@pytest.mark.parametrize("value, kind, want", [(True, T.IntegerType(), 1), ("7", T.LongType(), 7), (1, T.StringType(), "1"), ("true", T.BooleanType(), True), (dt.datetime(2020, 1, 2, 3), T.DateType(), dt.date(2020, 1, 2)), (1.25, T.DecimalType(10, 2), Decimal("1.25")), (None, T.DateType(), None), ([1, None], T.ArrayType(T.StringType()), ["1", None])])
def test_conversion(value, kind, want):
    assert ingest.convert(value, kind, dt.timezone.utc) == want


def test_cursor(env):
    db = sqlite3.connect(":memory:")
    db.execute("create table t (id integer, name text)")
    db.executemany("insert into t values (?, ?)", [(1, "a"), (2, None)])
    t = env.from_cursor(db.execute("select id, name as label from t order by id"))
    assert t.columns == ["ID", "LABEL"] and t.to_map_list() == [{"id": 1, "label": "a"}, {"id": 2, "label": None}]


def test_jdbc(env, spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark.createDataFrame([(i, i * 2, "v") for i in range(10)], "ID int, S smallint, V string").write.format("jdbc").options(url=url, dbtable="t", driver=driver).save()
    except Exception as e:
        pytest.skip(f"no JDBC database here: {str(e)[:80]}")
    t = env.from_jdbc(url, "select id, s, v from t where id > 2", driver=driver)
    assert t.columns == ["ID", "S", "V"] and t.schema["S"].dataType == T.IntegerType() and t.row_count() == 7
    split = env.from_jdbc(url, "select id, s from t", column="ID", lower=0, upper=10, partitions=3, driver=driver)
    assert split.row_count() == 10 and split.df.rdd.getNumPartitions() == 3


def test_csv(env, tmp_path):
    (tmp_path / "x.csv").write_text("1|a|\n2||3.5\n")
    t = env.from_csv(str(tmp_path / "x.csv"), schema="k int, s string, d double")
    assert t.to_map_list() == [{"k": 1, "s": "a", "d": None}, {"k": 2, "s": None, "d": 3.5}]


def test_catalog(env, spark):
    env.add_sub_schema("test")
    env.register_table("Test", "t1", spark.createDataFrame([(1,)], "b int"))
    env.register_table("t2", spark.createDataFrame([(1, "x")], "b int, c string"))
    assert env.sql_query("select * from TEST.T1 join t2 on t1.b = t2.b").to_map_list() == [{"b": 1, "c": "x"}]
    assert env.sql_query("select z.b from test.t1 z, test.t1 as y").row_count() == 1
    assert env.table_names() == ["T2"] and env.table_names("test") == ["T1"] and env.get_table("test", "t1").row_count() == 1
    env.register_table("t2", spark.createDataFrame([(9, "y"), (8, "z")], "b int, c string"))
    assert env.sql_query("select * from t2").row_count() == 2
    with pytest.raises(EngineError, match="TEST.T1"):
        env.get_table("nope")


def test_functions(env, spark):
    class Doubler:
        def eval(self, x: int) -> int:
            return x * 2

    class Pieces:
        def eval(self, s: str):
            for part in (s or "").split():
                yield (part,)

    class Product:
        def init(self) -> float:
            return 1.0

        def add(self, state, value):
            return state * value

    env.add_function("hello", lambda x: f"hello,{x}")
    env.add_function("twice", Doubler)
    env.add_function("pieces", Pieces, returns="w string")
    env.add_function("plus", "(a INT, b INT) RETURNS INT RETURN a + b")
    env.add_function("product", Product)
    env.add_function("three", lambda s: s.range(3).toDF("n"), kind="macro")

    def upper(s: pd.Series) -> pd.Series:
        return s.str.upper()

    env.add_function("loud", upper, returns="string")
    assert env.sql_query("select hello('you') as a, TWICE(4) as b, plus(1, 2) as c, loud('x') as d").to_map_list() == [{"a": "hello,you", "b": 8, "c": 3, "d": "X"}]
    assert [r["w"] for r in env.sql_query("select w from lateral table(pieces('a b')) as t(w)").to_map_list()] == ["a", "b"]
    assert env.sql_query("select product(x) as p from (values (2D), (null), (4D)) as t(x)").to_map_list() == [{"p": 8.0}]
    assert env.sql_query("select sum(n) as n from three").to_map_list() == [{"n": 3}]
    with pytest.raises(ValueError):
        env.add_function("bad", 5)


def test_plan_cache_and_override(env, spark):
    env.register_table("t", spark.range(3))
    q = "select count(*) as n from t"
    assert env.execution_plan(q) is None and env.sql_query(q).to_map_list() == [{"n": 3}]
    assert env.execution_plan(q).sql and env.execution_code(q)
    env.register_table("t", spark.range(5))
    assert env.sql_query(q).to_map_list() == [{"n": 5}]
    env.clear_execution_plans()
    assert env.execution_plan(q) is None
    env.override(q, lambda s: s.range(1).selectExpr("42 AS n"))
    assert env.sql_query(q).to_map_list() == [{"n": 42}] and env.execution_plan(q).override
    small = TableEnv(spark, TableConfig(plan_cache_size=1))
    small.sql_query("select 1 as a")
    small.sql_query("select 2 as a")
    assert small.execution_plan("select 1 as a") is None and small.execution_plan("select 2 as a")
    off = TableEnv(spark, TableConfig(plan_cache_size=0))
    off.sql_query("select 1 as a")
    assert off.execution_plan("select 1 as a") is None


def test_settings_stay_apart(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    TableEnv(spark)
    assert spark.conf.get("spark.sql.ansi.enabled") == before
