"""Tables in the folder that all executors share, and small helpers for native expressions."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
#: How many rows go to a Python worker at once, at most.
BATCH_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where none is set and the executors are
    threads of this process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; a leftover table is harmless
        pass


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost
    executors. The table goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    batch = spark.conf.get(_BATCH)
    rows = int(batch)
    spark.conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))  # rows hold whole texts
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, batch)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str, limit: int) -> DataFrame:
    """Join with a broadcast of right where it is known to have at most limit rows, else by shuffling."""
    return left.join(F.broadcast(right) if small(right, limit) else right, on, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and bind it in body; lambdas would otherwise evaluate it for every element."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Words of the text, in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
