"""Statements over streams: a streaming table is registered like any other, and its result is drained into a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.env import TableEnv


def folder(spark: SparkSession) -> str:
    """Where a stream keeps its state and results: the cluster's shared folder; a temporary one only where none is set and the
    executors are threads of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a streaming result over all input that is there, append it to Parquet files at path, and read them. A run
    with the same path goes on where the last one stopped."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def settle(stream: DataFrame, path: str) -> DataFrame:
    """Run a streaming aggregate over all input that is there and read its whole result as it then stands: every group, those
    that a watermark has not passed too. A run with the same path goes on where the last one stopped."""
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{number}")  # a batch that is run again writes the same
        last.append(number)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    session = stream.sparkSession
    return session.read.schema(stream.schema).parquet(f"{path}/out/{last[-1]}") if last else session.createDataFrame([], stream.schema)


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum of value in tumbling windows of time by keys, final once the watermark has passed them; rows later than
    late are dropped when their window is final."""
    by = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return by.agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events table, which is read as a stream of files."""
    env = TableEnv(spark)
    session = env.spark
    schema = session.read.parquet(f"{sf_dir}/events.parquet").schema
    env.register_table("events", session.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    timed = env.sql("SELECT CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM events")
    env.register_table("timed", timed)
    sql = "SELECT window(ts, '1 hour').start AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM timed GROUP BY window(ts, '1 hour'), event_type"
    return settle(env.sql(sql), folder(session)).withColumn("start", F.col("start").cast("timestamp_ntz"))
