from tidemark.streaming import windows


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """A second run reads the new files only, and windows come out once they are final."""
    schema = "ts timestamp, event_type string, value double"

    def put(day, n):
        spark.sql(f"SELECT timestamp '2024-01-{day:02d} 10:30:00' AS ts, 'a' AS event_type, CAST(id AS DOUBLE) AS value FROM range({n})").write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = windows.drain(windows.tumbling(stream, "ts", "1 hour", "1 day", ["event_type"], "value"), f"file://{tmp_path}/s")
        return sorted((r["start"].day, r["n"], r["total"]) for r in out.collect())

    put(1, 3)
    assert run() == []
    put(5, 2)
    assert run() == [(1, 3, 3.0)]
    put(9, 1)
    assert run() == [(1, 3, 3.0), (5, 2, 1.0)]


def test_late_rows_and_the_end(spark, tmp_path):
    """Rows later than the watermark are dropped from windows that are out; settle() has every window at the end."""
    schema = "ts timestamp, event_type string, value double"

    def put(day, n):
        spark.sql(f"SELECT timestamp '2024-01-{day:02d} 10:30:00' AS ts, 'a' AS event_type, CAST(id AS DOUBLE) AS value FROM range({n})").write.mode("append").parquet(f"{tmp_path}/in")

    def run(how, watermark=True):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = how(windows.tumbling(stream, "ts", "1 hour", "1 day", ["event_type"], "value"), f"file://{tmp_path}/{how.__name__}")
        return sorted((r["start"].day, r["n"]) for r in out.collect())

    put(1, 3)
    put(5, 2)
    assert run(windows.drain) in ([], [(1, 3)]) and run(windows.settle) == [(1, 3), (5, 2)]
    put(9, 1)
    assert run(windows.drain) == [(1, 3), (5, 2)]
    put(1, 4)  # too late
    assert run(windows.drain) == [(1, 3), (5, 2)]
    assert run(windows.settle)[-1] == (9, 1)
