"""Documents with the awkward cases every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, texts, lang="en", source="src0"):
    """Documents 0, 1, 2... of the texts; a text may be a whole row of SCHEMA."""
    rows = [t if isinstance(t, tuple) else (i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", "   \n\t ", "a", "one two three", "x" * 5000, "word " * 5000, "1 2 " * 3000, (907, "same id", None, None, None), (907, "same id", None, None, None), (None, "no id at all here", "en", None, 3), "éñ \U0001f600 café \x0b\x0c\x1f end", "line\nline\nline"]


def corpus(sf, table="documents"):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()
