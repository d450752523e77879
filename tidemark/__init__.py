"""tidemark: a Spark-first SQL engine with a Hive-flavoured dialect and a small table API."""

__version__ = "0.1.0"
