import subprocess
import sys
import textwrap


def test_workers_find_the_package_from_anywhere(tmp_path):
    """A driver that runs outside the repository, with the package on its own path only."""
    import tidemark

    root = str(tidemark.__path__[0]).rsplit("/", 1)[0]
    (tmp_path / "main.py").write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        from tidemark.plans import catalog
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        print("rows", catalog.QUERIES["function_table"](spark, "/root/testdata/sf0.001").count())
        spark.stop()
    """))
    done = subprocess.run([sys.executable, "main.py"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "rows " in done.stdout, done.stderr[-2000:]
