"""Queries run where the package is not on the workers' path: workers don't get what the driver adds to its own."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_from_another_folder(tmp_path):
    code = f"""
        import importlib.util
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("entry_points", "{ROOT}/__spark_entry__.py")
        entry_points = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(entry_points)
        spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
                 .config("spark.checkpoint.dir", "{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate())
        print("rows", entry_points.queries()["retrieve_topk"](spark, "/root/testdata/sf0.001").count())
    """
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=300,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert "rows " in done.stdout, done.stderr[-2000:]
