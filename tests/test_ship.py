"""Queries that run Python in workers must work wherever the driver was started."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
from palimpsest import ship
ship(spark)
print("ROWS", entry.queries()["string_ratios"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in done.stdout, done.stderr[-2000:]
