"""Regression: the pandas stages must work when the driver starts outside the repository
(Python workers then import the package shipped with addPyFile)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(REPO, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
rows = m.queries()["isolation_forest"](spark, "/root/testdata/sf0.001").collect()
print("ROWS", len(rows))
"""


def test_isolation_forest_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="flowlens-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 15" in out.stdout, out.stderr[-2000:]
