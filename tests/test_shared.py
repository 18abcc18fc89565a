"""Intermediate tables on a session that names no shared folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
from pyspark.sql import SparkSession
from zscape.shared import shared_dir, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_dir(spark) == shared_dir(spark.newSession())
assert written(spark.range(3), "rows").count() == 3
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("went well")
"""


def test_a_local_session_without_a_shared_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "went well" in out.stdout, out.stderr[-3000:]
