"""The package reaches Python workers wherever the driver starts."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_module", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("h10_bootstrap_ci", "i11_filtered_tail_ranks", "p01_pluggable_scorer"):
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


def test_queries_run_from_another_folder(tmp_path, small):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO / "__spark_entry__.py"), small],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 6
