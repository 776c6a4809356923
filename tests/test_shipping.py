import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"

PROGRAM = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate())
for name in ("most_similar", "cf_topk", "guess_by_star"):
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_workers_get_the_package_in_any_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM, f"{ROOT}/__spark_entry__.py", SMALL],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600,
    )
    counts = dict(line.split() for line in done.stdout.splitlines() if len(line.split()) == 2)
    assert {"most_similar", "cf_topk", "guess_by_star"} <= set(counts), done.stderr[-2000:]
    assert all(int(n) > 0 for n in counts.values())
