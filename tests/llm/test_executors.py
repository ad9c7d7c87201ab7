"""Executors have no copy of the package: what they run travels with the task."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def missing(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("raresift") is None] * len(b))], names=["x"])
assert all(r.x for r in spark.range(2).mapInArrow(missing, "x boolean").collect()), "the package is there"
from raresift.llm import queries
for name in {names!r}:
    assert queries.QUERIES[name](spark, {sf!r}).count() > 0, name
print("whole")
"""


def test_no_copy_of_the_package(sf, tmp_path):
    names = ["op3_decontamination", "op9_toxicity", "op10_quality", "op11_token_files", "op12_spelling_variants", "op13_whitening"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if os.environ.get("PYTHONPATH"):
        env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ["PYTHONPATH"].split(os.pathsep) if os.path.abspath(p or ".") != REPO)
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, names=names, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("whole"), out.stderr[-2000:]
