"""Workers that can't import the package run every query: what they get travels by value."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
lacks = spark.range(1).mapInPandas(lambda batches: (b.assign(id=int(__import__("importlib.util").util.find_spec("rasterloom") is None)) for b in batches), "id long")
assert lacks.first()[0] == 1
from rasterloom.llm.queries import QUERIES
for name in sys.argv[3:]:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_without_the_package_on_workers(tmp_path):
    names = ["op1_ngram_jaccard_join", "op2_quality_rules", "op4_transport_streams", "op5_rans_token_files", "op8_maxent_lm", "op10_zstd_language_id"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if os.path.isdir("/opt/tokenizers"):
        env["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__import__("public_tokenizers").__file__)))
    out = subprocess.run([sys.executable, "-c", SCRIPT, REPO, str(tmp_path), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [line.split()[0] for line in out.stdout.splitlines() if line.startswith("op")] == names
