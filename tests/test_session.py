"""The package on executors that were started elsewhere."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from freshet.session import build_session
sys.path.remove({root!r})
spark = build_session("elsewhere", "local-cluster[1,2,1024]", **{{
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {shared!r}, "spark.driver.memory": "1g",
}})
for name in ("fold_keys", "bm25_index"):
    print(name, entry.queries()[name](spark, {sf!r}).count())
spark.stop()
"""


def test_started_from_another_folder(tmp_path, sf):
    code = SCRIPT.format(root=ROOT, sf=sf, shared=str(tmp_path / "shared"))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    errors = [line for line in done.stderr.splitlines() if "ERROR" in line or "Error" in line or "Exception" in line]
    assert "fold_keys 200" in done.stdout and "bm25_index" in done.stdout, "\n".join([f"exit {done.returncode}", *errors[:40], done.stderr[-6000:]])


def test_no_fused_stage_is_too_long_to_be_compiled(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
