"""Check registered queries against their SQL: python tests/check.py [sf dir] [name part ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from freshet.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("check", f"local[{os.environ.get('CHECK_CORES', 8)}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf), entry.oracle_sql()
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                n = compare(spark, con, sf, run, sql[name])
                print(f"ok    {name} rows={n} {time.time() - start:.1f}s", flush=True)
            else:
                print(f"rows  {name} rows={run(spark, sf).count()} {time.time() - start:.1f}s", flush=True)
        except Exception as err:  # noqa: BLE001
            text = str(err) if isinstance(err, AssertionError) else "".join(traceback.format_exception_only(err))
            print(f"FAIL  {name} {time.time() - start:.1f}s {text[:1500]}", flush=True)
