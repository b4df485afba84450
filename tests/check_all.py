"""Compare all queries at a scale: ``python tests/check_all.py [sf_dir] [name part...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import __spark_entry__ as entry  # noqa: E402
from flowlens.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
parts = sys.argv[2:]
spark = local_session("8")
con = connect(sf_dir)
oracles, failed = entry.oracle_sql(), 0
for name, run in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    began = time.time()
    try:
        df = run(spark, sf_dir)
        if name in oracles:
            problem = compare(df, con, oracles[name])
        else:
            n = df.count()
            problem = None if n else "no rows"
    except Exception as e:  # noqa: BLE001
        problem = f"{type(e).__name__}: {str(e)[:1500]}"
    failed += problem is not None
    kind = "oracle" if name in oracles else "rows"
    print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - began:6.2f}s {kind:6} {name} {problem or ''}", flush=True)
print(f"{failed} failed")
