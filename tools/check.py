"""Run registered queries against their DuckDB oracles: python tools/check.py [sf_dir] [names...]"""
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from rolloutlens.plans.catalog import ORACLE, QUERIES  # noqa: E402
from rolloutlens.plans.check import compare, duckdb_conn  # noqa: E402
from rolloutlens.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(QUERIES)
spark = local_session(8)
con = duckdb_conn(sf)
fails = 0
for n in names:
    t = time.time()
    try:
        df = QUERIES[n](spark, sf)
        if n in ORACLE:
            ok, msg = compare(df, con, ORACLE[n])
        else:
            ok, msg = True, f"{df.count()} rows (no oracle)"
    except Exception as e:  # noqa: BLE001
        ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
    fails += not ok
    print(f"{'OK  ' if ok else 'FAIL'} {n:32s} {time.time() - t:6.1f}s  {msg}", flush=True)
print(f"{len(names) - fails}/{len(names)} passed")
