"""Command line: python -m tests.run_compare [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from barloom.session import local_session
from tests.compare import compare, connect

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf)
    q, s = entry.queries(), entry.oracle_sql()
    pick = sys.argv[1:]
    bad = 0
    for name in q:
        if pick and not any(name.startswith(p) for p in pick):
            continue
        try:
            if name in s:
                ok, note, sec, n = compare(spark, con, name, q[name], s[name], sf)
            else:
                t0 = time.time()
                n = q[name](spark, sf).count()
                ok, note = n > 0, f"rows only {time.time() - t0:.1f}s"
        except Exception as e:  # noqa: BLE001
            ok, note, n = False, f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += not ok
        print("ok " if ok else "BAD", name, n, note, flush=True)
    print("failed", bad)
