"""python tests/check.py [sf_dir] [name …]: run queries against their SQL twins and report."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import make_session  # noqa: E402
from oracle import compare, connect  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = make_session(), connect(sf)
    qs, sqls, bad = queries(), oracle_sql(), 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            ok, msg, took = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += not ok
        print(("ok  " if ok else "FAIL"), f"{took:5.1f}s", name, msg, flush=True)
    print("failures:", bad, "of", len(names) or len(qs))
