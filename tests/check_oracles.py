"""Compare registered queries with their DuckDB twins (same normalisation on both sides).

    python tests/check_oracles.py [sf] [name ...]
"""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from registry.views import TABLES  # noqa: E402


def rows_of(pdf):
    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        if hasattr(v, "tolist"):
            return str(v.tolist())
        return str(v)
    return cols, sorted(tuple(cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from refaudit.session import build_session
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", spark_ui_enabled="false", spark_sql_shuffle_partitions="8", spark_driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = connect(sf_dir), queries(), oracle_sql()
    names = argv[1:] or list(qs)
    bad = []
    for name in names:
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            got = rows_of(df.toPandas())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time() - t
        if name not in sql:
            print(f"rows {name}: {len(got[1])} rows {t1:.1f}s (no oracle)", flush=True)
            continue
        t = time.time()
        try:
            want = rows_of(con.sql(sql[name]).df())
        except Exception as e:  # noqa: BLE001
            print(f"SQLERR {name}: {str(e)[:800]}", flush=True)
            bad.append(name)
            continue
        ok = got == want
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got[1])}/{len(want[1])} rows spark {t1:.1f}s duck {time.time() - t:.1f}s", flush=True)
        if not ok:
            bad.append(name)
            print("   cols", got[0], want[0])
            g, w = set(got[1]), set(want[1])
            print("   only spark", sorted(g - w)[:3])
            print("   only duck ", sorted(w - g)[:3], flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
