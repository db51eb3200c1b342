"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Mirrors the correctness gate: row count, column names and an
order-insensitive hash of the values.

    python tests/oracle_compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from revlens.sources.tables import TABLES, table_path  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.bool_, bool)):
        return bool(v)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.floating, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        r = round(f, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tzinfo else pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if v is pd.NaT:
        return None
    return v


def frame_digest(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    # integers with nulls come as floats from one engine and as nullable integers from the other
    pdf = pdf.astype({c: "float64" for c in cols if str(pdf[c].dtype) == "Int64"})
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(repr(tuple(_norm(x) for x in rec)))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h, rows


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    con.execute("SET TimeZone='UTC'")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True):
    from revlens.catalog import oracle_sql, queries
    qs, orc = queries(), oracle_sql()
    con = duck_connection(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and not any(name.startswith(p) for p in names):
            continue
        t0 = time.time()
        try:
            sp = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK-ERROR", str(e)[:300])
            if verbose:
                print(f"{name:40s} SPARK-ERROR {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if name not in orc:
            results[name] = ("NO-ORACLE", len(sp))
            if verbose:
                print(f"{name:40s} no-oracle rows={len(sp)} {ts:.1f}s")
            continue
        try:
            od = con.execute(orc[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = ("ORACLE-ERROR", str(e)[:300])
            if verbose:
                print(f"{name:40s} ORACLE-ERROR {str(e)[:300]}")
            continue
        sc, sn, sh, srows = frame_digest(sp)
        oc, on, oh, orows = frame_digest(od)
        ok = sc == oc and sn == on and sh == oh
        results[name] = ("OK" if ok else "MISMATCH", sn, on)
        if verbose:
            print(f"{name:40s} {'OK ' if ok else 'MISMATCH'} rows={sn}/{on} {ts:.1f}s")
            if not ok:
                if sc != oc:
                    print("   cols spark:", sc, "\n   cols duck: ", oc)
                else:
                    a, b = set(srows), set(orows)
                    for r in sorted(a - b)[:3]:
                        print("   spark-only:", r[:300])
                    for r in sorted(b - a)[:3]:
                        print("   duck-only: ", r[:300])
    return results


if __name__ == "__main__":
    from revlens.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session(f"local[{os.environ.get("BENCH_CPUS", "8")}]", 8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "NO-ORACLE")}
    print(f"\n{len(res)} queries, {len(bad)} not OK: {sorted(bad)}")
