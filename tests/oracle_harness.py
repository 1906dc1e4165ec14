"""Spark query vs DuckDB oracle: same column names, same row multiset.

Usable from pytest and from the command line:
    python tests/oracle_harness.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits is not None and math.isfinite(v):
            return float(f"{v:.{digits}g}")
        return v
    return v


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(spark, con, sf_dir: str, name: str, fn, sql: str, digits=None) -> tuple[bool, str]:
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_types = dict(sdf.dtypes)
    rel = con.sql(sql)
    d_types = {c: DUCK_TO_SPARK.get(str(ty), str(ty)) for c, ty in zip(rel.columns, rel.types)}
    if s_types != d_types:
        return False, f"types differ: spark={s_types} duck={d_types}"
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(_norm(v, digits) for v in r) for r in s_rows), key=key)
    b = sorted((tuple(_norm(v, digits) for v in r) for r in d_rows), key=key)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return False, f"first diff spark={x} duck={y}"
    return True, f"{len(s_rows)} rows, {ts:.2f}s"


def main(argv):
    from lithos.session import local_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = local_session(8, 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            print(f"NOSQL {name}")
            continue
        try:
            ok, msg = compare(spark, con, sf_dir, name, fn, sqls[name])
            if not ok:
                ok2, _ = compare(spark, con, sf_dir, name, fn, sqls[name], digits=12)
                msg += " (equal to 12 digits)" if ok2 else ""
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name:24s} {msg}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
