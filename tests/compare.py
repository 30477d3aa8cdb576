"""Runs registered queries against their SQL statement in DuckDB.

    python tests/compare.py <sf_dir> [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else round(v, 9)
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows only, {len(got)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = dict(zip(cols, [str(d[1]) for d in cur.description]))
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(cols)}"
    spark_types = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    bad = {c: (spark_types[c], types[c]) for c in cols
           if pairs.get(spark_types[c], spark_types[c]).lower() not in types[c].lower()}
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    ok = a == b and not bad
    msg = f"{name}: {len(got)}/{len(want)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if bad:
        msg += f" TYPES {bad}"
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        msg += (f"\n  differ {sum((a - b).values())}/{sum((b - a).values())}"
                f"\n  cols  {sorted(cols)}\n  spark {only_a}\n  duck  {only_b}")
    return ok, msg


if __name__ == "__main__":
    import __spark_entry__ as E
    from slicewise.session import build_session

    sf = sys.argv[1]
    spark = build_session("local[8]", 8, spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, os_ = E.queries(), E.oracle_sql()
    names = sys.argv[2:] or list(qs)
    failed = []
    for n in names:
        try:
            ok, msg = compare(spark, con, n, sf, qs[n], os_.get(n))
        except Exception as exc:                                    # noqa: BLE001
            ok, msg = False, f"{n}: {type(exc).__name__} {str(exc)[:1500]}"
        print(("ok   " if ok else "FAIL ") + msg, flush=True)
        if not ok:
            failed.append(n)
    print("failed:", failed)
