"""Run every registered query against its SQL and compare rows; used by the tests and by hand."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tablelore.workload.inputs import TABLES


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if got[1] != want[1]:
        extra, lacking = sorted(set(got[1]) - set(want[1]))[:2], sorted(set(want[1]) - set(got[1]))[:2]
        return f"{len(got[1])} rows against {len(want[1])}; only here {extra}; only there {lacking}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tablelore.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    sf, only = sys.argv[1], sys.argv[2:]
    con = duck(sf)
    for name, q in entry.queries().items():
        if only and name not in only:
            continue
        sql = entry.oracle_sql().get(name)
        t = time.time()
        if sql is None:
            print(name, "rows only", q(spark, sf).count(), round(time.time() - t, 1), flush=True)
            continue
        try:
            bad = compare(spark, con, sf, name, q, sql)
        except Exception as e:  # noqa: BLE001
            bad = "ERROR " + str(e)[:500].replace("\n", " ")
        print(name, "ok" if bad is None else f"MISMATCH {bad[:700]}", round(time.time() - t, 1), flush=True)
