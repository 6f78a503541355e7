"""Run registered queries next to their SQL oracles: ``python tests/compare.py SF_DIR [name …]``."""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from volpanel.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "NaN" if isinstance(v, float) and v != v else v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def check(spark, con, sf: str, name: str) -> tuple[str, float, float]:
    """(verdict, Spark seconds, DuckDB seconds)."""
    t = time.time()
    df = entry.queries()[name](spark, sf)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got[1])})", spent, 0.0
    t = time.time()
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    duck_spent = time.time() - t
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", spent, duck_spent
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}", spent, duck_spent
    bad = [(a, b) for a, b in zip(*(x[1] for x in (got, want))) if a != b]
    if bad:
        return f"VALUES {len(bad)} of {len(got[1])}: {got[0]} {bad[0][0]} != {bad[0][1]}", spent, duck_spent
    return "ok", spent, duck_spent


if __name__ == "__main__":
    session, sf_dir = local_session(), sys.argv[1]
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    failed = 0
    for key in sys.argv[2:] or entry.queries():
        try:
            verdict, a, b = check(session, connection, sf_dir, key)
        except Exception as ex:  # noqa: BLE001
            verdict, a, b = "ERROR " + str(ex)[:700].replace("\n", " "), 0.0, 0.0
        failed += verdict != "ok" and not verdict.startswith("rows only")
        print(f"{key:28s} {a:6.2f} {b:6.2f} {verdict[:900]}", flush=True)
    print("failed", failed)
