"""Runs a query and its oracle SQL side by side. Used by the tests and as a script."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, run, sql):
    """None when equal, else a short description of the difference."""
    df = run(spark, folder)
    got = rows_of(df.columns, df.collect())
    names, rows = oracle_rows(con, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    want = rows_of(names, rows)
    if got == want and got:
        return None
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return f"rows {len(got)} vs {len(want)}; spark {sorted(only_got)[:2]}; oracle {sorted(only_want)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from mektup.session import local_session

    folder = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    spark, con = local_session(8), connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    sql = entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            if name in sql:
                result = compare(spark, con, folder, entry.queries()[name], sql[name])
                outcome = "ok" if result is None else "DIFF " + result[:1200]
            else:
                df = entry.queries()[name](spark, folder)
                outcome = f"no oracle, {len(df.collect())} rows {df.columns}"
        except Exception as error:  # report and go on with the next query
            outcome = "FAIL " + str(error)[:1500]
        print(f"{name:24s} {time.time() - start:6.1f}s {outcome}", flush=True)
