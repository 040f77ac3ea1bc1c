"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle_check.py sf [names]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} vs {len(want)} rows; only here {sorted(a - b)[:2]}, only in SQL {sorted(b - a)[:2]}"
    return None if got else "no rows"


def main():
    from __spark_entry__ import oracle_sql, queries
    from tests.session import session
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, con, bad = session(), connect(sf_dir), 0
    oracles = oracle_sql()
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        if name not in oracles:
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, query, oracles[name], sf_dir)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'BAD '} {name} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("missing oracles:", sorted(set(queries()) - set(oracles)),
          "missing queries:", sorted(set(oracles) - set(queries())), "bad:", bad)


if __name__ == "__main__":
    main()
