"""Compare queries with their SQL on one scale: python tools/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float) and math.isnan(v):
        return (1, "nan")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, (int, float)):
        return (3, repr(float(v) + 0.0))
    return (4, str(v))


def table_of(frame_columns, rows):
    order = sorted(range(len(frame_columns)), key=lambda i: frame_columns[i])
    names = [frame_columns[i] for i in order]
    return names, sorted([tuple(_key(r[i]) for i in order) for r in rows])


def compare(spark_df, con, sql):
    got = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want = table_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns differ: {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows differ: {len(got[1])} vs {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(n, x[1], y[1]) for n, x, y in zip(got[0], a, b) if x != y]
        return f"{len(bad)} rows differ, first: {cells[:4]}"
    return None


def main():
    from kinelake.queries import ORACLES, QUERIES
    from kinelake.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    names = args or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                status = "ok" if problem is None else f"FAIL {problem}"
                failed += problem is not None
            else:
                status = f"rows only: {df.count()}"
        except Exception as exc:  # report and go on
            status = f"ERROR {(str(exc)[:500] + str(exc)[-700:])}"
            failed += 1
        print(f"{name:28s} {time.time() - t:6.1f}s {status}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
