"""Run registered queries against their DuckDB twins: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {table} as select * from '{path}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(con, spark, sf_dir: str, query, note=lambda n: None) -> str | None:
    """None if equal, else what differs. ``note`` is told the number of rows."""
    df = query.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    note(len(got))
    if query.oracle is None:
        return None if got else "no rows"
    cursor = con.execute(query.oracle)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not same(g, w)]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def same(a, b) -> bool:
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, (int, float)):
            if abs(x - y) > 2e-5 * max(1.0, abs(x)):
                return False
        elif x != y:
            return False
    return True


def main(argv):
    from orderweave.plans.catalog import load_all
    from tests.conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = make_session()
    con = connect(sf_dir)
    failed = 0
    for name, query in load_all().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        size = []
        try:
            problem = compare(con, spark, sf_dir, query, size.append)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        n = "" if query.oracle else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{n} {size} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
