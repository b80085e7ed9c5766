"""Run registered queries beside their SQL twins and compare whole results.

``python -m tests.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(v))
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return v.isoformat(" ") if isinstance(v, datetime) else str(v)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(con: duckdb.DuckDBPyConnection, df, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    want, got = bag(names, cur.fetchall()), bag(df.columns, df.collect())
    if want == got:
        return ""
    only_got, only_want = got - want, want - got
    return (f"rows {sum(got.values())} / {sum(want.values())}; "
            f"spark only {list(only_got)[:2]}; sql only {list(only_want)[:2]}")


def main() -> int:
    import __spark_entry__ as e
    from sluice.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = local_session(cpus=8), oracle_connection(sf_dir)
    sql, bad = e.oracle_sql(), 0
    for name, run in e.queries().items():
        if wanted and name not in wanted:
            continue
        begun = time.time()
        try:
            df = run(spark, sf_dir)
            diff = compare(con, df, sql[name]) if name in sql else f"(no SQL) {df.count()} rows"
        except Exception as ex:  # report and go on with the next query
            diff = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += bool(diff) and not diff.startswith("(no SQL)")
        print(f"{'ok  ' if not diff else 'FAIL'} {name} {time.time() - begun:.1f}s {diff[:900]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
