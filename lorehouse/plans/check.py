"""Side-by-side run of the registered queries and their SQL (development aid)."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value) if not isinstance(value, (bool, type(None))) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([_plain(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def compare(spark, con, folder, name, query, sql):
    start = time.time()
    frame = query(spark, folder)
    left, left_columns = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - start
    if sql is None:
        return f"rows {len(left):>8}  {spent:6.1f}s  {name} (no SQL)", True
    start = time.time()
    cursor = con.execute(sql)
    right_columns = [c[0] for c in cursor.description]
    right, right_columns = rows_of(right_columns, cursor.fetchall())
    sql_spent = time.time() - start
    same = left == right and left_columns == right_columns
    line = f"{'same' if same else 'DIFF'} {len(left):>8}  {spent:6.1f}s {sql_spent:6.1f}s  {name}"
    if not same:
        ours, theirs = set(left) - set(right), set(right) - set(left)
        line += f"\n   columns {left_columns} / {right_columns}; rows {len(left)} / {len(right)}"
        line += "".join(f"\n   spark {r[:300]}" for r in sorted(ours)[:3])
        line += "".join(f"\n   sql   {r[:300]}" for r in sorted(theirs)[:3])
    return line, same


def main(folder: str, names: list[str]) -> int:
    from lorehouse.plans.catalog import oracle_sql, queries
    from lorehouse.session import build_session

    spark = build_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    sqls = oracle_sql()
    for name, query in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            line, same = compare(spark, con, folder, name, query, sqls.get(name))
        except Exception as error:  # report and go on
            line, same = f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", False
        print(line, flush=True)
        if not same:
            failed.append(name)
    print("not matching:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
