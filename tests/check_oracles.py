"""Compare every registered query with its SQL: ``python tests/check_oracles.py [sf_dir] [name …]``."""

from __future__ import annotations

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def rows_of(names: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, folder, name, run, sql) -> tuple[bool, str]:
    started = time.time()
    frame = run(spark, folder)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - started
    if sql is None:
        return True, f"{took:6.2f}s {len(mine[1])} rows, no oracle"
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine == theirs:
        return True, f"{took:6.2f}s {len(mine[1])} rows"
    detail = f"columns {mine[0]} vs {theirs[0]}; rows {len(mine[1])} vs {len(theirs[1])}"
    extra = [r for r in mine[1] if r not in set(theirs[1])][:2]
    lacking = [r for r in theirs[1] if r not in set(mine[1])][:2]
    return False, f"{detail}\n   only spark: {extra}\n   only sql:   {lacking}"


def main() -> int:
    from driftline.session import local_session

    entry = importlib.import_module("__spark_entry__")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, text = compare(spark, con, folder, name, run, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{type(error).__name__}: {str(error)[:500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name.ljust(28), text, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
