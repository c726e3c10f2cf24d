"""Run registered queries next to their SQL twins and compare the rows.

usage: python tests/compare.py <folder> [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}") + 0.0
    if hasattr(value, "item") and not hasattr(value, "tolist"):
        return plain(value.item())
    if hasattr(value, "tolist"):
        value = value.tolist()
        if not isinstance(value, list):
            return plain(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ in ("Timestamp", "datetime"):
        return str(value)
    return value


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(spark, con, name, job, sql, folder):
    start = time.time()
    frame = job(spark, folder)
    got = [tuple(r) for r in frame.collect()]
    spent = time.time() - start
    mine, my_cols = rows(got, frame.columns)
    if sql is None:
        return True, f"rows={len(mine)} (no twin)", spent
    start = time.time()
    cursor = con.execute(sql)
    cols = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    theirs, their_cols = rows(cursor.fetchall(), cols)
    note = f"rows={len(mine)}/{len(theirs)} sql={time.time() - start:.1f}s"
    wide = [f"{c}:{ty}" for c, ty in zip(cols, types) if "HUGEINT" in ty or "DECIMAL" in ty]
    if wide:
        note += f" WIDE {wide}"
    if my_cols != their_cols:
        return False, note + f" columns {my_cols} vs {their_cols}", spent
    if mine == theirs:
        return True, note, spent
    a, b = set(mine), set(theirs)
    left, right = sorted(a - b, key=repr)[:2], sorted(b - a, key=repr)[:2]
    return False, note + f"\n   cols {my_cols}\n   only spark ({len(a - b)}): {str(left)[:1500]}\n   only sql ({len(b - a)}): {str(right)[:1500]}", spent


def main():
    import __spark_entry__ as entry
    from sagewell.session import local_session

    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duck(folder)
    sqls = entry.oracle_sql()
    bad = []
    for name, job in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note, spent = compare(spark, con, name, job, sqls.get(name), folder)
        except Exception as error:  # report and go on with the next query
            ok, note, spent = False, f"{type(error).__name__}: {str(error)[:900]}", math.nan
        print(f"{'ok  ' if ok else 'FAIL'} {name} {spent:.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
