"""Compare catalogue queries with their SQL twins: ``python tests/compare.py [name part] [sf] [group rows]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def kinds(row_types):
    return row_types


def compare(df, con, sql) -> str:
    """Empty text when both give the same rows, else what differs."""
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_cols, want = canonical(names, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}; e.g. {got[:1]} / {want[:1]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y or type(x) is not type(y)]
            n = sum(x != y for x, y in zip(got, want))
            return f"{n} of {len(got)} rows differ, first {diff[:4]} in {a}"
    return ""


if __name__ == "__main__":
    from tickloom.plans.catalog import catalog
    from tickloom.session import local_session

    part = sys.argv[1] if len(sys.argv) > 1 else ""
    sf = sys.argv[2] if len(sys.argv) > 2 else "sf0.01"
    rows = sys.argv[3] if len(sys.argv) > 3 else ""
    spark = local_session(8)
    if rows:
        spark.conf.set("tickloom.groupRows", rows)
    folder = f"/root/testdata/{sf}"
    con = duck(folder)
    bad = 0
    chosen = [q for n, q in catalog().items() if any(p in n or p == q.build.__module__.split(".")[-1] for p in part.split(","))]
    for q in chosen:
        start = time.time()
        try:
            df = q.run(spark, folder)
            if q.sql is None:
                note = f"rows only: {df.count()}"
            else:
                note = compare(df, con, q.oracle())
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        ok = note == "" or note.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {time.time() - start:6.2f}s {q.name} {note}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} ok")
