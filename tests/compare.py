"""Run registered queries against their DuckDB oracle: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import threading
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(table) -> tuple[dict, list]:
    """Arrow table -> (column types, sorted rows), columns by name."""
    import math

    names = sorted(table.column_names)

    def clean(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(clean(x) for x in v)
        if isinstance(v, dict):
            return tuple(clean(x) for x in v.values())
        return v

    cols = [[clean(v) for v in table.column(n).to_pylist()] for n in names]
    rows = sorted(zip(*cols), key=lambda row: tuple((x is not None, str(type(x)), x if x is not None else 0)
                                                    if not isinstance(x, tuple) else (True, "t", str(x)) for x in row))
    return {n: str(table.schema.field(n).type) for n in names}, rows


def check(spark, con, sf_dir, name, fn, sql) -> str:
    df = fn(spark, sf_dir)
    t0 = time.time()
    got = df.toArrow()
    print(f"[{time.time() - t0:5.1f}s] ", end="")
    if sql is None:
        return f"rows-only {got.num_rows}"
    guard = threading.Timer(60, con.interrupt)  # a bad oracle plan must not stall the run
    guard.start()
    try:
        want = con.sql(sql).to_arrow_table()
    finally:
        guard.cancel()
    (gt, gr), (wt, wr) = normal(got), normal(want)
    if sorted(gt) != sorted(wt):
        return f"FAIL columns {sorted(set(gt) ^ set(wt))}"
    norm = lambda t: t.replace("large_", "").replace("_view", "")
    types = {n: (gt[n], wt[n]) for n in gt if norm(gt[n]) != norm(wt[n])}
    if len(gr) != len(wr):
        return f"FAIL rows {len(gr)} != {len(wr)} types={types}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return f"FAIL values {len(bad)}/{len(gr)} cols={sorted(gt)} first={bad[0]} types={types}"
    return f"ok rows={len(gr)}" + (f" TYPES {types}" if types else "") + (" EMPTY" if not gr else "")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    from tickloom.session import local_session
    import __spark_entry__ as entry

    spark = local_session(8)
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            res = check(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            res = "ERROR " + str(e)[:700].replace("\n", " | ")
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += res.startswith(("FAIL", "ERROR"))
        print(f"{name:34s} {time.time() - t:6.1f}s {res[:1200]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
