"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_cell(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, name, fn, oracle, sf_dir):
    """(ok, message)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    rel = con.execute(oracle)
    want_names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}"
    a, b = rows_of(got, df.columns), rows_of(want, want_names)
    types = {n: f.dataType.simpleString() for n, f in zip(df.columns, df.schema.fields)}
    if len(a) != len(b):
        return False, f"{len(a)} rows, expected {len(b)}; {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(df.columns)}: {bad[0][0]} expected {bad[0][1]}"
    return True, f"{len(a)} rows, {took:.1f}s {types}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from dnslens.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    fns, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in fns.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            if name in oracles:
                ok, msg = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                start = time.time()
                n = len(fn(spark, sf_dir).collect())
                ok, msg = True, f"{n} rows (no check SQL), {time.time() - start:.1f}s"
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failed:", failed)
