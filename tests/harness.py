"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from chronica import session


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in session.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if hasattr(value, "item"):
        return canon(value.item())
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v).__name__), str(v)) for v in r))


def kinds(rows, width):
    found = [set() for _ in range(width)]
    for row in rows[:5000]:
        for i, v in enumerate(row):
            if v is not None:
                found[i].add(type(v).__name__)
    return found


def compare(spark, con, sf_dir, name, fn, sql) -> str | None:
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:2]} {b[:2]}"
    order = sorted(df.columns)
    ka, kb = kinds(a, len(order)), kinds(b, len(order))
    bad = [(c, x, y) for c, x, y in zip(order, ka, kb) if x and y and x != y]
    if bad:
        return f"types {bad}"
    for x, y in zip(a, b):
        if x != y:
            diff = [(c, u, v) for c, u, v in zip(order, x, y) if u != v]
            count = sum(u != v for u, v in zip(a, b))
            return f"{count} of {len(a)} rows differ, e.g. {diff[:4]} in {x}"
    return None if a else "EMPTY"


def main(pattern: str = "", sf: str = "0.001"):
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sf}"
    spark = session.build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    con = connect(sf_dir)
    twins = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if pattern and not any(p in name for p in pattern.split(",")):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, twins.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        took = time.time() - start
        mark = "ok" if problem is None else "FAIL"
        failed += problem is not None
        print(f"{mark:4} {took:6.2f}s {name}{'' if name in twins else ' (rows only)'}{': ' + problem if problem else ''}", flush=True)
    print("failed", failed)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
