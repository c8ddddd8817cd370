"""Runs every query beside its SQL and reports differences: `python -m checks.compare_sql DIR [names]`."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import all_sql
from checks.queries import all_queries
from lexigauge.session import build_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else v + 0.0
            cells.append(v)
        out.append(tuple(cells))
    return [names[i] for i in order], sorted(out, key=_key)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """None if the query and its SQL agree in columns, rows and values."""
    df = all_queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(all_sql()[name])
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(got[0], a, b) if x != y]
        return f"{len(bad)} rows differ, first: {a[:2]} {cells[:4]}"
    return None


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names or all_queries():
        started = time.time()
        if name not in all_sql():
            print("no sql", name, flush=True)
            continue
        try:
            found = difference(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:500]}"
        print("ok" if found is None else "DIFF", name, round(time.time() - started, 2), found or "", flush=True)


if __name__ == "__main__":
    main()
