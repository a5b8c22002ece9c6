"""Run registered queries against the checking engine and compare whole results."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry_module  # noqa: E402
from siftgraph.plans.fixtures import BASE_TABLES  # noqa: E402
from siftgraph.session import build_session  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    cols = sorted(df.columns)
    got = normal([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
    t1 = time.time()
    if sql is None:
        return ("ROWS", len(got), t1 - t0, 0.0, "")
    res = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql}) q")
    want = normal([tuple(r) for r in res.fetchall()])
    t2 = time.time()
    same = len(got) == len(want) and all(
        all(a == b or (a != a and b != b) for a, b in zip(x, y)) for x, y in zip(got, want)
    )
    note = ""
    if not same:
        diff = [(x, y) for x, y in zip(got, want) if x != y][:2]
        note = f"{len(got)} vs {len(want)} {cols} {str(diff)[:700]}"
    return ("OK" if same else "DIFF", len(got), t1 - t0, t2 - t1, note)


if __name__ == "__main__":
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = (
        SparkSession.builder.master("local[8]").getOrCreate()
        if os.environ.get("PLAIN_SESSION")
        else build_session(master="local[8]")
    )
    con = connect(folder)
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, n, a, b, note = compare(spark, con, folder, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            status, n, a, b = "FAIL", 0, 0, 0
            note = "".join(traceback.format_exception_only(e))[:900]
        bad += status in ("DIFF", "FAIL")
        print(f"{status:5} {name:34} rows={n:<7} spark={a:5.1f}s sql={b:5.1f}s {note}", flush=True)
    print("bad:", bad)
