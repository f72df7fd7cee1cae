"""Run every registered query in Spark and its SQL in DuckDB, and compare the rows by value.

    python -m checks.compare [data folder] [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb

from checks.models import ORACLES
from stockloom.plans.catalog import QUERIES
from stockloom.session import build_session


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-"),
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "10g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = rows_of(df.columns, df.collect())
            spark_s = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:24} {len(got):8} rows {spark_s:6.1f}s", flush=True)
                continue
            start = time.time()
            res = con.execute(ORACLES[name])
            columns = [c[0] for c in res.description]
            want = rows_of(columns, res.fetchall())
            same = sorted(columns) == sorted(df.columns) and got == want
            print(f"{'ok   ' if same else 'DIFF '} {name:24} {len(got):8} rows {spark_s:6.1f}s {time.time() - start:6.1f}s", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(df.columns), sorted(columns) if sorted(df.columns) != sorted(columns) else "")
                pairs = [(g, w) for g, w in zip(got, want) if g != w]
                print("   rows", len(got), len(want), "differing", len(pairs))
                for g, w in pairs[:2]:
                    print("   spark ", [a for a, b in zip(g, w) if a != b][:6])
                    print("   duckdb", [b for a, b in zip(g, w) if a != b][:6])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name:24} {type(e).__name__}: {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
