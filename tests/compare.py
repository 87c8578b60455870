"""Run registered queries beside their check SQL and compare all rows.

``python -m tests.compare [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import decimal
import glob
import os
import sys
import time

import duckdb

TESTDATA = os.environ.get("VITRINE_TESTDATA", "/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    return repr(value) if isinstance(value, float) else str(value)


def lines(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty text when both sides give the same columns and rows, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names, wanted = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}"
    a, b = lines(df.columns, got), lines(names, wanted)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    from vitrine import catalog
    from vitrine.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"{TESTDATA}/sf{args.sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(folder), 0
    every, checks = catalog.queries(), catalog.oracles()
    wanted = [q for q in every if not args.names or any(q.startswith(n) for n in args.names)]
    for name in wanted:
        begun = time.time()
        try:
            df = every[name](spark, folder)
            verdict = compare(df, con, checks[name]) if name in checks else f"rows-only {df.count()}"
        except Exception as error:  # noqa: BLE001 - the report shows it
            causes = [line.strip() for line in str(error).splitlines() if "Caused by" in line or "Serialization stack" in line or line.startswith("\t- ")]
            verdict = f"ERROR {type(error).__name__} {str(error)[:300]} {causes[:8]}"
        ok = verdict == "" or verdict.startswith("rows-only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - begun:.2f}s {verdict}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} fine")
    return failed


if __name__ == "__main__":
    sys.exit(main())
