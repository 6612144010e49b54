"""Compare registered queries with their SQL: python tests/check_queries.py [--sf sf0.01] [prefix ...]"""

from __future__ import annotations

import argparse
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from emberfold.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(float(value))
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    directory = f"/root/testdata/{args.sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    queries, statements = entry.queries(), entry.oracle_sql()
    failed = []
    for name, run in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            began = time.time()
            df = run(spark, directory)
            got = df.collect()
            spark_s = time.time() - began
            if name not in statements:
                print(f"ROWS  {name} {len(got)} {spark_s:.1f}s")
                continue
            began = time.time()
            cursor = database.execute(statements[name])
            names = [c[0] for c in cursor.description]
            expected = cursor.fetchall()
            sql_s = time.time() - began
            left, right = rows_of(df.columns, got), rows_of(names, expected)
            same = sorted(df.columns) == sorted(names) and left == right
            print(f"{'ok   ' if same else 'DIFF '} {name} {len(got)} {len(expected)} spark {spark_s:.1f}s sql {sql_s:.1f}s",
                  flush=True)
            if not same:
                failed.append(name)
                print("   columns", sorted(df.columns), sorted(names))
                extra = [r for r in left if r not in set(right)][:2]
                lost = [r for r in right if r not in set(left)][:2]
                print("   only spark", [tuple(x[:200] for x in r) for r in extra])
                print("   only sql  ", [tuple(x[:200] for x in r) for r in lost])
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL  {name} {str(error)[:700]}", flush=True)
    missing = [n for n in statements if n not in queries]
    print("failed:", failed, "sql without query:", missing)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
