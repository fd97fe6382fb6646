"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

    python tools/check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spendlens.plans import ORACLE, QUERIES  # noqa: E402
from spendlens.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _value(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_value(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_df, con, sql: str) -> str:
    cursor = con.execute(sql)
    wanted_columns = [d[0] for d in cursor.description]
    wanted = rows_of(wanted_columns, cursor.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got[0] != wanted[0]:
        return f"columns differ: {got[0]} {wanted[0]}"
    if len(got[1]) != len(wanted[1]):
        return f"rows differ: {len(got[1])} {len(wanted[1])}"
    wrong = [(g, w) for g, w in zip(got[1], wanted[1]) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else f"ok {len(got[1])} rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--plain", action="store_true", help="a session without the library's settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                              spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(args.sf), 0
    names = [n for n in QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            outcome = compare(df, con, ORACLE[name]) if name in ORACLE else f"ok {df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            outcome = f"error {type(error).__name__}: {str(error)[:700]}"
        bad += not outcome.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.1f}s {outcome}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
