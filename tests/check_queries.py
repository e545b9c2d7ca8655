"""Runs registered queries against their SQL twins: ``python tests/check_queries.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from reportloom.plans.views import BASE  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t)
    )


def connect(folder):
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def differences(spark, folder, name, connection):
    """Empty text when the two results agree."""
    df = contract.queries()[name](spark, str(folder))
    got = table(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "" if got[1] else "no rows"
    result = connection.execute(sql)
    want = table([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        more = [r for r in got[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} != {len(want[1])}: {more}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}"
    return "" if got[1] else "no rows"


if __name__ == "__main__":
    from reportloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in sys.argv[2:] or contract.queries():
        start = time.time()
        try:
            problem = differences(spark, folder, name, connection)
        except Exception as error:  # a broken query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
