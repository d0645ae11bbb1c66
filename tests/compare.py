"""Run registered queries and their oracles side by side.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, int):
        return value
    return float(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(frame):
    return table(frame.columns, [tuple(row) for row in frame.collect()])


def oracle_rows(connection, sql):
    result = connection.execute(sql)
    return table([d[0] for d in result.description], result.fetchall())


def differences(frame, connection, sql, limit=3):
    names, rows = spark_rows(frame)
    wanted_names, wanted = oracle_rows(connection, sql)
    if names != wanted_names:
        return len(rows), f"columns {names} and {wanted_names}"
    if rows != wanted:
        seen, expected = set(map(repr, rows)), set(map(repr, wanted))
        return len(rows), (
            f"{len(rows)} and {len(wanted)} rows; only Spark: {sorted(seen - expected)[:limit]}; "
            f"only oracle: {sorted(expected - seen)[:limit]}"
        )
    return len(rows), None


def main(argv):
    from millrace.catalog import ORACLES, QUERIES
    from millrace.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    connection = connect(sf_dir)
    failed = []
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                count, problem = differences(QUERIES[name](spark, sf_dir), connection, ORACLES[name])
            else:
                count, problem = len(QUERIES[name](spark, sf_dir).collect()), None
        except Exception as error:  # noqa: BLE001
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok  " if problem is None else "FAIL"
        kind = "sql " if name in ORACLES else "rows"
        print(f"{mark} {kind} {name} rows={count} {time.time() - start:.1f}s {problem or ''}"[:2500], flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
