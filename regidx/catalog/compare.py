"""Compare catalogue queries with their check SQL: ``python -m regidx.catalog.compare DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, folder: str, run, sql: str | None):
    """``(rows, problem)``; the problem is None when both sides agree or there is no SQL."""
    frame = run(spark, folder)
    columns = frame.columns
    rows = [tuple(row) for row in frame.collect()]
    if sql is None:
        return len(rows), None
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = connection.execute(sql)
    names = [item[0] for item in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(columns):
        return len(rows), f"columns {sorted(columns)} against {sorted(names)}"
    left, right = normalised(columns, rows), normalised(names, expected)
    if left == right:
        return len(rows), None
    extra = [row for row in left if row not in set(right)][:2]
    absent = [row for row in right if row not in set(left)][:2]
    return len(rows), f"{len(left)} rows against {len(right)}; only here {extra}; only there {absent}"


def main(arguments: list[str]) -> int:
    from regidx.catalog import CATALOGUE
    from regidx.session import build_session

    folder, names = arguments[0], arguments[1:] or list(CATALOGUE)
    spark = build_session("compare", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in names:
        began = time.time()
        try:
            rows, problem = compare(spark, folder, *CATALOGUE[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        kind = "sql" if CATALOGUE[name][1] else "rows"
        print(f"{mark:4}{name:30}{kind:5}{rows:8}{time.time() - began:7.1f}s {(problem or '')[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
