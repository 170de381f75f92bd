"""Run registered queries beside their SQL and compare the rows exactly.

    python -m tests.compare /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from __spark_entry__ import oracle_sql, queries
from panelcast.session import build_session

REGISTRY, SQL = queries(), oracle_sql()
TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value)


def difference(spark, con, sf: str, key: str, empty: bool = False) -> tuple[str | None, int, float]:
    """What differs (None if nothing), the row count and the seconds Spark took.

    `empty` allows a result without rows, as small tables may give.
    """
    began = time.time()
    df = REGISTRY[key](spark, sf)
    columns = sorted(df.columns)
    mine = [tuple(plain(v) for v in row) for row in df.select(columns).collect()]
    took = time.time() - began
    if key not in SQL:
        return (None if mine else "no rows"), len(mine), took
    result = con.execute(SQL[key])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}", len(mine), took
    place = [names.index(c) for c in columns]
    other = [tuple(plain(row[i]) for i in place) for row in result.fetchall()]
    if not other and not empty:
        return "the SQL gives no rows", 0, took
    a, b = Counter(mine), Counter(other)
    if a != b:
        only_a, only_b = sorted((a - b).elements())[:3], sorted((b - a).elements())[:3]
        text = f"{len(mine)} against {len(other)} rows, {(a - b).total()} differ\n   {columns}\n   spark {only_a}\n   sql   {only_b}"
        return text, len(mine), took
    return None, len(mine), took


def main() -> int:
    sf, keys = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark, con = build_session("local[8]"), connect(sf)
    wrong = 0
    for key in keys:
        try:
            problem, rows, took = difference(spark, con, sf, key)
        except Exception as error:  # report and go on with the next query
            problem, rows, took = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0
        wrong += problem is not None
        kind = "sql" if key in SQL else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {key:28s} {kind:4s} {rows:8d} {took:6.2f}s {problem or ''}", flush=True)
    print(f"{wrong} of {len(keys)} wrong")
    spark.stop()
    return wrong


if __name__ == "__main__":
    raise SystemExit(main())
