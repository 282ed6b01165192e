"""Run registered queries in Spark and DuckDB and compare them as multisets of rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (date, datetime)):
        return str(value)
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    frame = query(spark, sf_dir)
    mine = frame.collect()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(columns)}"
    a, b = rows_of(frame.columns, mine), rows_of(columns, theirs)
    if a != b:
        only_a, only_b = str(list((a - b).items())[:2])[:1500], str(list((b - a).items())[:2])[:1500]
        return False, f"rows {len(mine)} vs {len(theirs)}\n   spark {only_a}\n   duck  {only_b}"
    return True, f"{len(mine)} rows"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from dqwatch.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), oracle_sql(), []
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, query, oracles[name], sf_dir)
            else:
                ok, note = True, f"{len(query(spark, sf_dir).collect())} rows, no oracle"
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:30s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
