"""Run queries and their SQL side by side: ``python -m checks.compare SF_DIR [name ...]``."""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from eventscope.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _sorted(rows):
    return sorted((tuple(map(_plain, row)) for row in rows), key=repr)


def rows_of_query(spark, sf_dir: str, name: str):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    return columns, _sorted(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))


def rows_of_sql(db, name: str):
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), _sorted([tuple(row[i] for i in order) for row in result.fetchall()])


def difference(spark, db, sf_dir: str, name: str) -> str:
    """Empty if the query and its SQL agree."""
    columns, got = rows_of_query(spark, sf_dir, name)
    expected_columns, expected = rows_of_sql(db, name)
    if columns != expected_columns:
        return f"columns {columns} / {expected_columns}"
    if len(got) != len(expected):
        return f"{len(got)} / {len(expected)} rows"
    for mine, theirs in zip(got, expected):
        if mine != theirs or [type(x) for x in mine] != [type(x) for x in theirs]:
            return f"{mine} / {theirs}"
    return ""


def main(sf_dir: str, *names: str) -> int:
    spark = local_session(int(os.environ.get("COMPARE_CPUS", "8")), **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, wrong = connect(sf_dir), 0
    for name in names or QUERIES:
        started = time.time()
        if name not in ORACLE:
            columns, rows = rows_of_query(spark, sf_dir, name)
            print(f"rows  {name}: {len(rows)}, {time.time() - started:.2f}s", flush=True)
            continue
        found = difference(spark, db, sf_dir, name)
        wrong += bool(found)
        print(f"{'DIFF' if found else 'same'}  {name}: {found} {time.time() - started:.2f}s", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
