"""Run queries in Spark and in DuckDB and compare them as multisets of rows.

    python -m checks.compare [sf folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (float, Decimal)):
        return ("f", round(float(value), 6))
    if isinstance(value, (datetime, date)):
        return ("t", str(value))
    return ("s", str(value))


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_kind(row[i]) for i in order) for row in rows)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, connection, name: str, make, oracle: str | None, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = make(spark, sf_dir)
    got = df.collect()
    if oracle is None:
        return None
    cursor = connection.execute(oracle)
    described = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(described):
        return f"columns {sorted(df.columns)} / {sorted(described)}"
    types = {c: SPARK_TYPES.get(t, t) for c, t in df.dtypes}
    wrong = {c: (types[c], described[c]) for c in types if types[c] != described[c]}
    if wrong:
        return f"types {wrong}"
    left, right = rows_of(df.columns, got), rows_of(list(described), expected)
    if left != right:
        return (
            f"rows {len(got)} / {len(expected)}; only Spark {list((left - right).items())[:3]};"
            f" only SQL {list((right - left).items())[:3]}"
        )
    return None if expected else "empty"


def main() -> int:
    from checks.catalog import ORACLE, QUERIES
    from tallyforge.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("compare", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, connection, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {time.time() - started:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
