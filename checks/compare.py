"""Run the queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import oracles
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablekeep")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return repr(value)


def _bag(columns: list[str], rows) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in at) for row in rows)


# SQL types and the Spark types that hold the same values.
SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def _type_difference(df: DataFrame, relation: duckdb.DuckDBPyRelation) -> str | None:
    mine = dict(df.dtypes)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    apart = [f"{c}: {mine[c]} against {theirs[c]}" for c in mine if SAME_TYPE.get(theirs[c]) != mine[c]]
    return "types " + ", ".join(apart) if apart else None


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What sets the two results apart, None when they are equal as bags of rows."""
    mine = _bag(df.columns, df.collect())
    relation = connection.sql(sql)
    theirs = _bag(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} against {sorted(relation.columns)}"
    if mine == theirs:
        return _type_difference(df, relation)
    only_mine, only_theirs = mine - theirs, theirs - mine
    samples = [str(list(bag)[:2])[:600] for bag in (only_mine, only_theirs)]
    return f"{sum(mine.values())} rows against {sum(theirs.values())}; only here {samples[0]}; only there {samples[1]}"


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, failures = duck(sf_dir), oracles(), 0
    for name in names or QUERIES:
        started = time.time()
        try:
            found = difference(QUERIES[name](spark, sf_dir), connection, sql[name])
        except Exception as error:  # report every query, not only the first that fails
            found = f"{type(error).__name__}: {str(error)[:700]}"
        failures += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - started:.1f}s {found or ''}", flush=True)
    print(f"{failures} failures; without SQL: {sorted(set(QUERIES) - set(sql))}")
    return failures


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
