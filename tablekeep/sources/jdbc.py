"""Parallel reading of a database table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    part_col: str,
    lo: int,
    hi: int,
    n: int = 4,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read ``table`` in ``n`` ranges of ``part_col``.

    ``lo`` and ``hi`` only place the range borders: rows outside them, and rows with a NULL
    in ``part_col``, are read too. Filters and column lists are pushed to the database.
    """
    return (
        spark.read.format("jdbc")
        .options(**(options or {}))
        .options(
            url=url,
            dbtable=table,
            partitionColumn=part_col,
            lowerBound=str(lo),
            upperBound=str(hi),
            numPartitions=str(n),
        )
        .load()
    )
