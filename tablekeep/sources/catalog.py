"""Catalogs of databases and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Schemas a server lists that hold no user data.
SYSTEM_DATABASES = ["information_schema", "performance_schema", "lost+found"]


def catalog_databases(src: DataFrame, kind: str = "mysql") -> DataFrame:
    """Databases worth dumping, as ``DF(name)``.

    ``kind='mysql'`` drops the system schemas; ``kind='pg'`` drops templates and databases
    that take no connections, from the columns ``is_template`` and ``allow_conn``.
    """
    if kind == "mysql":
        return src.where(~F.col("name").isin(SYSTEM_DATABASES)).select("name")
    if kind == "pg":
        return src.where(~F.col("is_template") & F.col("allow_conn")).select("name")
    raise ValueError(f"unknown catalog kind {kind!r}")


def catalog_tables(src: DataFrame, sizes: bool = True) -> DataFrame:
    """Tables with metadata, as ``DF(database, name, data_size, index_size, engine)``.

    An unknown size is 0 and a table without an engine is a view. ``sizes=False`` is the
    cheap listing: the size columns are not read at all.
    """

    def size(column: str):
        return F.coalesce(F.col(column), F.lit(0)).cast("bigint") if sizes else F.lit(0).cast("bigint")

    return src.select(
        "database",
        "name",
        size("data_length").alias("data_size"),
        size("index_length").alias("index_size"),
        F.lower(F.coalesce("engine", F.lit("view"))).alias("engine"),
    )
