"""Sizes, estimates and locking by engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.functions.sizes import parse_size

# Engines safe under one transaction, engines whose rows live in other
# tables, and the option each locking method stands for.
TRANSACTIONAL_ENGINES = ["innodb", "federated", "myisam_mrg", "memory", "view", "blackhole"]
BORROWED_ENGINES = ["mrg_myisam", "federated"]
LOCK_OPTIONS = {
    "flush-lock": "--lock-all-tables",
    "lock-tables": "--lock-tables",
    "single-transaction": "--single-transaction",
    "none": "--skip-lock-tables",
}
PAGE_BYTES = 8192


def table_size() -> Column:
    return F.col("data_size") + F.col("index_size")


def is_transactional() -> Column:
    return F.col("engine").isin(TRANSACTIONAL_ENGINES)


def database_sizes(dbs: DataFrame, tbls: DataFrame) -> DataFrame:
    """Bytes per database over its kept tables, as ``DF(database, size)``.

    Tables whose rows belong to other tables are left out; an excluded or empty database
    counts 0. Tables are summed before the join, so the join sees one row per database.
    """
    counted = tbls.where(~F.col("excluded") & ~F.col("engine").isin(BORROWED_ENGINES))
    sums = counted.groupBy("database").agg(F.sum(table_size()).alias("_size"))
    return (
        dbs.select(F.col("name").alias("database"), "excluded")
        .join(sums, "database", "left")
        .select(
            "database",
            F.when(F.col("excluded"), F.lit(0)).otherwise(F.coalesce("_size", F.lit(0))).alias("size"),
        )
    )


def estimate(dbs: DataFrame, tbls: DataFrame, method: str = "plugin") -> DataFrame:
    """Bytes the dump will need, one row. ``method='const:1K'`` skips the catalog's sizes."""
    if method.startswith("const:"):
        fixed = parse_size(F.lit(method.removeprefix("const:").strip()))
        return dbs.sparkSession.range(1).select(
            F.coalesce(fixed, F.raise_error(F.lit(f"no size in {method!r}")).cast("bigint")).alias(
                "estimated_bytes"
            )
        )
    if method != "plugin":
        raise ValueError(f"unknown estimate method {method!r}")
    return database_sizes(dbs, tbls).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("estimated_bytes"))


def estimate_pages(df: DataFrame, pages: Column, page_bytes: int = PAGE_BYTES) -> DataFrame:
    return df.agg(F.coalesce(F.sum(pages * page_bytes), F.lit(0)).alias("estimated_bytes"))


def estimate_storage(df: DataFrame, storage: Column) -> DataFrame:
    """Twice the storage size: data may be stored compressed."""
    return df.agg((F.coalesce(F.sum(storage), F.lit(0)) * 2).alias("estimated_bytes"))


def lock_mode(dbs: DataFrame, tbls: DataFrame, method: str = "auto-detect") -> DataFrame:
    """The locking option for each kept database, as ``DF(database, lock_option)``."""
    kept = dbs.where(~F.col("excluded")).select(F.col("name").alias("database"))
    if method != "auto-detect":
        if method not in LOCK_OPTIONS:
            raise ValueError(f"unknown lock method {method!r}")
        return kept.withColumn("lock_option", F.lit(LOCK_OPTIONS[method]))
    safe = (
        tbls.where(~F.col("excluded"))
        .groupBy("database")
        .agg(F.bool_and(is_transactional()).alias("_safe"))
    )
    return kept.join(safe, "database", "left").select(
        "database",
        F.when(F.coalesce("_safe", F.lit(True)), LOCK_OPTIONS["single-transaction"])
        .otherwise(LOCK_OPTIONS["lock-tables"])
        .alias("lock_option"),
    )


def lock_mode_all(tbls: DataFrame, unrestricted: bool) -> DataFrame:
    """The one option for a dump of several databases at once, as ``DF(lock_option)``.

    A dump of everything, with no database left out, locks all tables.
    """
    safe = F.coalesce(F.bool_and(F.when(~F.col("excluded"), is_transactional())), F.lit(True))
    option = F.when(safe, LOCK_OPTIONS["single-transaction"]).otherwise(LOCK_OPTIONS["lock-tables"])
    return tbls.agg((F.lit(LOCK_OPTIONS["flush-lock"]) if unrestricted else option).alias("lock_option"))


def non_transactional(tbls: DataFrame) -> DataFrame:
    return tbls.where(~is_transactional()).select(
        F.concat_ws(".", "database", "name").alias("table"), "engine"
    )
