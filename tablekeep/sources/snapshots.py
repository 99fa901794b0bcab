"""Snapshots of folders: the files of several tables, pinned before anything is read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablekeep.plans.formats import with_format

PINNED = "table string, path string, length bigint, modified timestamp"
#: So many changed files are named in an error.
NAMED_FILES = 5


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``DF(path, length, modified)`` of the files a scan of ``folder`` would read; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return listed.select("path", "length", F.col("modificationTime").alias("modified"))


def pin(spark: SparkSession, tables: Mapping[str, str], root: str) -> DataFrame:
    """Write the list of files of all tables, folder by name, to ``root``: ``DF(table, path, length, modified)``.

    Files that are added to the folders afterwards do not belong to the snapshot.
    """
    for name, folder in tables.items():
        _files(spark, folder).select(F.lit(name).alias("table"), "*").write.mode("append").parquet(f"{root}/files")
    spark.createDataFrame(list(tables.items()), "table string, folder string").coalesce(1).write.parquet(f"{root}/tables")
    return spark.read.schema(PINNED).parquet(f"{root}/files")


def changed_files(spark: SparkSession, root: str, table: str | None = None) -> DataFrame:
    """``DF(table, path, reason)`` of pinned files that are ``gone`` or ``changed`` since."""
    folders = _folders(spark, root)
    pinned = spark.read.schema(PINNED).parquet(f"{root}/files")
    found = None
    for name in [table] if table else folders:
        try:
            now = _files(spark, folders[name])
        except AnalysisException:  # not one file is left
            now = spark.createDataFrame([], "path string, length bigint, modified timestamp")
        now = now.select("path", F.col("length").alias("length_now"), F.col("modified").alias("modified_now"))
        reason = F.when(F.col("length_now").isNull(), "gone").when(
            (F.col("length") != F.col("length_now")) | (F.col("modified") != F.col("modified_now")), "changed"
        )
        one = pinned.where(F.col("table") == name).join(now, "path", "left").select("table", "path", reason.alias("reason")).where("reason IS NOT NULL")
        found = one if found is None else found.unionByName(one)
    return found


def _folders(spark: SparkSession, root: str) -> dict[str, str]:
    try:
        return {row.table: row.folder for row in spark.read.parquet(f"{root}/tables").collect()}
    except AnalysisException as error:
        raise ValueError(f"{root} holds no finished snapshot") from error


def read_pinned(spark: SparkSession, root: str, table: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """One table of a snapshot: the rows of exactly the pinned files.

    A file that is gone or has another length or time than when it was pinned is an error that
    names it. As with every scan, the driver holds the names of the files.
    """
    folders = _folders(spark, root)
    if table not in folders:
        raise ValueError(f"{root} pins no table called {table!r}")
    changed = changed_files(spark, root, table).orderBy("path").limit(NAMED_FILES).collect()
    if changed:
        raise ValueError("changed since they were pinned: " + ", ".join(f"{row.path} ({row.reason})" for row in changed))
    pinned = spark.read.schema(PINNED).parquet(f"{root}/files").where(F.col("table") == table)
    paths = [row.path for row in pinned.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return with_format(spark.read, fmt).schema(schema).option("basePath", folders[table]).load(paths)
