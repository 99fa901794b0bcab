"""Files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.functions.columns import as_column
from tablekeep.functions.globs import exclude_glob
from tablekeep.sources.stores import list_files


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in one folder that holds few, such as one per batch; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def decoded_name(name: Column | str) -> Column:
    """A name without percent signs, as Spark writes them for values in folder names."""
    return F.url_decode(F.replace(as_column(name), F.lit("+"), F.lit("%2B")))


def file_inventory(spark: SparkSession, path: str, hidden: bool = False) -> DataFrame:
    """``DF(path, length)`` of all files below ``path``, empty ones too; contents are not read.

    Tasks list the folders, level by level. Files and folders that may not be read are skipped.
    Names that start with ``_`` or ``.`` are left out, as by Spark's own file sources, unless
    ``hidden``: then all bytes that lie there count.
    """
    return list_files(spark, path, hidden, skip_unreadable=True).select("path", "length")


def tree_size(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def exclude_files(inventory: DataFrame, *patterns: str, path: str = "path") -> DataFrame:
    """Drop the files whose path matches a glob."""
    return inventory.where(exclude_glob(path, *patterns))
