"""Reading dumps back."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablekeep.functions.globs import include_glob, qualify
from tablekeep.operators.dump import COMBINED_SCHEMA, MANIFEST_DIR, MANIFEST_SCHEMA, STREAMED, partition_name
from tablekeep.plans.formats import FORMAT_OPTIONS, with_format
from tablekeep.streaming.batches import parts


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a finished dump. One row per table."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/{MANIFEST_DIR}")
    except AnalysisException as error:
        raise ValueError(f"{root} holds no finished dump: it has no manifest") from error


def _read_table(spark: SparkSession, root: str, entry: Row, schema: StructType | None) -> DataFrame:
    if schema is None and entry.schema:
        schema = StructType.fromJson(json.loads(entry.schema))
    if entry.what == STREAMED:
        found = parts(spark, f"{root}/{entry.path}")
        return with_format(spark.read, entry.format).schema(schema).load(found) if found else spark.createDataFrame([], schema)
    if entry.per_database:
        reader = with_format(spark.read, entry.format)
        return (reader.schema(schema) if schema else reader).load(f"{root}/{entry.path}")
    if schema is None:
        raise ValueError("a dump of data only needs the table's schema to be restored")
    together = with_format(spark.read, entry.format).schema(COMBINED_SCHEMA).load(f"{root}/{entry.path}")
    mine = together.where((F.col("database") == partition_name(entry.database)) & (F.col("name") == partition_name(entry.name)))
    return mine.select(F.from_json("row", schema, FORMAT_OPTIONS["json"]).alias("row")).select("row.*")


def restore(
    spark: SparkSession, root: str, table: str, database: str | None = None, schema: StructType | None = None
) -> DataFrame:
    """One table of a dump. The codec follows from the file names."""
    found = read_manifest(spark, root).where(F.col("name") == table)
    if database is not None:
        found = found.where(F.col("database") == database)
    entries = found.collect()
    if len(entries) != 1:
        raise ValueError(f"{len(entries)} tables called {table!r} in {root}")
    return _read_table(spark, root, entries[0], schema)


def restore_tables(spark: SparkSession, root: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """The tables whose ``database.table`` matches a glob, by that name."""
    full_name = F.concat_ws(".", "database", "name")
    entries = read_manifest(spark, root).where(include_glob(full_name, *qualify(*tables))).collect()
    return {f"{e.database}.{e.name}": _read_table(spark, root, e, None) for e in entries}
