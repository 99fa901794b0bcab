"""Document collections."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablekeep.plans.settled import settle


def scan_documents(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """Read JSON lines, any codec.

    Without ``schema`` Spark reads all of the data once more to infer it.
    """
    return (spark.read if schema is None else spark.read.schema(schema)).json(path)


def scan_variants(spark: SparkSession, path: str) -> DataFrame:
    """``DF(doc VARIANT)``: JSON lines in one pass, each document with the fields and types it has."""
    return spark.read.format("json").option("singleVariantColumn", "doc").load(path)


def _kind(value: Column) -> Column:
    """The type of a VARIANT without its inside and precision, such as ``OBJECT`` or ``DECIMAL``."""
    return F.regexp_replace(F.schema_of_variant(value), r"[<(].*", "")


def field_catalog(docs: DataFrame, column: str = "doc") -> DataFrame:
    """``DF(path, type, n)``: how often each field has which type, at any depth.

    A path has a dot before the name of a field and ``[]`` for the elements of an array; the
    documents themselves have the path ``$``. Fields that are JSON's null have the type ``VOID``.
    Goes down one depth in each round, over the objects and arrays of the one before only; counts
    are combined before they are shuffled.
    """
    level = docs.where(F.col(column).isNotNull()).select(F.lit("$").alias("path"), F.col(column).alias("value"))
    counts = []
    while True:
        level = level.select("path", "value", _kind(F.col("value")).alias("type"))
        counts.append(settle(level.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n")), "field-counts"))
        if counts[-1].where(F.col("type").isin("OBJECT", "ARRAY")).isEmpty():
            return reduce(DataFrame.unionAll, counts)
        inner = level.where(F.col("type").isin("OBJECT", "ARRAY")).select("path", "type", F.col("value").alias("holder"))
        inner = inner.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("holder").outer()))
        step = F.when(F.col("type") == "ARRAY", F.lit("[]")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = settle(inner.select(F.concat("path", step).alias("path"), "value"), "fields")


def field_types(catalog: DataFrame) -> DataFrame:
    """``DF(path, type, conflict)``: one type that holds all values of a path, ``VARIANT`` if there is none.

    Integers and other numbers together are ``DOUBLE``; nulls go with any type.
    """
    kinds = F.array_sort(F.array_remove(F.collect_set("type"), "VOID"))
    numbers = F.array(*(F.lit(kind) for kind in ("BIGINT", "DECIMAL", "DOUBLE")))
    one = (
        F.when(F.size("kinds") == 0, "VOID")
        .when(F.size("kinds") == 1, F.when(F.get("kinds", F.lit(0)) == "DECIMAL", "DOUBLE").otherwise(F.get("kinds", F.lit(0))))
        .when(F.size(F.array_except("kinds", numbers)) == 0, "DOUBLE")
        .otherwise("VARIANT")
    )
    found = catalog.groupBy("path").agg(kinds.alias("kinds"))
    return found.select("path", one.alias("type"), (F.size("kinds") > 1).alias("conflict"))


def cut_columns(docs: DataFrame, columns: Mapping[str, tuple[str, ...]], column: str = "doc") -> DataFrame:
    """Typed columns from documents that differ: ``{name: (type, path, ...)}``.

    The first of the paths whose value can be taken as the type counts. No document is refused: a
    value that fits none of the paths is NULL, and the document itself is kept as ``column``.
    """
    def taken(kind: str, *paths: str) -> Column:
        return F.coalesce(*(F.try_variant_get(F.col(column), path, kind) for path in paths))

    return docs.select(*(taken(kind, *paths).alias(name) for name, (kind, *paths) in columns.items()), column)
