"""Intermediate results, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablekeep.session import scratch_dir


def settle(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` now into a table in the scratch folder and read it from there.

    Spark guesses the size of an aggregated result from its input, and then shuffles a large
    table to join it with a handful of rows. Of a written table it knows the size: it is
    broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled beyond. The table
    also outlives lost executors. It is written whatever its size, and stays until the scratch
    folder is emptied, as later readings of lazy results need it.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
