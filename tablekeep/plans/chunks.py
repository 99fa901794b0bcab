"""Packing rows into chunks of about equal bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.plans.sliced import running_sum, slice_rows, unused

CHUNK_BYTES = 64 * 1024**2


def chunk_plan(
    df: DataFrame, key: str | Sequence[str], size_col: str, chunk_bytes: int = CHUNK_BYTES, slice_bytes: int | None = None
) -> DataFrame:
    """Add ``chunk_id``: rows in the order of a unique ``key``, one or more columns of any
    orderable type, a new chunk starting at every ``chunk_bytes`` of the whole number ``size_col``.

    NULL keys come first and NULL sizes count nothing. A chunk holds less than ``chunk_bytes``
    plus one row. The rows are range-partitioned and never gathered in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    size = F.coalesce(F.col(size_col), F.lit(0))
    part, end = unused(df, "_slice"), unused(df, "_end")
    summed = running_sum(slice_rows(df, keys, size, slice_bytes, part), [], keys, part, size, end)
    start = F.col(end) - size
    return summed.withColumn("chunk_id", F.call_function("div", start, F.lit(chunk_bytes))).drop(end, part)
