"""Ordered computations over groups of any size.

A window over a whole group runs in one task, however large the group. Here all rows are cut
into slices of about equal bytes, range-partitioned by group and order, so a large group spans
many slices and small ones share one. The window runs inside (group, slice); what the other
slices contribute is one aggregated row per group and slice, settled and joined back. There is
one algorithm for every size. NULL is a group like any other, and sorts first in an order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekeep.plans.settled import settle

# Bytes, as text, of the rows that one task puts in order.
SLICE_BYTES = 256 * 1024**2


def slice_rows(
    df: DataFrame, order: Sequence[str], size: Column | None = None, slice_bytes: int | None = None, out: str = "_slice"
) -> DataFrame:
    """Number the rows by slices that never decrease along ``order``, each of about ``slice_bytes``.

    ``order`` takes columns of any orderable type; add one that tells ties apart, as equal rows
    stay together. ``size`` is the bytes of a row, without it those of its JSON text. The numbered
    rows are settled: every later reading, also after lost executors, sees the same slices.
    """
    bytes_of = size if size is not None else F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    total = df.agg(F.sum(bytes_of.cast("double"))).first()[0] or 0
    slices = max(1, -(-int(total) // (slice_bytes or SLICE_BYTES)))
    ranged = df.repartitionByRange(slices, *order).withColumn(out, F.spark_partition_id())
    return settle(ranged, "slices-of-rows")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, whatever the case of letters."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _slice_totals(df: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    return df.groupBy(*keys).agg(total.alias(unused(df, "_total")))


def _join_carried(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the column ``carried`` has besides ``keys``."""
    value = next(c for c in carried.columns if c not in keys)
    others = {k: unused(df, f"_other_{k}") for k in keys}
    other = settle(carried, "slices").select(*(F.col(k).alias(name) for k, name in others.items()), value)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(name)) for k, name in others.items()))
    return df.join(other, same, "left").drop(*others.values())


def _ordering(columns: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in columns]


def running_sum(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    slice_col: str,
    value: Column,
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Add the running sum of ``value``, the row itself included."""
    groups, keys = list(groups), [*groups, slice_col]
    total, before = unused(df, "_total"), unused(df, "_carried")
    earlier = (
        Window.partitionBy(*groups)
        .orderBy(*_ordering([slice_col], descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*_ordering(order, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = _slice_totals(df, keys, F.sum(value)).select(
        *keys, F.sum(total).over(earlier).alias(before)
    )
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        _join_carried(df, carried, keys)
        .withColumn(out, F.coalesce(before, F.lit(0)) + own)
        .drop(before)
    )


def last_before(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], slice_col: str, value: Column, out: str
) -> DataFrame:
    """Add the last value that is not NULL among the earlier rows."""
    groups, keys = list(groups), [*groups, slice_col]
    total, before = unused(df, "_total"), unused(df, "_carried")
    earlier = Window.partitionBy(*groups).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    carried = _slice_totals(df, keys, newest).select(
        *keys, F.last(total, ignorenulls=True).over(earlier).alias(before)
    )
    return (
        _join_carried(df, carried, keys)
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col(before)))
        .drop(before)
    )


def next_after(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], slice_col: str, value: Column, out: str
) -> DataFrame:
    """Add the value of the next row; NULL on the last row of a group."""
    groups, keys = list(groups), [*groups, slice_col]
    total, before = unused(df, "_total"), unused(df, "_carried")
    by_slice = Window.partitionBy(*groups).orderBy(slice_col)
    carried = _slice_totals(df, keys, F.min_by(value, F.struct(*order))).select(
        *keys, F.lead(total).over(by_slice).alias(before)
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    is_last = F.lead(F.lit(1)).over(inside).isNull()
    return (
        _join_carried(df, carried, keys)
        .withColumn(out, F.when(is_last, F.col(before)).otherwise(F.lead(value).over(inside)))
        .drop(before)
    )
