"""The history of runs: listing, prediction, space and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.operators.retention import RUN_ORDER
from tablekeep.plans.sliced import last_before, slice_rows, unused

LOW_SPACE_SHARE = 0.10


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs whose record names a plugin; the others are broken."""
    return runs.where(F.length("plugin") > 0)


def list_runs(runs: DataFrame, reverse: bool = False, order: Sequence[str] = RUN_ORDER) -> DataFrame:
    columns = ("backupset", *order)
    return runs.orderBy(*((F.desc if reverse else F.asc)(c) for c in columns))


def find_run(runs: DataFrame, name: str) -> DataFrame:
    """The run called ``set/run name``; any other form of name finds nothing."""
    parts = name.split("/")
    if len(parts) != 2:
        return runs.where(F.lit(False))
    return runs.where((F.col("backupset") == parts[0]) & (F.col("name") == parts[1]))


def newest_oldest(runs: DataFrame) -> DataFrame:
    return runs.groupBy("backupset").agg(F.max("name").alias("newest"), F.min("name").alias("oldest"))


def run_sets(runs: DataFrame) -> DataFrame:
    """Set names in listing order."""
    return runs.groupBy("backupset").agg(F.min("name").alias("first_run")).orderBy("backupset")


def historic_estimate(
    runs: DataFrame,
    historic_size: bool | Column = True,
    growth_limit: float | Column = 1.5,
    historic_factor: float | Column = 1.1,
    size_factor: float | Column = 1.0,
    order: Sequence[str] = RUN_ORDER,
    slice_bytes: int | None = None,
) -> DataFrame:
    """Add the space each run will need, as ``required_bytes``, and its ``basis``.

    The last earlier run that did not fail is the guide: its size on disk times
    ``historic_factor``. The plain estimate times ``size_factor`` is used when there is no
    such run, its record is incomplete, or the estimate grew past ``growth_limit``. Each
    setting may be a Column, to differ between sets.
    """
    factor = size_factor if isinstance(size_factor, Column) else F.lit(size_factor)
    plain = F.col("estimated_size").cast("double") * factor
    if historic_size is False:
        return runs.withColumn("required_bytes", plain).withColumn("basis", F.lit("estimate"))
    success = F.when(~F.col("failed"), F.struct("estimated_size", "on_disk_size", "estimated_size_factor"))
    part, guide = unused(runs, "_slice"), unused(runs, "_prior")
    sliced = slice_rows(runs, ["backupset", *order], slice_bytes=slice_bytes, out=part)
    with_prior = last_before(sliced, ["backupset"], order, part, success, guide)
    prior = F.col(guide)
    enabled = historic_size if isinstance(historic_size, Column) else F.lit(True)
    usable = F.coalesce(
        enabled
        & (prior.estimated_size_factor != 0)
        & (prior.on_disk_size != 0)
        & (F.col("estimated_size") <= prior.estimated_size.cast("double") * growth_limit),
        F.lit(False),
    )
    return (
        with_prior.withColumn(
            "required_bytes",
            F.when(usable, prior.on_disk_size.cast("double") * historic_factor).otherwise(plain),
        )
        .withColumn("basis", F.when(usable, "history").otherwise("estimate"))
        .drop(guide, part)
    )


def space_check(required: DataFrame, capacity: DataFrame) -> DataFrame:
    """``required(backupset, required_bytes)`` against ``capacity(backupset, free_bytes)``.

    Exactly as much free space as required is not enough.
    """
    return required.join(capacity.select("backupset", "free_bytes"), "backupset", "left").withColumn(
        "status",
        F.when(F.col("free_bytes").isNull(), "unknown")
        .when(F.col("free_bytes") <= F.col("required_bytes"), "insufficient")
        .otherwise("ok"),
    )


def low_space(capacity: DataFrame) -> DataFrame:
    return capacity.where(F.col("free_bytes") < LOW_SPACE_SHARE * F.col("total_bytes"))


def estimate_accuracy(runs: DataFrame) -> DataFrame:
    """Size on disk as a percentage of the estimate, where both mean something."""
    return runs.where((F.col("estimated_size") > 0) & ~F.col("failed")).withColumn(
        "percent", F.round(F.col("on_disk_size") / F.col("estimated_size") * 100, 2)
    )


def duration_seconds() -> Column:
    return F.timestamp_diff("SECOND", F.col("start_time"), F.col("stop_time"))


def run_report(runs: DataFrame) -> DataFrame:
    return runs.groupBy("backupset").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("failed").alias("failures"),
        F.sum(duration_seconds()).alias("seconds"),
        F.sum("on_disk_size").alias("on_disk_bytes"),
        F.min("start_time").alias("first_start"),
        F.max("stop_time").alias("last_stop"),
    )
