"""Which runs to keep and which to purge.

Deleting is not done here: every function returns a plan.

Runs are kept or purged by age, so each plan comes down to one border run per set. The border
is found without sorting or shuffling the runs: they are counted by set and day with map-side
combine, the day the border falls into follows from those counts, and only the runs of that
day are put in order. The runs are then compared with the border of their set. Both the
days and the borders, at most one row per set, are settled before they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekeep.functions.times import run_day
from tablekeep.plans.settled import settle

RUN_ORDER = ("name",)

_SLICE = "_slice"


def newest_n(runs: DataFrame, n: int, order: Sequence[str] = RUN_ORDER) -> DataFrame:
    """The newest ``n`` runs of every set."""
    return retention_plan(runs, n, order).where(F.col("action") == "keep").drop("action")


def _action(purge: Column) -> Column:
    return F.when(F.coalesce(purge, F.lit(False)), "purge").otherwise("keep").alias("action")


def _with_border(runs: DataFrame, border_days: DataFrame, chosen: Column, order: Sequence[str]) -> DataFrame:
    """Add ``_border``, the order columns of the border run of each set.

    ``border_days`` has one row per set that has a border. ``chosen`` picks the border run
    inside its day; where it picks several, the last one counts.
    """
    if order[0] != "name":
        raise ValueError("runs are kept and purged by age: the order must start with name")
    days = settle(border_days, "border-days")
    in_day = runs.withColumn(_SLICE, run_day("name")).join(days, ["backupset", _SLICE])
    borders = (
        in_day.select("backupset", F.struct(*order).alias("_order"), chosen.alias("_chosen"))
        .where("_chosen")
        .groupBy("backupset")
        .agg(F.max("_order").alias("_border"))
    )
    return runs.join(settle(borders, "borders"), "backupset", "left")


def retention_plan(runs: DataFrame, keep: int | str, order: Sequence[str] = RUN_ORDER) -> DataFrame:
    """Add ``action``: the newest ``keep`` runs of a set stay, the rest is purged.

    ``keep`` is a number, or the name of a column that has one number per set; NULL there
    purges nothing.
    """
    negative = "the number of runs to keep cannot be negative"
    if isinstance(keep, str):
        count = F.when(F.col(keep) < 0, F.raise_error(F.lit(negative)).cast("int")).otherwise(F.col(keep))
    elif keep < 0:
        raise ValueError(negative)
    else:
        count = F.lit(keep)
    newer = Window.partitionBy("backupset").orderBy(F.desc(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    border_days = (
        runs.groupBy("backupset", run_day("name").alias(_SLICE))
        .agg(F.count(F.lit(1)).alias("_runs"), F.max(count).alias("_keep"))
        .withColumn("_newer", F.coalesce(F.sum("_runs").over(newer), F.lit(0)))
        .where((F.col("_newer") < F.col("_keep")) & (F.col("_keep") <= F.col("_newer") + F.col("_runs")))
        .select("backupset", _SLICE, (F.col("_keep") - F.col("_newer")).alias("_left"))
    )
    newest_first = Window.partitionBy("backupset").orderBy(*(F.desc(c) for c in order))
    oldest_kept = F.row_number().over(newest_first) == F.col("_left")
    return (
        _with_border(runs, border_days, oldest_kept, order)
        .withColumn("action", _action((count == 0) | (F.struct(*order) < F.col("_border"))))
        .drop("_border")
    )


def effective_keep(n: Column, policy: Column, event: str) -> Column:
    """How many runs stay when ``event`` happens; NULL purges nothing.

    Before a run the one about to be made counts too. After a run at least one stays.
    ``event='all'`` is the request to purge a whole set.
    """
    match event:
        case "all":
            return F.lit(0)
        case "before-backup":
            return F.when(policy == event, n + 1)
        case "after-backup":
            return F.when(policy == event, F.when(n == 0, F.lit(1)).otherwise(n))
    raise ValueError(f"unknown event {event!r}")


def purge_on_demand(runs: DataFrame, capacity: DataFrame, order: Sequence[str] = RUN_ORDER) -> DataFrame:
    """Add ``action``: purge oldest runs until more than the required space is free.

    ``capacity`` has ``backupset, free_bytes, required_bytes``, one row per set. A set whose
    runs together would not free enough keeps them all. The run in progress must not be among
    ``runs``.
    """
    older = Window.partitionBy("backupset").orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    per_set = Window.partitionBy("backupset")
    space = capacity.select("backupset", "free_bytes", "required_bytes")
    short = F.col("free_bytes") + F.col("_older") <= F.col("required_bytes")
    can_succeed = F.col("free_bytes") + F.col("_total") > F.col("required_bytes")
    border_days = (
        runs.groupBy("backupset", run_day("name").alias(_SLICE))
        .agg(F.sum("on_disk_size").alias("_bytes"))
        .withColumn("_older", F.coalesce(F.sum("_bytes").over(older), F.lit(0)))
        .withColumn("_total", F.sum("_bytes").over(per_set))
        .join(space, "backupset")
        .where(short & can_succeed)
        .groupBy("backupset")
        .agg(
            F.max(_SLICE).alias(_SLICE),
            F.max("_older").alias("_older"),
            F.first(F.col("required_bytes") - F.col("free_bytes")).alias("_needed"),
        )
    )
    oldest_first = Window.partitionBy("backupset").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    freed_before = F.col("_older") + F.coalesce(F.sum("on_disk_size").over(oldest_first), F.lit(0))
    return (
        _with_border(runs, border_days, freed_before <= F.col("_needed"), order)
        .withColumn("action", _action(F.struct(*order) <= F.col("_border")))
        .drop("_border")
    )


def survivors(
    runs: DataFrame, plan: DataFrame, auto_purge_failures: bool = True, order: Sequence[str] = RUN_ORDER
) -> DataFrame:
    """The runs left once ``plan`` is carried out."""
    purged = plan.where(F.col("action") == "purge").select("backupset", *order)
    left = runs.join(purged, ["backupset", *order], "left_anti")
    return left.where(~F.col("failed")) if auto_purge_failures else left


def purge_summary(plan: DataFrame) -> DataFrame:
    purged = F.col("action") == "purge"
    return plan.groupBy("backupset").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~purged).alias("kept"),
        F.count_if(purged).alias("purged"),
        F.coalesce(F.sum(F.when(purged, F.col("on_disk_size"))), F.lit(0)).alias("purged_bytes"),
    )
