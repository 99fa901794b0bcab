"""Change logs, versions, positions and stale views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.plans.settled import settle
from tablekeep.plans.sliced import next_after, slice_rows, unused


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def latest_changes(
    log: DataFrame, key: str | Sequence[str], seq: str, values: Sequence[str], op: str = "op"
) -> DataFrame:
    """The last change of each key: ``key, seq, deleted, values``.

    Combined on the map side, so a key with very many changes sends one row per task. Of several
    changes with the last ``seq`` a deletion wins, then the largest values in their order, so the
    result does not depend on the order or the repetition of log rows. A row without an
    operation is an error.
    """
    missing = F.raise_error(F.lit("a change has no operation")).cast("boolean")
    deleted = F.when(F.col(op).isNull(), missing).otherwise(F.col(op) == "D")
    last = F.max(F.struct(F.col(seq).alias("_seq"), deleted.alias("_deleted"), *values)).alias("_last")
    return _last_changes(log.groupBy(*_names(key)).agg(last), key, seq, values)


def _last_changes(latest: DataFrame, key: str | Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    fields = [F.col("_last._seq").alias(seq), F.col("_last._deleted").alias("deleted")]
    return latest.select(*_names(key), *fields, *(F.col("_last").getField(v).alias(v) for v in values))


def newest_changes(changes: DataFrame, key: str | Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    """As ``latest_changes`` for rows that are last changes themselves, of parts of a log."""
    last = F.max(F.struct(F.col(seq).alias("_seq"), F.col("deleted").alias("_deleted"), *values)).alias("_last")
    return _last_changes(changes.groupBy(*_names(key)).agg(last), key, seq, values)


def apply_latest(
    base: DataFrame, latest: DataFrame, key: str | Sequence[str], values: Sequence[str], incremental: bool = False
) -> DataFrame:
    """Apply at most one change per key to ``base``, which has one row per key.

    ``incremental=True`` is for a log that touches few keys: the changes are settled first, so
    Spark broadcasts them when they turn out small and never shuffles the base. Both ways
    give the same rows.
    """
    keys = _names(key)
    if incremental:
        latest = settle(latest, "changes")
    renamed = latest.select(*keys, F.col("deleted").alias("_deleted"), F.lit(True).alias("_changed"), *(F.col(v).alias(f"_new_{v}") for v in values))
    new_or_old = [F.when(F.col("_changed"), F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    alive = F.coalesce(~F.col("_deleted"), F.lit(True))
    if not incremental:
        return base.join(renamed, keys, "full_outer").where(alive).select(*keys, *new_or_old)
    updated = base.join(renamed, keys, "left").where(alive).select(*keys, *new_or_old)
    touched = settle(base.select(*keys).join(renamed.select(*keys), keys, "left_semi"), "touched")
    inserted = (
        renamed.where(alive)
        .join(touched, keys, "left_anti")
        .select(*keys, *(F.col(f"_new_{v}").alias(v) for v in values))
    )
    return updated.unionByName(inserted)


def apply_changes(
    base: DataFrame,
    log: DataFrame,
    key: str | Sequence[str],
    seq: str,
    values: Sequence[str] = ("value",),
    op: str = "op",
    incremental: bool = False,
) -> DataFrame:
    """Replay a change log over a base: last change wins, ``op='D'`` deletes the row."""
    return apply_latest(base, latest_changes(log, key, seq, values, op), key, values, incremental)


def dump_view(
    versions: DataFrame,
    key: str | Sequence[str],
    ts: str,
    history: bool = False,
    tie: str | None = None,
    slice_bytes: int | None = None,
) -> DataFrame:
    """Current rows only, or every version with its validity end ``valid_to``.

    ``tie`` orders versions of a key with the same time; versions without a time come first.
    """
    keys = _names(key)
    order = [ts, tie] if tie else [ts]
    if not history:
        rest = [c for c in versions.columns if c not in keys]
        current = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_current"))
        return current.select(*keys, "_current.*").select(*versions.columns)
    name = unused(versions, "_slice")
    sliced = slice_rows(versions, [*keys, *order], slice_bytes=slice_bytes, out=name)
    return next_after(sliced, keys, order, name, F.col(ts), "valid_to").drop(name)


def record_positions(
    tables: Mapping[str, DataFrame], seq: Mapping[str, str], ts: Mapping[str, str]
) -> DataFrame:
    """High-water mark of each table: ``DF(table, max_seq, max_ts, n_rows)``."""
    marks = [
        position_marks(df.withColumn("_table", F.lit(name)), "_table", seq[name], ts[name])
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, marks)


def position_marks(df: DataFrame, table: str, seq: str, ts: str) -> DataFrame:
    """As ``record_positions`` for one stream of rows that names its table in a column."""
    return df.groupBy(F.col(table).alias("table")).agg(
        F.max(seq).alias("max_seq"), F.max(ts).alias("max_ts"), F.count(F.lit(1)).alias("n_rows")
    )


def position_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose marks moved, appeared or vanished between two recordings."""
    marks = ["max_seq", "max_ts", "n_rows"]
    old = before.select("table", *(F.col(m).alias(f"{m}_before") for m in marks))
    new = after.select("table", *(F.col(m).alias(f"{m}_after") for m in marks))
    moved: Column = reduce(
        Column.__or__, (~F.col(f"{m}_before").eqNullSafe(F.col(f"{m}_after")) for m in marks)
    )
    return old.join(new, "table", "full_outer").where(moved)


def broken_views(views: DataFrame, deps: DataFrame, objects: DataFrame) -> DataFrame:
    """``DF(view, depth, missing)``: views that cannot be read, and what they lack.

    A view is broken at depth 1 when something it names neither exists nor is a view, and one
    deeper when it names a broken view; ``depth`` is the least, ``missing`` the first name in
    order that breaks it at that depth. Views that only name each other are not broken.

    All names are looked up in one join, and what exists and is no view is dropped there. Only the
    views found in the last round are joined in the next one, each view counts in one round only,
    and every round is settled, so a circle ends and the rounds are as many as the deepest view.
    Once the views found are a quarter of the names left, what they name is dropped, so that later
    rounds neither read it nor compare with these views. Names of views are compared when both
    columns are of one type.
    """
    known = objects.select("object", F.lit(False).alias("nested"))
    if nested := deps.schema["object"].dataType == views.schema["view"].dataType:
        known = known.unionByName(views.select(F.col("view").alias("object"), F.lit(True).alias("nested")))
    known = settle(known.where("object IS NOT NULL").groupBy("object").agg(F.max("nested").alias("nested")), "known-names")
    named = deps.select("view", "object").where("view IS NOT NULL AND object IS NOT NULL")
    open_names = named.join(known, "object", "left").where("nested IS NULL OR nested")
    open_names = settle(open_names.join(views.select("view"), "view", "left_semi").select("view", "object", "nested"), "names-of-views")
    lacking = open_names.where("nested IS NULL").groupBy("view")
    fresh = settle(lacking.agg(F.lit(1).alias("depth"), F.min("object").alias("missing")), "broken-views")
    between = open_names.where("nested").select("view", "object")
    left, rounds, since, found = between.count(), [fresh], [fresh], 0
    while left and (count := fresh.count()):
        found += count
        if 4 * found >= left:
            between = settle(between.join(_view_names(since), "view", "left_anti"), "views-of-views")
            left, since, found = between.count(), [], 0
        above = between.join(fresh.withColumnRenamed("view", "object"), "object").groupBy("view")
        reached = above.agg((F.first("depth") + 1).alias("depth"), F.min("missing").alias("missing"))
        fresh = settle(reached.join(_view_names(since), "view", "left_anti") if since else reached, "broken-views")
        rounds.append(fresh)
        since.append(fresh)
    return reduce(DataFrame.unionByName, rounds)


def _view_names(rounds: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (r.select("view") for r in rounds))


def invalid_views(views: DataFrame, deps: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split views into those that can be read and those to set aside, be it for a view they read.

    ``views`` has ``view``, ``deps`` has ``view, object``, ``objects`` has ``object``.
    """
    broken = broken_views(views, deps, objects).select("view")
    return views.join(broken, "view", "left_anti"), views.join(broken, "view", "left_semi")
