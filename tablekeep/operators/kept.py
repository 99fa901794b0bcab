"""Tables kept up to date in place, in buckets of their key.

A kept table is a folder with data written by several calls and one small list per call that
names, for each bucket, the call that wrote it last. A call reads and writes the buckets its
input touches, under a number of its own, and writes its list last; a reader opens the newest
complete list. So files of other buckets are neither read nor written, a call that fails changes
nothing, and a reader that has begun keeps the files it began with. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablekeep.operators.changes import apply_latest, latest_changes
from tablekeep.plans.settled import settle
from tablekeep.plans.sliced import next_after, slice_rows, unused
from tablekeep.sources.files import names_in

BUCKET = "kept_bucket"
VALID_TO = "valid_to"
_LIST = "bucket int, written int, buckets int, keys array<string>, schema string"


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def _last_call(spark: SparkSession, root: str) -> int:
    """The newest call whose list is complete, -1 without any."""
    calls = sorted((int(name) for name in names_in(spark, f"{root}/lists")), reverse=True)
    return next((n for n in calls if "_SUCCESS" in names_in(spark, f"{root}/lists/{n}")), -1)


class _Kept:
    """What the newest list says; it has one row per bucket."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.call = spark, root, _last_call(spark, root)
        if self.call < 0:
            raise ValueError(f"{root} holds no kept table")
        rows = spark.read.schema(_LIST).parquet(f"{root}/lists/{self.call}").collect()
        self.written = {row.bucket: row.written for row in rows}
        self.buckets, self.keys, self.schema = rows[0].buckets, list(rows[0]["keys"]), StructType.fromJson(json.loads(rows[0].schema))

    def table(self, buckets: Sequence[int] | None = None) -> DataFrame:
        chosen = self.written if buckets is None else {b: self.written[b] for b in buckets}
        paths = [f"{self.root}/data/{call}/{BUCKET}={bucket}" for bucket, call in sorted(chosen.items()) if call is not None]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, df: DataFrame) -> list[int]:
        return [row[0] for row in df.select(_bucket(self.keys, self.buckets)).distinct().collect()]

    def replace(self, buckets: Sequence[int], df: DataFrame) -> None:
        """Write ``df`` as all there is in ``buckets``."""
        call = max([self.call, *(int(n) for n in names_in(self.spark, f"{self.root}/data"))]) + 1
        df = df.select(*self.schema.names)
        _write(df, self.keys, self.buckets, f"{self.root}/data/{call}")
        _list(self.spark, self.root, call, self.buckets, self.keys, self.schema, {**self.written, **_found(self.spark, self.root, call, buckets)})


def _write(df: DataFrame, keys: Sequence[str], buckets: int, path: str) -> None:
    df.withColumn(BUCKET, _bucket(keys, buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)


def _found(spark: SparkSession, root: str, call: int, buckets: Sequence[int]) -> dict[int, int | None]:
    """The call for each bucket it wrote rows of, null for those that came out empty."""
    there = set(names_in(spark, f"{root}/data/{call}"))
    return {b: call if f"{BUCKET}={b}" in there else None for b in buckets}


def _list(spark: SparkSession, root: str, call: int, buckets: int, keys: Sequence[str], schema: StructType, written: dict[int, int | None]) -> None:
    rows = [(b, written[b], buckets, list(keys), schema.json()) for b in range(buckets)]
    spark.createDataFrame(rows, _LIST).coalesce(1).write.parquet(f"{root}/lists/{call}")


def keep(df: DataFrame, root: str, key: str | Sequence[str], buckets: int = 64) -> None:
    """Begin a kept table with the rows of ``df``.

    Choose ``buckets`` for about 1 GB each; a bucket may be read and written by several tasks.
    """
    keys, spark = _names(key), df.sparkSession
    if BUCKET in df.columns:
        raise ValueError(f"a kept table has no column of its own called {BUCKET}")
    if names_in(spark, root):
        raise ValueError(f"{root} is not empty")
    _write(df, keys, buckets, f"{root}/data/0")
    _list(spark, root, 0, buckets, keys, df.schema, _found(spark, root, 0, range(buckets)))


def kept(spark: SparkSession, root: str) -> DataFrame:
    """The table as of the last complete call."""
    return _Kept(spark, root).table()


def apply_log(spark: SparkSession, root: str, log: DataFrame, seq: str, values: Sequence[str], op: str = "op") -> None:
    """Replay a change log over a kept table of one row per key, in place.

    As ``apply_changes``, but reads and writes only buckets that hold a changed key. The base's
    columns must be its key and ``values``: others would have no value in inserted rows.
    """
    table = _Kept(spark, root)
    if set(table.schema.names) != {*table.keys, *values}:
        raise ValueError(f"the table's columns are {table.schema.names}, not its key and {list(values)}")
    latest = settle(latest_changes(log, table.keys, seq, values, op), "kept-changes")
    if buckets := table.touched(latest):
        table.replace(buckets, apply_latest(table.table(buckets), latest, table.keys, values))


def keep_history(versions: DataFrame, root: str, key: str | Sequence[str], ts: str, tie: str | None = None, buckets: int = 64) -> None:
    """Begin a kept history: every version of a key with its validity end, ``valid_to``."""
    keep(_with_ends(versions, _names(key), ts, tie), root, key, buckets)


def _with_ends(versions: DataFrame, keys: list[str], ts: str, tie: str | None) -> DataFrame:
    order = [ts, tie] if tie else [ts]
    name = unused(versions, "_slice")
    sliced = slice_rows(versions, [*keys, *order], out=name)
    return next_after(sliced, keys, order, name, F.col(ts), VALID_TO).drop(name)


def add_versions(spark: SparkSession, root: str, versions: DataFrame, ts: str, tie: str | None = None) -> None:
    """Add versions to a kept history, in any order of arrival.

    A newer version closes the open interval of its key, a late one splits the interval it falls
    into. Of versions equal in key, time and tie the one that came first stays, so a delivery may
    be repeated. Only buckets with a new version are read and written, and in them only keys with
    a new version are put in order again.
    """
    table = _Kept(spark, root)
    keys, order = table.keys, [ts, tie] if tie else [ts]
    same = [*keys, *order]
    columns = [c for c in table.schema.names if c != VALID_TO]
    fresh = settle(versions.select(*columns).dropDuplicates(same), "new-versions")
    if not (buckets := table.touched(fresh)):
        return
    before, moved = table.table(buckets), settle(fresh.select(*keys).distinct(), "new-keys")
    known = before.join(moved, keys, "left_semi").drop(VALID_TO)
    renamed = known.select(*(F.col(c).alias(f"known_{c}") for c in same))
    equal = [F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in same]
    new = fresh.join(renamed, equal, "left_anti")
    table.replace(buckets, before.join(moved, keys, "left_anti").unionByName(_with_ends(known.unionByName(new), keys, ts, tie)))
