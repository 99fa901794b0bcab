"""Continuous replay of a change log.

Each micro-batch is reduced to the last change per key and written as ``batch=<id>``.
Readers take the last change per key over all batches. The newest ``seq`` wins wherever it
is, so late and repeated changes do no harm and the query itself needs no state that would
grow with the number of keys. ``compact`` folds the batches written so far into
``upto=<id>``, which readers take in their place while the stream goes on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablekeep.operators.changes import apply_latest, latest_changes, newest_changes
from tablekeep.streaming.batches import fold, is_fresh, last_batch, numbered, parts, remember_checkpoint


def stream_apply(
    log_stream: DataFrame,
    key: str | Sequence[str],
    seq: str,
    root: str,
    checkpoint: str,
    values: Sequence[str] = ("value",),
    op: str = "op",
    interval: str | None = None,
) -> StreamingQuery:
    """Follow a change log, keeping the last change per key under ``root``.

    A batch that is run again overwrites its own folder. Without ``interval`` the query ends
    once all changes present are written. A ``root`` that has batches needs the ``checkpoint``
    they were written with: a fresh one would count from zero and overwrite them.
    """
    spark = log_stream.sparkSession
    if is_fresh(spark, root, checkpoint):
        raise ValueError(f"{root} has batches, but {checkpoint} is not the checkpoint they were written with")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        remember_checkpoint(spark, root, checkpoint)
        latest = latest_changes(batch, key, seq, values, op)
        latest.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = log_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if interval:
        writer = writer.trigger(processingTime=interval)
    else:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def streamed_changes(
    spark: SparkSession, root: str, key: str | Sequence[str], seq: str, values: Sequence[str] = ("value",)
) -> DataFrame:
    """The last change of each key over all batches written so far."""
    return newest_changes(spark.read.parquet(*parts(spark, root)), key, seq, values)


def streamed_state(
    spark: SparkSession,
    root: str,
    base: DataFrame,
    key: str | Sequence[str],
    seq: str,
    values: Sequence[str] = ("value",),
) -> DataFrame:
    """The base with all streamed changes applied."""
    return apply_latest(base, streamed_changes(spark, root, key, seq, values), key, values)


def compact(spark: SparkSession, root: str, key: str | Sequence[str], seq: str, values: Sequence[str] = ("value",)) -> None:
    """Fold all batches written so far into one table that readers take in their place.

    The table counts once it is complete, and only then the folded batches are deleted, so a
    compaction that fails changes nothing. Nothing new since the last one is nothing to do.
    """
    done, newest = max(numbered(spark, root, "upto"), default=-1), last_batch(spark, root)
    if newest > done:
        fold(spark, root, streamed_changes(spark, root, key, seq, values).write.format("parquet"), newest)
