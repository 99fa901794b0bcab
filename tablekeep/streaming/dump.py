"""Continuous dump of an append-only table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablekeep.operators.changes import position_drift, record_positions
from tablekeep.operators.dump import DATA_DIR, MANIFEST_DIR, MANIFEST_SCHEMA, STREAMED, table_name, table_path
from tablekeep.plans.formats import FORMAT_OPTIONS, codec_for, writer_for
from tablekeep.plans.settled import settle
from tablekeep.sources.dumps import read_manifest, restore
from tablekeep.sources.files import names_in
from tablekeep.streaming.batches import fold, forget_checkpoint, is_fresh, last_batch, numbered, remember_checkpoint


def stream_dump(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    fmt: str = "parquet",
    codec: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Append the rows of a stream to the dump at ``root``.

    Without ``interval`` all rows present are written and the query ends. Started again on the
    same ``checkpoint`` it goes on after the last row written, without loss or repetition.
    """
    writer = (
        stream.writeStream.format(fmt)
        .options(**FORMAT_OPTIONS.get(fmt, {}))
        .option("compression", codec_for(codec, fmt))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if interval:
        writer = writer.trigger(processingTime=interval)
    else:
        writer = writer.trigger(availableNow=True)
    return writer.start(root)


@dataclass(frozen=True)
class Position:
    """How a dump whose checkpoint is lost finds its place: ``source`` is the streamed table read
    as a batch, ``seq`` a column that only grows and that no two rows share, ``ts`` its time."""

    source: DataFrame
    seq: str
    ts: str


def _entered(spark: SparkSession, root: str, table: tuple[str, str]) -> bool:
    if not names_in(spark, f"{root}/{MANIFEST_DIR}"):
        return False
    return not read_manifest(spark, root).where((F.col("database") == table[0]) & (F.col("name") == table[1])).isEmpty()


def moved_marks(spark: SparkSession, root: str, table: str, position: Position) -> DataFrame:
    """The marks of a streamed dump against those of the same rows of its source; no rows where they agree."""
    database, name = table_name(table)
    dumped = record_positions({table: restore(spark, root, name, database)}, {table: position.seq}, {table: position.ts})
    dumped = settle(dumped, "marks")
    newest = dumped.first()["max_seq"]
    same = position.source.where(F.col(position.seq) <= F.lit(newest))
    return position_drift(dumped, record_positions({table: same}, {table: position.seq}, {table: position.ts}))


def stream_dump_table(
    stream: DataFrame,
    root: str,
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
    codec: str | None = None,
    interval: str | None = None,
    position: Position | None = None,
) -> StreamingQuery:
    """Append the rows of a stream to a table of the dump at ``root``, which can be restored at any time.

    The table is entered in the manifest at the start. A micro-batch is a folder that counts once
    it is complete, and one that is run again overwrites its own; ``fold_dump`` merges them while
    the stream goes on. Without ``interval`` the query ends once all rows present are written.

    With a fresh ``checkpoint`` the dump goes on from ``position``: the rows written are compared
    with their source, marks that moved are an error, and only later rows are written. Without
    a position a fresh checkpoint is refused.
    """
    spark, names = stream.sparkSession, table_name(table)
    path = f"{DATA_DIR}/{table_path(*names)}"
    folder, begin = f"{root}/{path}", 0
    if is_fresh(spark, folder, checkpoint):
        if position is None:
            raise ValueError(f"{folder} has batches, but {checkpoint} is not the checkpoint they were written with")
        moved = [row.asDict() for row in moved_marks(spark, root, table, position).collect()]
        if moved:
            raise ValueError(f"the marks of {table} moved since it was dumped: {moved}")
        newest = restore(spark, root, names[1], names[0]).agg(F.max(position.seq)).first()[0]
        stream = stream.where(F.col(position.seq) > F.lit(newest))
        begin = last_batch(spark, folder) + 1
        forget_checkpoint(spark, folder)
    elif numbers := names_in(spark, f"{folder}/_begins"):
        begin = max(map(int, numbers))
    if begin:
        spark.range(0).write.mode("overwrite").parquet(f"{folder}/_begins/{begin}")
    if not _entered(spark, root, names):
        entry = (*names, path, fmt, codec_for(codec, fmt), True, STREAMED, stream.schema.json())
        spark.createDataFrame([entry], MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/{MANIFEST_DIR}")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        remember_checkpoint(spark, folder, checkpoint)
        writer_for(batch, fmt, codec, None).mode("overwrite").save(f"{folder}/batch={begin + batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def fold_dump(spark: SparkSession, root: str, table: str, codec: str | None = None) -> None:
    """Merge the small files of a streamed table into few; readers see the same rows all along."""
    database, name = table_name(table)
    folder = f"{root}/{DATA_DIR}/{table_path(database, name)}"
    done, newest = max(numbered(spark, folder, "upto"), default=-1), last_batch(spark, folder)
    if newest > done:
        fmt = read_manifest(spark, root).where((F.col("database") == database) & (F.col("name") == name)).first()["format"]
        fold(spark, folder, writer_for(restore(spark, root, name, database).hint("rebalance"), fmt, codec, None), newest)
