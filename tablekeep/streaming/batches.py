"""Folders that a stream writes batch by batch.

A micro-batch is ``batch=<id>`` and counts once it is complete; folding writes all complete ones
into ``upto=<id>``, which readers take in their place. The checkpoint a folder was written with
is remembered beside the data, as batch ids mean nothing without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrameWriter, SparkSession

from tablekeep.sources.files import delete_folder, names_in

_REMEMBERED = "_checkpoint"


def numbered(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The complete folders of a kind, oldest first."""
    found = sorted(int(name.removeprefix(f"{kind}=")) for name in names_in(spark, root) if name.startswith(f"{kind}="))
    return [i for i in found if "_SUCCESS" in names_in(spark, f"{root}/{kind}={i}")]


def parts(spark: SparkSession, root: str) -> list[str]:
    """The last folding and the batches after it."""
    done = max(numbered(spark, root, "upto"), default=-1)
    after = [f"{root}/batch={i}" for i in numbered(spark, root, "batch") if i > done]
    return ([f"{root}/upto={done}"] if done >= 0 else []) + after


def last_batch(spark: SparkSession, root: str) -> int:
    """The newest batch that was written, folded or not; -1 without any."""
    return max([*numbered(spark, root, "batch"), *numbered(spark, root, "upto")], default=-1)


def fold(spark: SparkSession, root: str, folded: DataFrameWriter, upto: int) -> None:
    """Write what stands for all batches up to ``upto``, and delete those once it is complete."""
    folded.mode("overwrite").save(f"{root}/upto={upto}")
    stale = [f"batch={i}" for i in numbered(spark, root, "batch") if i <= upto]
    for name in [*stale, *(f"upto={i}" for i in numbered(spark, root, "upto") if i < upto)]:
        delete_folder(spark, f"{root}/{name}")


def _checkpoint_id(spark: SparkSession, checkpoint: str) -> str | None:
    if "metadata" not in names_in(spark, checkpoint):
        return None
    return spark.read.text(f"{checkpoint}/metadata").first()[0]


def remember_checkpoint(spark: SparkSession, root: str, checkpoint: str) -> None:
    """Keep the id of the checkpoint beside the data; called before a batch is written."""
    if _REMEMBERED not in names_in(spark, root):
        spark.createDataFrame([(_checkpoint_id(spark, checkpoint),)], "id string").coalesce(1).write.text(f"{root}/{_REMEMBERED}")


def is_fresh(spark: SparkSession, root: str, checkpoint: str) -> bool:
    """Whether ``root`` has batches that ``checkpoint`` knows nothing of."""
    if last_batch(spark, root) < 0:
        return False
    if _REMEMBERED not in names_in(spark, root):
        return not names_in(spark, f"{checkpoint}/commits")
    return spark.read.text(f"{root}/{_REMEMBERED}").first()[0] != _checkpoint_id(spark, checkpoint)


def forget_checkpoint(spark: SparkSession, root: str) -> None:
    delete_folder(spark, f"{root}/{_REMEMBERED}")
