"""Files of a store, listed, read, written and deleted by tasks.

Spark's file sources hide names that start with ``_`` or ``.``, make no rows of empty files, read
a file whole, and plan with all file names on the driver. Here the driver sees counts only, and
tasks reach the store through ``pyarrow``: folders every executor has mounted, HDFS, S3, Google
and Azure storage, with the settings the executors' environment gives these.
"""

from __future__ import annotations

import functools
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.session import scratch_dir

# Bytes of contents a task takes, and those it hands on in one go.
TASK_BYTES = 128 * 1024**2
BATCH_BYTES = 16 * 1024**2
# Names a task takes at most, where their number and not their contents is the work.
TASK_NAMES = 1000

# Schemes of Hadoop's connectors and those pyarrow knows the same stores by.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}

_LISTED = "member string, is_folder boolean, length bigint, modified timestamp"


def locate(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority the session resolves it to."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


@functools.cache
def _store(address: str) -> tuple[fs.FileSystem, str]:
    """A store and how paths in it begin."""
    scheme, _, rest = address.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), ""
    store, base = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    return store, base.rstrip("/")


def _open(located: str) -> tuple[fs.FileSystem, str]:
    """The store of a located path and the path in it."""
    scheme, _, rest = located.partition(":")
    authority, _, inner = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    store, base = _store(f"{scheme}://{authority}/")
    return store, f"{base}/{inner}"


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, object]]:
    """Name, whether a folder, length and time of what lies in ``folder``.

    A link to a file counts as that file; links to folders are not followed, so circles end.
    """
    if not isinstance(store, fs.LocalFileSystem):
        for info in store.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, info.mtime_ns
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, 0, entry.stat(follow_symlinks=False).st_mtime_ns
                elif entry.is_file():
                    stat = entry.stat()
                    yield entry.name, False, stat.st_size, stat.st_mtime_ns
            except OSError:  # gone since the folder was read
                continue


def is_hidden(name: str) -> bool:
    """Whether Spark's file sources leave the name out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _dealt(df: DataFrame, rows: int, size: int, *keys: str) -> DataFrame:
    """``df`` in as many parts as its rows or bytes ask for, and no fewer than there are cores for."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows, cores), -(-rows // TASK_NAMES), -(-size // TASK_BYTES)), *keys)


def listing(
    spark: SparkSession, path: str, hidden: bool = True, levels: int | None = None, skip_unreadable: bool = False
) -> DataFrame:
    """``DF(member, level, is_folder, length, modified)`` of all that lies below the folder ``path``.

    Breadth first: each round, tasks list the folders the round before found, and what they find is
    settled. ``member`` is the path below ``path``. Folders that are gone when their turn comes are
    left out, with ``skip_unreadable`` also those that may not be read, which fail otherwise.
    """
    located, out = locate(spark, path), scratch_dir(spark, "listing")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(located)
        for batch in batches:
            for above in batch.column(0).to_pylist():
                rows = []
                try:
                    for name, is_folder, length, modified in _entries(store, f"{root}/{above}".rstrip("/") or "/"):
                        if hidden or not is_hidden(name):
                            rows.append((f"{above}/{name}" if above else name, is_folder, length, modified))
                except FileNotFoundError:
                    continue
                except PermissionError:
                    if not skip_unreadable:
                        raise
                for begin in range(0, len(rows), 10_000):
                    members, kinds, lengths, times = zip(*rows[begin : begin + 10_000])
                    moments = pa.array([t and t // 1000 for t in times], pa.int64()).cast(pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(members, pa.string()), pa.array(kinds, pa.bool_()), pa.array(lengths, pa.int64()), moments],
                        names=["member", "is_folder", "length", "modified"],
                    )

    found = spark.read.schema(f"{_LISTED}, level int")
    folders, count, level = spark.createDataFrame([("",)], "member string"), 1, 0
    while count and (levels is None or level < levels):
        level += 1
        _dealt(folders, count, 0, "member").mapInArrow(task, _LISTED).write.parquet(f"{out}/level={level}")
        folders = spark.read.schema(_LISTED).parquet(f"{out}/level={level}").where("is_folder").select("member")
        count = folders.count()
    return found.parquet(out).select("member", "level", "is_folder", "length", "modified")


def list_files(
    spark: SparkSession, path: str, hidden: bool = True, levels: int | None = None, skip_unreadable: bool = False
) -> DataFrame:
    """``DF(path, member, length, modified)`` of the files below a folder, or of the one file ``path``."""
    located = locate(spark, path)
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = name.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(name)
    if status.isFile():
        row = (located, located.rpartition("/")[2], status.getLen(), status.getModificationTime())
        one = spark.createDataFrame([row], "path string, member string, length bigint, modified bigint")
        return one.withColumn("modified", F.timestamp_millis("modified"))
    found = listing(spark, path, hidden, levels, skip_unreadable).where("NOT is_folder")
    return found.select(F.concat(F.lit(f"{located}/"), "member").alias("path"), "member", "length", "modified")


def read_contents(files: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """``files(path, length, ...)``, listed or chosen from a list, with their ``content``.

    With ``part_bytes`` a row is a part of a file, numbered by ``part`` of ``parts``, and ``entry``
    tells the files apart; so files of any length pass. A file that is not of its length any more is
    an error that names it.
    """
    if part_bytes is not None:
        if part_bytes < 1:
            raise ValueError("parts need at least one byte")
        parts = F.greatest(F.ceil(F.col("length") / part_bytes), F.lit(1)).cast("int")
        files = files.withColumn("entry", F.xxhash64("path")).withColumn("parts", parts)
        files = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    weight = F.col("length") if part_bytes is None else F.least("length", F.lit(part_bytes))
    rows, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    names = files.columns
    at = {name: names.index(name) for name in ("path", "length", *(("part",) if part_bytes else ()))}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lengths = batch.column(at["path"]).to_pylist(), batch.column(at["length"]).to_pylist()
            numbers = batch.column(at["part"]).to_pylist() if part_bytes else [0] * len(paths)
            begin, held, contents = 0, 0, []
            for row, (path, length, number) in enumerate(zip(paths, lengths, numbers)):
                store, inner = _open(path)
                with store.open_input_file(inner) as handle:
                    if handle.size() != length:
                        raise OSError(f"{path} had {length} bytes when it was listed and has {handle.size()} now")
                    handle.seek(number * part_bytes if part_bytes else 0)
                    contents.append(handle.read(part_bytes or length))
                held += len(contents[-1])
                if held >= BATCH_BYTES or row == len(paths) - 1:
                    columns = [*batch.slice(begin, row + 1 - begin).columns, pa.array(contents, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "content"])
                    begin, held, contents = row + 1, 0, []

    schema = files.limit(0).withColumn("content", F.lit(b"")).schema
    keys = ("path", "part") if part_bytes else ("path",)
    return _dealt(files, rows, int(size), *keys).mapInArrow(task, schema)


def write_files(members: DataFrame, path: str) -> int:
    """Write ``members(member, content)`` as files below ``path``; returns the number of rows.

    With a column ``part`` a file is put together from its parts, numbered from 0, one at a time.
    Files of the same names are replaced; a file is written aside and then moved, so a task that is
    run again does no harm. NULL content makes an empty file. Members that are called alike, or
    would lie outside ``path``, are refused before anything is written.
    """
    spark = members.sparkSession
    keys = ["member", "part"] if "part" in members.columns else ["member"]
    outside = F.exists(F.split("member", "/"), lambda step: step.isin("", ".", ".."))
    counted = members.groupBy(*keys).count().withColumn("outside", F.coalesce(outside, F.lit(True)))
    if bad := counted.where("outside OR count > 1").orderBy(F.desc("outside")).first():
        if bad["outside"]:
            raise ValueError(f"{bad['member']!r} is no name of a file below a folder")
        raise ValueError(f"{bad['member']!r} is the name of {bad['count']} members")
    located = locate(spark, path)
    aside = f"{located}._writing-{uuid.uuid4().hex}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a folder of the task's own, as tasks that add to one folder wait for each other
        (store, root), (_, temporary) = _open(located), _open(f"{aside}/{uuid.uuid4().hex}")
        store.create_dir(temporary, recursive=True)
        open_file, written, member, following, made = None, "", None, 0, set()

        def finish() -> None:
            if open_file is not None:
                open_file.close()
                target = f"{root}/{member}"
                if (folder := target.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                store.move(written, target)

        for batch in batches:
            numbers = batch.column(2).to_pylist() if len(keys) > 1 else [0] * batch.num_rows
            for name, content, number in zip(batch.column(0).to_pylist(), batch.column(1), numbers):
                if name != member:
                    finish()
                    member, following, written = name, 0, f"{temporary}/{uuid.uuid4().hex}"
                    open_file = store.open_output_stream(written, compression=None)
                if number != following:
                    raise ValueError(f"{member!r} has no part {following}")
                open_file.write(content.as_py() or b"")
                following += 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        finish()

    rows = members.select("member", "content", *keys[1:])
    if len(keys) > 1:
        rows = rows.repartition("member").sortWithinPartitions(*keys)
    count = rows.mapInArrow(task, "n bigint").agg(F.sum("n")).first()[0]
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(aside)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return count or 0


def delete_folders(folders: DataFrame, path: str) -> int:
    """Delete the folders ``member`` below ``path``, with all in them, by tasks; returns their number.

    ``folders`` must not change while its folders go: pass a settled table. One that is gone already
    is no error, so tasks that are run again do no harm.
    """
    located = locate(folders.sparkSession, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(located)
        for batch in batches:
            for member in batch.column(0).to_pylist():
                if any(step in ("", ".", "..") for step in member.split("/")):
                    raise ValueError(f"{member!r} is no folder below {located}")
                try:
                    if isinstance(store, fs.LocalFileSystem):
                        shutil.rmtree(f"{root}/{member}")
                    else:
                        store.delete_dir(f"{root}/{member}")
                except FileNotFoundError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    gone = _dealt(folders.select("member"), folders.count(), 0, "member").mapInArrow(task, "n bigint")
    return gone.agg(F.sum("n")).first()[0] or 0
