"""Packing many small files into few large shards.

A packed dataset is Parquet with a folder per archive and the columns
``member STRING, length BIGINT, content BINARY``.

An indexed pack has shards of bounded bytes in the order of members, long members in numbered
parts, and an index that says which shard has which part. A few members are then read from a
few shards, however large the pack.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.functions.globs import include_glob
from tablekeep.operators.dump import number_by_bytes
from tablekeep.plans.settled import settle
from tablekeep.sources.files import names_in
from tablekeep.sources.stores import list_files, read_contents, write_files

PACK_COLUMNS = ["archive", "member", "length", "content"]
_SCHEMA = "member string, length bigint, content binary, archive string"

SHARD_BYTES = 256 * 1024**2
PART_BYTES = 64 * 1024**2
_PARTS = "archive string, member string, entry bigint, part int, parts int, length bigint, content binary"
_INDEX = "archive string, member string, entry bigint, part int, parts int, length bigint, shard string"


def read_files(spark: SparkSession, path: str, hidden: bool = True, part_bytes: int | None = None) -> DataFrame:
    """The files below ``path`` with their contents, empty and hidden ones too, ready to be packed.

    Tasks list and read them. With ``part_bytes`` a row holds a part of a file, for
    ``pack_indexed``, and files may be of any length.
    """
    return read_contents(list_files(spark, path, hidden).drop("modified"), part_bytes).drop("path")


def unpack(members: DataFrame, path: str) -> int:
    """Write whole members, or the parts ``pack_parts`` returns, as files below ``path``.

    Returns the number of rows written. Members of one name are refused.
    """
    return write_files(members, path)


def text_members(texts: DataFrame) -> DataFrame:
    """``DF(archive, member, text)`` as members."""
    return texts.select(
        "archive",
        "member",
        F.octet_length("text").cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )


def pack(inventory: DataFrame, archive: Column | str, root: str, extra: DataFrame | None = None) -> None:
    """Write files, and texts from ``extra(archive, member, text)``, into shards.

    Each archive is gathered into few files; a large one is split over several tasks.
    """
    _members(inventory, archive, extra).hint("rebalance", "archive").write.partitionBy("archive").parquet(root)


def _members(inventory: DataFrame, archive: Column | str, extra: DataFrame | None) -> DataFrame:
    column = F.col(archive) if isinstance(archive, str) else archive
    members = inventory.select(column.alias("archive"), "member", "length", "content")
    return members if extra is None else members.unionByName(text_members(extra))


def packed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(root).select(*PACK_COLUMNS)


def pack_list(spark: SparkSession, root: str) -> DataFrame:
    """``DF(archive, member, length)``; contents are not read."""
    return packed(spark, root).drop("content")


def pack_extract(
    spark: SparkSession, root: str, members: list[str], archives: list[str] | None = None
) -> DataFrame:
    """Members by name or glob. Archives that do not match are not opened."""
    wanted = include_glob("member", *members)
    if archives is not None:
        wanted = wanted & include_glob("archive", *archives)
    return packed(spark, root).where(wanted)


def _cut(members: DataFrame, part_bytes: int) -> DataFrame:
    """Members as numbered parts."""
    parts = F.greatest(F.ceil(F.octet_length("content") / part_bytes), F.lit(1)).cast("int")
    cut = members.withColumn("entry", F.monotonically_increasing_id()).withColumn("parts", F.coalesce(parts, F.lit(1)))
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    piece = F.substring("content", F.col("part") * part_bytes + 1, F.lit(part_bytes))
    return cut.select("archive", "member", "entry", "part", "parts", "length", F.coalesce(piece, F.lit(b"")).alias("content"))


def pack_indexed(
    inventory: DataFrame,
    archive: Column | str,
    root: str,
    extra: DataFrame | None = None,
    shard_bytes: int = SHARD_BYTES,
    part_bytes: int = PART_BYTES,
) -> None:
    """Write files, and texts from ``extra(archive, member, text)``, as an indexed pack.

    Shards follow the order of archive and member; each has ``shard_bytes`` of contents and less
    than one part more, and they lie on shelves, folders of one shard from each task. Members longer than ``part_bytes`` are cut into parts, which may lie in
    several shards. ``entry`` tells members of one name apart. A member without content counts as
    empty. The index is written last: a pack without one is not finished. An inventory that holds
    parts already, from ``read_files(part_bytes=...)``, is taken as it is, so that no file has to
    fit into a row.
    """
    if shard_bytes < 1 or part_bytes < 1:
        raise ValueError("shards and parts need at least one byte")
    if "part" in inventory.columns:
        column = F.col(archive) if isinstance(archive, str) else archive
        rows = inventory.select(column.alias("archive"), "member", "entry", "part", "parts", "length", "content")
        rows = rows if extra is None else rows.unionByName(_cut(text_members(extra), part_bytes))
    else:
        rows = _cut(_members(inventory, archive, extra), part_bytes)
    shards, count, order, number = number_by_bytes(
        rows, shard_bytes, ["archive", "member", "entry", "part"], F.octet_length("content")
    )
    # a task writes a run of shards, one into each shelf, so that neither tasks nor folders are as many as shards
    run = max(1, min(math.isqrt(count - 1), SHARD_BYTES // shard_bytes))
    shards = shards.repartitionById(-(-count // run), F.call_function("div", number, F.lit(run)).cast("int"))
    shards = shards.withColumn("shelf", (F.col(number) % run).cast("int")).sortWithinPartitions("shelf", *order)
    shards.select(*rows.columns, "shelf").write.option("parquet.bloom.filter.enabled#member", "true").partitionBy("shelf").parquet(f"{root}/shards")
    written = _shards(inventory.sparkSession, root, f"{root}/shards")
    index = settle(written.drop("content").withColumn("shard", F.substring_index("_metadata.file_path", "/", -2)), "pack-index")
    index.repartitionByRange("member", "archive").sortWithinPartitions("member", "archive", "entry", "part").write.option(
        "parquet.bloom.filter.enabled#member", "true"
    ).parquet(f"{root}/index")


def _shards(spark: SparkSession, root: str, *paths: str) -> DataFrame:
    """The parts in all shards, or in those of ``paths``."""
    return spark.read.schema(_PARTS).option("basePath", f"{root}/shards").parquet(*paths).drop("shelf")


def pack_index(spark: SparkSession, root: str) -> DataFrame:
    """``DF(archive, member, entry, part, parts, length, shard)`` of an indexed pack; shards are not opened."""
    if "_SUCCESS" not in names_in(spark, f"{root}/index"):
        raise FileNotFoundError(f"{root} holds no finished pack with an index")
    return spark.read.schema(_INDEX).parquet(f"{root}/index")


def pack_parts(
    spark: SparkSession,
    root: str,
    members: Sequence[str] = (),
    archives: Sequence[str] | None = None,
    names: Sequence[str] = (),
) -> DataFrame:
    """The parts of members that match a glob of ``members`` or are called one of ``names`` exactly.

    Only shards that hold such a part are opened. Exact names are looked up by the index's sorted
    names and Bloom filters, globs by reading its names.
    """
    wanted = include_glob("member", *members) if members else F.lit(False)
    if names:
        wanted = F.col("member").isin(*names) | wanted if members else F.col("member").isin(*names)
    if archives is not None:
        wanted = wanted & include_glob("archive", *archives)
    found = pack_index(spark, root).groupBy("shard").agg(F.max(F.coalesce(wanted, F.lit(False))).alias("wanted"))
    if not (holding := found.agg(F.max("wanted").alias("some"), F.min("wanted").alias("each")).first())["some"]:
        return spark.createDataFrame([], _PARTS)
    if holding["each"]:  # no list of shards, each of which Spark would look up by itself
        return _shards(spark, root, f"{root}/shards").where(wanted)
    names_of = found.where("wanted").select("shard")
    return _shards(spark, root, *(f"{root}/shards/{row['shard']}" for row in names_of.toLocalIterator())).where(wanted)


def whole_members(parts: DataFrame) -> DataFrame:
    """``DF(archive, member, entry, length, content)`` put together from all parts of members that fit into a row."""
    pieces = F.sort_array(F.collect_list(F.struct("part", "content")))
    content = F.aggregate(pieces, F.lit(b""), lambda whole, piece: F.concat(whole, piece["content"]))
    return parts.groupBy("archive", "member", "entry").agg(F.first("length").alias("length"), content.alias("content"))
