"""Prefix trie of conversations: ROLLUP over turn columns, block after block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import settle
from tablekeep.plans.sliced import running_sum, slice_rows

#: Turns of a block, one column each.
WIDTH = 8
#: Ids, as text, that are put in order and joined by one task.
JOINED_BYTES = 1 << 21
TURNS = [f"t{j}" for j in range(WIDTH)]


def numbered(turns: DataFrame) -> DataFrame:
    """Rows ``(conv, at, turn_id, size)``: the place of each turn from 1 and the bytes of its text.

    Turns are in order of ``turn``, null first, then of role and text. Null roles and texts count
    as empty; rows without ``conv_id`` are left out. A conversation may be of any length.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["turn", "role", "text"]
    rows = slice_rows(rows, ["conv", *order], F.octet_length("role") + F.octet_length("text") + 16)
    placed = running_sum(rows, ["conv"], order, "_slice", F.lit(1), "at")
    return placed.select("conv", F.col("at").cast("long").alias("at"), F.xxhash64("role", "text").alias("turn_id"), F.octet_length("text").cast("long").alias("size"))


def rebuilt(placed: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Rows ``(conv, at, turn_id, size)`` of conversations that begin like another one, and one without ``at`` each.

    Conversation c takes the first h turns of c - c % ``group``, then its own after its first h,
    with h the crc32 of c in decimal digits modulo ``most`` + 1.
    """
    heads = settle(placed.where(F.col("at") <= most), "first-turns")
    convs = placed.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % group)
    sizes = heads.groupBy("conv").agg(F.count("*").alias("first")).withColumnRenamed("conv", "base")
    convs = settle(convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("first", F.lit(0)))).drop("first"), "rebuilt-from")
    taken = convs.where("taken > 0").join(heads.withColumnRenamed("conv", "base"), "base").where("at <= h")
    own = placed.join(convs, "conv").where("at > h").withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    nothing = convs.select("conv", *[F.lit(None).cast("long").alias(c) for c in ("at", "turn_id", "size")])
    return taken.select("conv", "at", "turn_id", "size").unionAll(own.select("conv", "at", "turn_id", "size")).unionAll(nothing)


def _blocks(turns: DataFrame) -> DataFrame:
    """A row per conversation and block: its turns as columns, the node it starts from, and bytes before each turn.

    A node at a block's start is named by the sum of hashes of the blocks before, so all blocks
    are keyed at once, however long a conversation is.
    """
    at = F.col("at") - 1
    here = [F.max(F.when(at % WIDTH == j, F.col("turn_id"))).alias(f"t{j}") for j in range(WIDTH)]
    sizes = [F.max(F.when(at % WIDTH == j, F.col("size"))).alias(f"s{j}") for j in range(WIDTH)]
    placed = turns.withColumn("block", F.coalesce(F.floor(at / WIDTH), F.lit(0)).cast("int"))
    blocks = placed.groupBy("conv", "block").agg(*here, *sizes)
    blocks = blocks.withColumn("named", F.xxhash64("block", *TURNS).cast("decimal(38,0)"))
    blocks = blocks.withColumn("bytes", sum((F.coalesce(f"s{j}", F.lit(0)) for j in range(WIDTH)), F.lit(0).cast("long")))
    blocks = slice_rows(blocks, ["conv", "block"], F.lit(160))
    for value in ("named", "bytes"):
        blocks = running_sum(blocks, ["conv"], ["block"], "_slice", F.col(value), f"{value}_before")
    before = F.col("bytes_before") - F.col("bytes")
    blocks = blocks.withColumn("start", (F.col("named_before") - F.col("named")).cast("decimal(38,0)"))
    for j in range(WIDTH):
        blocks = blocks.withColumn(f"b{j}", before)
        before = before + F.coalesce(f"s{j}", F.lit(0))
    return settle(blocks.select("conv", "block", "start", "bytes", *TURNS, *[f"b{j}" for j in range(WIDTH)]), "turn-blocks")


def _node(level: int) -> Column:
    """The name of the node after ``level`` turns of a block; that after all is where the next block starts."""
    if level == WIDTH:
        end = (F.col("start") + F.xxhash64("block", *TURNS).cast("decimal(38,0)")).cast("decimal(38,0)")
        return F.xxhash64((F.col("block") + 1).cast("int"), end)
    return F.xxhash64("block", "start", F.lit(level), *TURNS[:level]) if level else F.xxhash64("block", "start")


def _chosen(level: Column, values: list[Column]) -> Column:
    chosen = F.when(level == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        chosen = chosen.when(level == i, value)
    return chosen


def _rolled_up(blocks: DataFrame, measures: str) -> DataFrame:
    """Rows ``(node, parent, depth, ...measures)``: all prefixes of all blocks in one aggregation."""
    turns = ", ".join(TURNS)
    rolled = blocks.sparkSession.sql(
        f"SELECT block, start, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, {measures} FROM {{blocks}} GROUP BY block, start, ROLLUP ({turns})",
        blocks=blocks,
    )
    level = F.col("level")
    last = _chosen(level, [F.when(F.col("block") == 0, F.lit(0).cast("long")), *[F.col(t) for t in TURNS]])
    real = rolled.where(last.isNotNull())
    return (
        real.withColumn("node", _chosen(level, [_node(i) for i in range(WIDTH + 1)]))
        .withColumn("parent", _chosen(level, [F.lit(None).cast("long"), *[_node(i) for i in range(WIDTH)]]))
        .withColumn("depth", (F.col("block") * WIDTH + level).cast("long"))
        .drop("block", "start", *TURNS)
    )


def _ends(blocks: DataFrame) -> DataFrame:
    """Rows ``(node, ends_sha256)``: the ids of the conversations that end in a node, in order, joined and hashed.

    Ids are put in order in slices, whatever node has them; a slice gives one text per node, and
    the texts of a node are hashed one after the other.
    """
    level = sum((F.col(t).isNotNull().cast("int") for t in TURNS), F.lit(0))
    last = blocks.groupBy("conv").agg(F.max("block").alias("block"))
    ends = blocks.join(last, ["conv", "block"]).select(_chosen(level, [_node(i) for i in range(WIDTH + 1)]).alias("node"), "conv")
    slices = slice_rows(ends, ["node", "conv"], F.octet_length(F.col("conv").cast("string")) + 1, JOINED_BYTES)
    texts = slices.groupBy("node", "_slice").agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for frame in frames:
            done = []
            for name, ids in zip(frame["node"].tolist(), frame["ids"], strict=True):
                if name == node:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    done.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if digest:
            yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends_sha256"])

    return texts.repartition("node").sortWithinPartitions("node", "_slice").select("node", "ids").mapInPandas(task, "node long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in ``(conv, at, turn_id, size)``.

    ``conv`` names a conversation, ``at`` the place of a turn from 1 without gaps; a row without
    ``at`` is a conversation that may have no turns. Returns ``conv_id`` (the smallest that begins
    with the prefix), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (nodes without children in the subtree, itself included),
    ``saved_tokens`` (over the subtree, bytes of a node's last turn for each conversation but one)
    and ``ends_sha256`` (of the ids that end there, ascending, joined by commas). No conversations
    give no rows.

    Sums over subtrees are sums over the conversations of a node: a node belongs to its smallest
    conversation, which then owns all nodes from there to its end.
    """
    blocks = _blocks(turns)
    before = ", ".join(f"min(b{j}) AS b{j}" for j in range(WIDTH))
    nodes = _rolled_up(blocks, f"count(*) AS n_convs, min(conv) AS conv_id, {before}")
    nodes = nodes.withColumn("before", _chosen(F.col("level"), [F.lit(0).cast("long"), *[F.col(f"b{j}") for j in range(WIDTH)]]))
    nodes = settle(nodes.select("node", "parent", "depth", "n_convs", "conv_id", "before"), "prefix-nodes")
    children = settle(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")), "children")
    nodes = nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    owned = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "before"))["before"].alias("before"), F.max(F.struct("depth", (F.col("n_children") == 0).cast("long").alias("leaf")))["leaf"].alias("leaf")
    )
    totals = blocks.groupBy("conv").agg(F.sum("bytes").alias("total"))
    convs = totals.join(owned.withColumnRenamed("conv_id", "conv"), "conv", "left").select(
        "conv", "total", F.coalesce(F.col("total") - F.col("before"), F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    convs = settle(convs, "owned-bytes")
    sums = _rolled_up(blocks.join(convs, "conv"), "sum(total) AS totals, sum(own) AS owns, sum(leaf) AS n_leaves").select("node", "totals", "owns", "n_leaves")

    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = (
        nodes.join(settle(sums, "subtree-sums"), "node")
        .join(convs.select(F.col("conv").alias("conv_id"), "total", "own"), "conv_id")
        .join(settle(parents, "parents"), "parent", "left")
        .join(settle(_ends(blocks), "ends"), "node", "left")
    )
    shared = F.col("totals") - F.col("n_convs") * F.col("before")
    single = F.col("owns") - F.col("own") + F.col("total") - F.col("before")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (shared - single).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table with ``conv_id``, ``turn``, ``role`` and ``text``.

    Rows without ``conv_id`` are left out, null roles and texts are empty, repeated rows are
    turns of their own, and other columns are not read. An empty table gives an empty result.
    """
    placed = settle(numbered(turns), "numbered-turns")
    return trie(rebuilt(placed))
