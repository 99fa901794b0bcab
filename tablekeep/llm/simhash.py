"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import group_bounds, settle, unused, whole_groups
from tablekeep.llm.graph import components

BITS = 64
SEED = 42
#: Shingles hashed before their bits are counted; bounds the memory of a very long text.
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints compared with each other at once; larger buckets are cut into tiles.
TILE_ROWS = 1024


def _word_spans(text: bytes, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each shingle of ``width`` words begins and ends."""
    words = text.lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) <= width:
        return joined, starts[:1], ends[-1:]
    return joined, starts[: len(words) - width + 1], ends[width - 1 :]


def fingerprint(text: bytes | None, width: int) -> int:
    """The SimHash of one text as a signed 64-bit number: bits set in over half the shingles' hashes.

    Lower-cases A to Z only and parts words at ASCII white space. Repeated shingles count each
    time. Fewer words than ``width`` are one shingle; no words, an empty or null text give 0.
    """
    if not text or text.isspace():
        return 0
    joined, starts, ends = _word_spans(text, width)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        spans = zip(starts[at : at + SHINGLES_AT_ONCE].tolist(), ends[at : at + SHINGLES_AT_ONCE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, fp, mark)``, one for each row of ``docs``; ``mark`` is a hash of id and text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2)], names=["id", "fp", "mark"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(id_col, text_col).alias("mark"))
    return texts.mapInArrow(task, "id long, fp long, mark long")


def block_masks(max_distance: int, blocks: int) -> list[int]:
    """Masks such that two fingerprints at most ``max_distance`` bits apart agree under one of them.

    The bits are cut into ``blocks``; so many differing bits spoil as many blocks at most, and
    the others agree. One mask for each choice of the blocks that agree.
    """
    if not 0 <= max_distance < blocks <= BITS:
        raise ValueError("there must be more blocks than bits that may differ")
    borders = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(borders, borders[1:], strict=False)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_distance)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _forest(fps: np.ndarray, cross: np.ndarray | None, max_distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``fps``; with ``cross``, between both sides only."""
    unseen, edges = np.arange(len(fps)), []
    while len(unseen):
        waiting, unseen = [unseen[0]], unseen[1:]
        while waiting and len(unseen):
            node = waiting.pop()
            near = np.bitwise_count(fps[unseen] ^ fps[node]) <= max_distance
            if cross is not None:
                near &= cross[unseen] != cross[node]
            found, unseen = unseen[near], unseen[~near]
            edges += [(node, other) for other in found.tolist()]
            waiting += found.tolist()
    return edges


def links(reps: DataFrame, max_distance: int, blocks: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect all rows ``(fp, rep)`` at most ``max_distance`` bits apart.

    Each fingerprint is entered in a bucket for each mask. A bucket of two is a pair to verify.
    Of a larger bucket the rows are dealt into tiles, and each pair of tiles, a bounded group,
    yields a spanning forest of its verified links: never all pairs, and none lost.
    """
    masks = [_signed(mask) for mask in block_masks(max_distance, blocks)]
    entries = reps.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("e")
    ).select("e.t", "e.key", "fp", "rep")
    entry = F.struct("fp", "rep")
    buckets = entries.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(entry).alias("lo"), F.max(entry).alias("hi"))
    buckets = settle(buckets.where("n > 1"), "buckets")
    apart = F.bit_count(F.col("lo.fp").bitwiseXOR(F.col("hi.fp")))
    pairs = buckets.where((F.col("n") == 2) & (apart <= max_distance)).select(F.col("lo.rep").alias("a"), F.col("hi.rep").alias("b"))

    tiles = F.ceil(F.col("n") / tile_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    keys = ["t", "key", "i", "j"]
    tiled = (
        entries.join(buckets.where("n > 2").select("t", "key", tiles.alias("tiles")), ["t", "key"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "rep")
    )

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            fps, rep, side = frame["fp"].to_numpy().view(np.uint64), frame["rep"].to_numpy(), frame["own"].to_numpy()
            within = (frame["i"] == frame["j"]).to_numpy()
            bounds, edges = group_bounds(frame, keys), []
            for begin, end in zip(bounds, bounds[1:], strict=False):
                cross = None if within[begin] else side[begin:end]
                edges += [(begin + a, begin + b) for a, b in _forest(fps[begin:end], cross, max_distance)]
            at = np.array(edges, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": rep[at[:, 0]], "b": rep[at[:, 1]]})

    forest = tiled.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(task, "a long, b long")
    return pairs.unionAll(forest)


def near_duplicates(
    docs: DataFrame, width: int = 3, max_distance: int = 3, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows ``(<id_col>, fingerprint, component_id)``, one for each row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id reachable over
    links of at most ``max_distance`` differing bits, itself included. Null and empty texts have
    fingerprint zero and are linked like any other. A row without id is fingerprinted but takes
    no part in components: its ``component_id`` is null. Repeated rows stay. Other columns are
    not read. An empty table gives an empty result.
    """
    return _classes(docs, width, max_distance, blocks, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("smallest")).alias("component_id"),
    )


def _classes(docs: DataFrame, width: int, max_distance: int, blocks: int | None, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, fp, mark, class, smallest)``, one for each row of ``docs``; a class is a component of fingerprints."""
    prints = settle(fingerprints(docs, width, id_col, text_col), "fingerprints")
    known = settle(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least")), "known-fingerprints")
    joined = components(links(known.select("fp", F.col("fp").alias("rep")), max_distance, blocks or max_distance + 3))
    classes = known.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    classes = settle(classes, "classes")
    least = settle(classes.groupBy("class").agg(F.min("least").alias("smallest")), "smallest-ids")
    named = settle(classes.join(least, "class").select("fp", "class", "smallest"), "named-classes")
    return prints.join(named, "fp", "left").select("id", "fp", "mark", "class", "smallest")


def deduplicated(docs: DataFrame, width: int = 3, max_distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all its columns.

    Rows of one id are told apart by their texts: only linked ones go. Of several with the
    smallest id that of the smallest fingerprint stays, and one row of those equal in id and text.
    Rows without id belong to no component and stay.
    """
    found = _classes(docs, width, max_distance, None, id_col, text_col).where("id IS NOT NULL")
    keep = found.groupBy("class").agg(F.min(F.struct("id", "fp", "mark"))["mark"].alias("kept"))
    mark = unused(docs, "own_mark")
    marked = docs.withColumn(mark, F.xxhash64(id_col, text_col))
    keep = settle(keep.select(F.col("kept").alias(mark)).distinct(), "kept")
    named = marked.join(keep, mark, "left_semi").where(F.col(id_col).isNotNull()).dropDuplicates([mark]).drop(mark)
    return reduce(DataFrame.unionByName, [named, docs.where(F.col(id_col).isNull())])
