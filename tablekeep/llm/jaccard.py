"""Jaccard join on word n-grams: rare-first prefixes, length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import group_bounds, mix64, settle, text_slices, whole_groups
from tablekeep.llm.graph import components
from tablekeep.session import shuffle_partitions

#: Odd multipliers of the words of a shingle, and what is added per word.
FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Shingles that may be held to be frequent; a summary of so many counters misses none above total / HEAVY.
HEAVY = 1 << 16
#: Shingles that one task counts, on average.
PART_SHINGLES = 1 << 22
#: Text that is sent to the counting tasks together.
SLICE_BYTES = 1 << 20
#: Documents, and shingles of documents, compared with each other at once.
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 21
#: Buckets in which the suffix filter counts shingles.
BUCKETS = 64
#: Rounds in which documents that share one drawn prefix shingle are compared before all others.
ROUNDS = 3


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text; a text of fewer words is one shingle.

    Lower-cases A to Z only, parts words at ASCII white space. Null, empty and blank texts have none.
    """
    pieces = [(text.as_py() or b"").lower().split() for text in texts]
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in pieces])]).astype(np.int64)
    coded = pa.array([word for words in pieces for word in words], pa.binary()).dictionary_encode()
    spelled = np.array([xxhash.xxh64_intdigest(word) for word in coded.dictionary.to_pylist()], np.uint64)
    words = spelled[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else spelled
    with np.errstate(over="ignore"):
        full = max(0, len(words) - width + 1)
        rolled = np.full(full, width, np.uint64)
        for k in range(width):
            rolled += words[k : k + full] * FACTORS[k]
        rolled, sets = mix64(rolled), []
        for begin, end in zip(bounds, bounds[1:], strict=False):
            if end - begin >= width:
                sets.append(np.unique(rolled[begin : end - width + 1]))
            else:
                few = words[begin:end]
                sets.append(mix64(np.array([len(few) + (few * FACTORS[: len(few)]).sum()], np.uint64)) if len(few) else few)
    return sets


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name for a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        return int(mix64(mix64(shingles + np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


class FrequentValues:
    """Counters of the most frequent values: after any input each is too low by total / ``size`` at most.

    The summary of Misra and Gries: when there are too many counters, the same number is taken
    from all, and those that reach zero go.
    """

    def __init__(self, size: int):
        self.size, self.values, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        seen, counts = np.unique(values, return_counts=True)
        merged, places = np.unique(np.concatenate([self.values, seen]), return_inverse=True)
        sums = np.bincount(places, np.concatenate([self.counts, counts]), len(merged)).astype(np.int64)
        if len(merged) > self.size:
            sums -= np.partition(sums, -self.size - 1)[-self.size - 1]
        self.values, self.counts = merged[sums > 0], sums[sums > 0]


def _named_sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows ``(id, n, name)`` per document, and ``(n, name)`` for each shingle that a task found ``frequent``."""

    def rows(frequent: bool, ids: pa.Array | list, ns: list | np.ndarray, names: list | np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([frequent] * len(ns), pa.bool_()), ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ns, pa.int64()), pa.array(names, pa.int64())], names=["frequent", "id", "n", "name"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = FrequentValues(HEAVY)
        for batch in batches:
            for part in text_slices(batch, 1):
                sets = shingle_sets(part.column(1), width)
                frequent.add(np.concatenate(sets))
                yield rows(False, part.column(0), [len(s) for s in sets], [set_name(s) if len(s) else None for s in sets])
        yield rows(True, [None] * len(frequent.values), frequent.counts, frequent.values.view(np.int64))

    return texts.mapInArrow(task, "frequent boolean, id long, n long, name long")


def _dealt_shingles(texts: DataFrame, width: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """Shingles of slices of documents, dealt by hash to ``parts``: a row per slice and part.

    A slice also gives one row that names its documents and holds their frequent shingles as
    places in ``frequent``; that row keeps ``docs`` and goes to any part.
    """
    ranked = np.argsort(frequent)
    ordered = frequent[ranked]

    def row(part: int, piece: int, docs: bytes | None, sizes: bytes | None, idx: np.ndarray, values: np.ndarray) -> tuple:
        return part, piece, docs, sizes, idx.astype("<u2").tobytes(), values.tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, 0, SLICE_BYTES):
                sets = [s for s in shingle_sets(piece.column(0), width) if len(s)]
                if not sets:
                    continue
                names, ns = np.array([set_name(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int64)
                idx, values = np.repeat(np.arange(len(sets)), ns), np.concatenate(sets)
                at = np.minimum(np.searchsorted(ordered, values), max(len(ordered) - 1, 0))
                known = ordered[at] == values if len(ordered) else np.zeros(len(values), bool)
                number = xxhash.xxh64_intdigest(names.tobytes()) >> 1
                out = [row(number % parts, number, names.tobytes(), ns.tobytes(), idx[known], ranked[at[known]].astype("<i4"))]
                idx, values = idx[~known], values[~known]
                part = (values >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                idx, values, part = idx[order], values[order], part[order].astype(np.int64)
                begins = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                out += [row(int(part[a]), number, None, None, idx[a:b], values[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                names = ["part", "slice", "docs", "sizes", "idx", "vals"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(task, "part int, slice long, docs binary, sizes binary, idx binary, vals binary")


def _counted(dealt: DataFrame) -> DataFrame:
    """The same rows with shingles of two documents or more only, and their counts; those naming documents as they were."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, ["part"]):
            for part, frame in group.groupby("part", sort=False):
                whole = frame["docs"].notna()
                if whole.any():
                    yield frame[whole].assign(counts=None)
                frame = frame[~whole]
                if frame.empty:
                    continue
                values = [np.frombuffer(v, np.uint64) for v in frame["vals"]]
                bounds = np.cumsum([0, *map(len, values)])
                _, places, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
                found, kept = counts[places], []
                for piece, idx, vals, a, b in zip(frame["slice"], frame["idx"], values, bounds, bounds[1:], strict=False):
                    keep = found[a:b] > 1
                    if keep.any():
                        kept.append((part, piece, None, None, np.frombuffer(idx, "<u2")[keep].tobytes(), vals[keep].tobytes(), found[a:b][keep].astype("<u4").tobytes()))
                if kept:
                    yield pd.DataFrame(kept, columns=["part", "slice", "docs", "sizes", "idx", "vals", "counts"])

    by_part = dealt.repartition("part").sortWithinPartitions("part")
    return by_part.mapInPandas(task, "part int, slice long, docs binary, sizes binary, idx binary, vals binary, counts binary")


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _candidates(counted: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """Rows ``(name, n, lone, shingles, buckets, homes)`` of the documents that can have a partner at all.

    ``shingles`` are those found in other documents too, rare first; ``lone`` is the number of
    all others, which come before them. A prefix of lone shingles meets nobody's, so its document
    goes. ``homes`` are shingles of the prefix, one drawn for each round.
    """
    keys = mix64(np.arange(101, 101 + ROUNDS, dtype=np.uint64))

    def rows(group: pd.DataFrame) -> Iterator[tuple]:
        named = group["docs"].notna()
        first = group[named].iloc[0]
        names, ns = np.frombuffer(first["docs"], np.int64), np.frombuffer(first["sizes"], np.int64)
        places = np.frombuffer(first["vals"], "<i4")
        # Equal slices, as of repeated rows, have one number and equal rows.
        rest = group[~named].drop_duplicates("part")
        idx = np.concatenate([np.frombuffer(v, "<u2") for v in [*rest["idx"], first["idx"]]])
        values = np.concatenate([*[np.frombuffer(v, np.uint64) for v in rest["vals"]], frequent[places]])
        counts = np.concatenate([*[np.frombuffer(v, "<u4").astype(np.int64) for v in rest["counts"]], (1 << 40) + places.astype(np.int64)])
        order = np.lexsort((values, counts, idx))
        values, bounds = values[order], np.concatenate([[0], np.cumsum(np.bincount(idx, minlength=len(names)))])
        lone = ns - np.diff(bounds)
        prefix = _prefix_length(ns, percent) - lone
        for doc in np.flatnonzero(prefix > 0):
            shingles = values[bounds[doc] : bounds[doc + 1]]
            head = shingles[: prefix[doc]]
            homes = [int(head[np.argmin(mix64(head ^ key))].view(np.int64)) for key in keys]
            buckets = np.bincount((shingles & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype("<i4")
            yield int(names[doc]), int(ns[doc]), int(lone[doc]), shingles.view(np.int64).tolist(), buckets.tobytes(), homes

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in whole_groups(frames, ["slice"]):
            for _, group in held.groupby("slice", sort=False):
                if found := list(rows(group)):
                    yield pd.DataFrame(found, columns=["name", "n", "lone", "shingles", "buckets", "homes"])

    by_slice = counted.repartition("slice").sortWithinPartitions("slice")
    found = by_slice.mapInPandas(task, "name long, n long, lone long, shingles array<long>, buckets binary, homes array<long>")
    return found.dropDuplicates(["name"])


def _most_apart(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two linked sets of ``sizes`` together may not share."""
    return (100 - percent) * sizes // (100 + percent)


def _forest(frame: pd.DataFrame, percent: int, earlier: list[str]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the documents of one tile, pairs of ``earlier`` cells aside."""
    n, lone = frame["n"].to_numpy(), frame["lone"].to_numpy()
    buckets = np.stack([np.frombuffer(b, "<i4") for b in frame["buckets"]])
    bounds = np.cumsum([0, *map(len, frame["shingles"])])
    _, codes = np.unique(np.concatenate(frame["shingles"].to_numpy()), return_inverse=True)
    cells = [frame[c].to_numpy() for c in earlier]
    mark, unseen, edges = np.zeros(codes.max(initial=0) + 1, bool), np.arange(len(frame)), []
    while len(unseen):
        waiting, unseen = [unseen[0]], unseen[1:]
        while waiting and len(unseen):
            node = waiting.pop()
            apart = lone[unseen] + lone[node] + np.abs(buckets[unseen] - buckets[node]).sum(axis=1)
            most = _most_apart(n[unseen] + n[node], percent)
            maybe = np.maximum(apart, np.abs(n[unseen] - n[node])) <= most
            for cell in cells:
                maybe &= cell[unseen] != cell[node]
            near, tried = np.zeros(len(unseen), bool), unseen[maybe]
            if len(tried):
                mark[codes[bounds[node] : bounds[node + 1]]] = True
                spans = [mark[codes[bounds[t] : bounds[t + 1]]].sum() for t in tried]
                mark[codes[bounds[node] : bounds[node + 1]]] = False
                near[maybe] = n[tried] + n[node] - 2 * np.array(spans) <= most[maybe]
            found, unseen = unseen[near], unseen[~near]
            edges += [(node, other) for other in found.tolist()]
            waiting += found.tolist()
    return edges


def _home_links(candidates: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified edges ``(a, b)`` inside tiles of documents with the same home, and each document's tiles ``c0, c1, ...``."""
    cells = candidates.select("name", "n", *[F.get("homes", F.lit(r)).alias(f"h{r}") for r in range(ROUNDS)])
    for r in range(ROUNDS):
        sizes = cells.groupBy(f"h{r}").agg(F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles"))
        cells = cells.join(settle(sizes, "homes"), f"h{r}").withColumn(f"c{r}", F.xxhash64(F.lit(r), f"h{r}", F.pmod(F.xxhash64("name", F.lit(r)), "tiles"))).drop(f"h{r}", "tiles")
    cells = settle(cells.drop("n"), "cells")

    def task_of(cell: str, earlier: list[str]):
        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group in whole_groups(frames, [cell]):
                names, bounds = group["name"].to_numpy(), group_bounds(group, [cell])
                for begin, end in zip(bounds, bounds[1:], strict=False):
                    if end - begin > 1:
                        at = np.array(_forest(group.iloc[begin:end], percent, earlier), np.int64).reshape(-1, 2) + begin
                        yield pd.DataFrame({"a": names[at[:, 0]], "b": names[at[:, 1]]})

        return task

    edges = []
    for r in range(ROUNDS):
        cell, earlier = f"c{r}", [f"c{q}" for q in range(r)]
        shared = cells.groupBy(cell).agg(F.count("*").alias("k")).where("k > 1").select(cell)
        ready = cells.select("name", cell, *earlier).join(settle(shared, "shared-cells"), cell).join(candidates.drop("homes"), "name")
        edges.append(ready.repartition(cell).sortWithinPartitions(cell).mapInPandas(task_of(cell, earlier), "a long, b long"))
    return reduce(DataFrame.unionAll, edges), cells


def _cross_pairs(candidates: DataFrame, cells: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of documents of different components that share a prefix shingle and pass all filters.

    The documents of a shingle are parted by length: partners lie in one class of lengths or in
    neighbouring ones. What is still more than a tile is dealt into tiles that meet in pairs.
    """
    kinds = [f"c{r}" for r in range(ROUNDS)]
    small = (
        cells.join(classes, cells["name"] == classes["node"], "left")
        .select("name", *kinds, F.coalesce("component", "name").alias("comp"))
        .join(candidates.select("name", "n", "lone", "buckets", _head(percent).alias("head")), "name")
    )
    entries = small.select("name", "comp", "n", "lone", "buckets", *kinds, F.posexplode("head").alias("at", "shingle"))
    entries = entries.withColumn("at", F.col("at") + F.col("lone")).withColumn("span", F.floor(F.log("n") / F.log(F.lit(100.0 / percent + 0.01))).cast("int"))
    entries = settle(entries, "prefixes")
    mixed = entries.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    entries = entries.join(settle(mixed, "mixed-shingles"), "shingle", "left_semi")
    entries = entries.withColumn("cell", F.explode(F.array(F.col("span"), F.col("span") - 1)))
    sizes = entries.groupBy("shingle", "cell").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"), F.count_if(F.col("span") == F.col("cell")).alias("own"))
    keys = ["shingle", "cell", "i", "j"]
    tiled = (
        entries.join(settle(sizes.where("own > 0"), "length-cells"), ["shingle", "cell"])
        .withColumn("tile", F.pmod(F.xxhash64("name"), "tiles").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("i", F.least("tile", "other"))
        .withColumn("j", F.greatest("tile", "other"))
        .select(*keys, "tile", "name", "comp", "n", "lone", "at", "span", "buckets", *kinds)
    )

    def pairs(frame: pd.DataFrame) -> Iterator[np.ndarray]:
        n, lone, at, comp, span, tile = (frame[c].to_numpy() for c in ("n", "lone", "at", "comp", "span", "tile"))
        done = [frame[c].to_numpy() for c in kinds]
        buckets = np.stack([np.frombuffer(b, "<i4") for b in frame["buckets"]])
        across, cell = frame["i"].iloc[0] != frame["j"].iloc[0], frame["cell"].iloc[0]
        for a in np.flatnonzero(span == cell):
            # A pair of this class twice would come twice; one with the next class has one order only.
            b = np.flatnonzero((comp != comp[a]) & ((span != cell) | (np.arange(len(n)) > a)))
            if across:
                b = b[tile[b] != tile[a]]
            most = _most_apart(n[b] + n[a], percent)
            # At the first prefix shingle they share, what follows it is all they can share.
            shared = np.minimum(n[b] - at[b], n[a] - at[a])
            keep = (np.abs(n[b] - n[a]) <= most) & (n[b] + n[a] - 2 * shared <= most)
            for cells_of in done:
                keep &= cells_of[b] != cells_of[a]
            b, most = b[keep], most[keep]
            if len(b):
                apart = lone[b] + lone[a] + np.abs(buckets[b] - buckets[a]).sum(axis=1)
                b = b[apart <= most]
                yield np.stack([np.full(len(b), a), b], axis=1)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, keys):
            bounds = group_bounds(group, keys)
            for begin, end in zip(bounds, bounds[1:], strict=False):
                frame = group.iloc[begin:end]
                names = frame["name"].to_numpy()
                for at in pairs(frame):
                    left, right = names[at[:, 0]], names[at[:, 1]]
                    yield pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)})

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(task, "a long, b long").distinct()


def _head(percent: int) -> Column:
    """The shingles of a candidate's prefix that other documents have too."""
    return F.slice("shingles", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("lone")).cast("int"))


def _verified(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shingles overlap enough, counted exactly."""
    sets = candidates.select("name", "n", "shingles")
    both = pairs.join(sets.toDF("a", "n_a", "s_a"), "a").join(sets.toDF("b", "n_b", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(<id_col>, n_shingles, component_id)``, one for each row of ``docs``.

    Two documents link when their sets of ``width``-word shingles share ``percent`` in a hundred
    of their union or more; ``component_id`` is the smallest id reachable over links, itself
    included. Lower-cases A to Z only and parts words at ASCII white space; fewer words than
    ``width`` are one shingle. Null, empty and blank texts have no shingles and no links. A row
    without id has its shingles counted but takes no part: its ``component_id`` is null. Repeated
    rows stay. Other columns are not read. An empty table gives an empty result.

    Documents of equal sets are one class, named by a hash of 64 bits, as shingles are. A class's
    shingles are counted over all documents and put in order, rare first. Linked sets share a
    shingle of their prefixes, so a class whose prefix nobody shares is done. The others meet
    first in ``ROUNDS`` groups drawn by a prefix shingle, which joins what is much alike, and then
    in all groups of a prefix shingle, where only pairs of different components are left; these
    pass the length, positional and suffix filters and are counted exactly, each once.
    """
    if not 0 < percent <= 100:
        raise ValueError("the percentage must be above 0 and at most 100")
    if not 0 < width <= len(FACTORS):
        raise ValueError(f"shingles have 1 to {len(FACTORS)} words")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = settle(_named_sets(texts, width), "shingle-sets")
    sets = found.where("NOT frequent").drop("frequent")
    reps = settle(sets.where("id IS NOT NULL AND name IS NOT NULL").groupBy("name").agg(F.min("id").alias("least")), "shingle-classes")
    total = sets.agg(F.sum("n")).first()[0] or 0
    often = found.where("frequent").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total / HEAVY))
    # At most HEAVY rows: their counts add up to the total at most.
    frequent = np.array([r[0] for r in often.orderBy("n", "name").select("name").collect()], np.int64).view(np.uint64)

    parts = max(2 * shuffle_partitions(docs.sparkSession), -(-total // PART_SHINGLES))
    counted = _counted(_dealt_shingles(texts.where("id IS NOT NULL").select("text"), width, frequent, int(parts)))
    candidates = settle(_candidates(counted, frequent, percent), "prefix-candidates")
    edges, cells = _home_links(candidates, percent)
    edges = settle(edges, "home-links")
    classes = settle(components(edges), "home-components")
    pairs = settle(_cross_pairs(candidates, cells, classes, percent), "prefix-pairs")
    links = _verified(pairs, candidates, percent)
    joined = components(classes.toDF("a", "b").unionAll(links))
    named = reps.join(joined, reps["name"] == joined["node"], "left").select("name", "least", F.coalesce("component", "name").alias("comp"))
    named = settle(named, "shingle-components")
    least = settle(named.groupBy("comp").agg(F.min("least").alias("component_id")), "least-ids")
    labels = named.join(least, "comp").select("name", "component_id")
    return sets.join(settle(labels, "labels"), "name", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )
