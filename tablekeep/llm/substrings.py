"""Substring deduplication by seed and extend: winnowed anchors, extension both ways, maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import mix64, settle, text_slices

#: Words of a repeat and of an anchor. Of each window of ``LENGTH`` words the smallest anchor hash is kept.
LENGTH = 35
ANCHOR = 10
#: Windows looked at together when their anchors are chosen.
STEP = 1 << 18
_BASE, _WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _rolling(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``width`` neighbours."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * base + hashes[k : k + n]
    return mix64(out)


def _words(texts: pa.Array) -> pa.ListArray:
    """The words between ASCII white space; null where there are none."""
    trimmed = pc.ascii_trim_whitespace(texts.view(pa.string()))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(trimmed), 0), None, trimmed))


def _hashed(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of each text begin and end, and a hash of each word."""
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.view(pa.binary()).to_pylist()], np.uint64)
    return bounds, hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.uint64)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each ``width`` neighbours is, the first of equal ones, by stretches that double."""
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best, span = np.where(values[left] <= values[right], left, right), span + step
    return best


def winnowed(hashes: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, where the anchor of each begins, and all anchor hashes.

    The anchor of a window is its smallest run of ``anchor`` words, the first of equal ones: equal
    windows have equal anchors at equal places, so no repeat of ``length`` words goes unseen.
    """
    grams = _rolling(hashes, anchor, _BASE)
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    inside = np.zeros(len(hashes) + 1, np.int64)  # windows that begin here lie in one text
    whole = np.diff(bounds) >= length
    np.add.at(inside, bounds[:-1][whole], 1)
    np.add.at(inside, bounds[1:][whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:n])
    width = length - anchor + 1
    at = np.concatenate([a + _smallest(grams[a : min(a + STEP, n) + width - 1], width) for a in range(0, n, STEP)])
    return starts, at[starts], grams


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    mark = F.xxhash64(id_col, text_col)
    return docs.select(mark.alias("mark"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def _anchored(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """One row per text: its number of words, the digest of all of them, and its anchors with their places."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 2):
                words = _words(batch.column(2))
                bounds, hashes = _hashed(words)
                _, at, grams = winnowed(hashes, bounds, length, anchor)
                at = np.unique(at)
                cuts = np.searchsorted(at, bounds).astype(np.int32)
                owner = np.repeat(bounds[:-1], np.diff(cuts))
                digests = [hashlib.sha256((t.as_buffer() if t.is_valid else b"")).hexdigest() for t in pc.binary_join(words, " ")]
                columns = [batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(digests)]
                columns.append(pa.ListArray.from_arrays(cuts, pa.array(grams[at].view(np.int64))))
                columns.append(pa.ListArray.from_arrays(cuts, pa.array((at - owner).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["mark", "id", "n_words", "digest", "anchors", "places"])

    return texts.mapInArrow(task, "mark long, id long, n_words long, digest string, anchors array<long>, places array<int>")


def _extended(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Seeds extended both ways as far as the windows reach that they anchor, a row for each seed.

    ``start`` is the first of its ``size`` windows, ``span`` a hash of all of them.
    """
    powers = np.cumprod(np.full(length, _BASE), dtype=np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                bounds, hashes = _hashed(_words(batch.column(1)))
                starts, at, grams = winnowed(hashes, bounds, length, anchor)
                seeds = batch.column(2)
                counts = np.diff(seeds.offsets.to_numpy())
                places = np.repeat(bounds[:-1], counts) + seeds.flatten().to_numpy(zero_copy_only=False)
                kept = np.isin(at, places)
                starts, at = starts[kept], at[kept]
                if not len(starts):
                    continue
                windows = _rolling(hashes, length, _WINDOW_BASE)[starts]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # windows of one anchor are neighbours
                sizes = np.diff(np.append(first, len(at)))
                spans = mix64(np.add.reduceat(windows * powers[starts - np.repeat(starts[first], sizes)], first) + sizes.astype(np.uint64))
                owner = np.searchsorted(bounds, starts[first], side="right") - 1
                columns = [batch.column(0).take(pa.array(owner)), pa.array((starts[first] - bounds[owner]).astype(np.int32)), pa.array(sizes.astype(np.int32))]
                columns += [pa.array(grams[at[first]].view(np.int64)), pa.array(spans.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["mark", "start", "size", "anchor", "span"])

    return texts.select("mark", "text", "seeds").mapInArrow(task, "mark long, start int, size int, anchor long, span long")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """The window hashes of stretches: rows ``(anchor, span, n, offset, window)`` of ``(text, stretches)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 0):
                bounds, hashes = _hashed(_words(batch.column(0)))
                windows, lists = _rolling(hashes, length, _WINDOW_BASE), batch.column(1)
                owner = np.repeat(bounds[:-1], np.diff(lists.offsets.to_numpy()))
                start, size, anchor, span, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
                offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(owner + start, size) + offset
                columns = [pa.array(np.repeat(x, size)) for x in (anchor, span, n)] + [pa.array(offset.astype(np.int32)), pa.array(windows[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "span", "n", "offset", "window"])

    return texts.select("text", "stretches").mapInArrow(task, "anchor long, span long, n long, offset int, window long")


def _repeated(seeds: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Rows ``(anchor, span, offsets)``: which windows of each different stretch are repeated.

    If all stretches around an anchor are equal, all their windows are repeated. Else the windows
    of the different stretches are counted, each as often as its stretch occurs; their hashes are
    taken from one text that holds the stretch.
    """
    one = F.min(F.struct("mark", "start", "size")).alias("one")
    spans = settle(seeds.groupBy("anchor", "span").agg(F.count("*").alias("n"), one), "spans")
    several = spans.groupBy("anchor").agg(F.count("*").alias("spans")).where("spans > 1").select("anchor")
    alone = spans.join(several, "anchor", "left_anti").where("n > 1")
    whole = alone.select("anchor", "span", F.sequence(F.lit(0), F.col("one.size") - 1).alias("offsets"))
    stretch = F.struct("one.start", "one.size", "anchor", "span", "n")
    wanted = spans.join(several, "anchor").groupBy(F.col("one.mark").alias("mark")).agg(F.collect_list(stretch).alias("stretches"))
    each = settle(_windows(texts.select("mark", "text").join(wanted, "mark"), length), "windows")
    repeats = settle(each.groupBy("anchor", "window").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "window"), "repeated-windows")
    parts = each.join(repeats, ["anchor", "window"]).groupBy("anchor", "span").agg(F.collect_set("offset").alias("offsets"))
    return settle(whole.unionAll(parts), "repeated-stretches")


def _without(texts: DataFrame, length: int) -> DataFrame:
    """Rows ``(mark, n_removed, kept)`` of texts without the words that the windows at ``starts`` cover."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for row, starts in enumerate(batch.column(2)):
                words = _words(batch.column(1).slice(row, 1)).flatten()
                edge = np.zeros(len(words) + 1, np.int32)
                at = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                stays = np.cumsum(edge[:-1]) == 0
                removed.append(int((~stays).sum()))
                left = words.filter(pa.array(stays))
                kept.append(pc.binary_join(pa.ListArray.from_arrays([0, len(left)], left), " ").view(pa.binary())[0].as_py())
            columns = [batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "n_removed", "kept"])

    return texts.mapInArrow(task, "mark long, n_removed long, kept binary")


def _found(docs: DataFrame, length: int, anchor: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    if not 1 <= anchor <= length:
        raise ValueError("an anchor has at least one word and at most those of a repeat")
    texts = _marked(docs, id_col, text_col)
    base = settle(_anchored(texts, length, anchor), "anchored")
    anchors = base.select("mark", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("mark", "a.anchors", "a.places")
    # Settled, so that a shuffle lies right below each side of a join and a hot anchor can be split.
    repeated = settle(anchors.groupBy("anchors").agg(F.count("*").alias("n")).where("n > 1").select("anchors"), "repeated-anchors")
    seeds = anchors.join(repeated, "anchors").groupBy("mark").agg(F.collect_set("places").alias("seeds"))
    seeded = settle(texts.select("mark", "text").join(seeds, "mark"), "seeded")
    distinct = seeded.dropDuplicates(["mark"])
    extended = settle(_extended(seeded, length, anchor), "extended")
    places = extended.select("mark", "start", "anchor", "span").join(_repeated(extended, distinct, length), ["anchor", "span"])
    starts = places.select("mark", F.transform("offsets", lambda offset: offset + F.col("start")).alias("s"))
    starts = starts.groupBy("mark").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts"))
    cut = distinct.select("mark", "text").join(starts, "mark").select("mark", "text", "starts")
    return base, _without(cut, length)


def deduplicated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(<id_col>, n_words, n_removed, kept_sha256)``, one for each row of ``docs``.

    Words lie between ASCII white space. Removed is each word covered by a window of ``length``
    words whose words also begin anywhere else, in the same or another row; a repeated row repeats
    all its windows. Counts and joins on anchors and windows keep one row per key on one side, so
    that a passage in very many documents is combined before the shuffle and split after it; no
    pairs of occurrences are made. Null and empty texts have no words; null ids stay null; other
    columns are not read. Rows are told apart by a 64-bit hash of id and text.
    """
    base, cut = _found(docs, length, anchor, id_col, text_col)
    digests = cut.select("mark", "n_removed", F.sha2("kept", 256).alias("sha"))
    return base.select("mark", "id", "n_words", "digest").join(digests, "mark", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "digest").alias("kept_sha256")
    )


def cleaned(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out; a changed text is its kept words joined by one space."""
    _, cut = _found(docs, length, anchor, id_col, text_col)
    new = settle(cut.select("mark", F.col("kept").cast("string").alias("kept")), "kept")
    text = F.coalesce(new["kept"], docs[text_col])
    joined = docs.join(new, F.xxhash64(docs[id_col], docs[text_col]) == new["mark"], "left")
    return joined.select(*[text.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])
