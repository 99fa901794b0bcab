"""Best-fit packing of tokenized documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import settle

#: Pieces that one task packs. More pieces leave fewer open sequences, fewer run wider.
PIECES_PER_TASK = 100_000
PIECE_SCHEMA = "id long, piece int, start long, length long, ids_crc32 long"
IDS_SCHEMA = f"{PIECE_SCHEMA}, ids array<int>"


@cache
def _encoding(vocabulary: str):
    """The byte-level BPE of a ``tokenizers`` JSON file, run by ``tiktoken``.

    The same vocabulary, merges and pre-tokenizer give the same ids at about four times the
    speed. Special tokens of the file count where their strings occur in a text.
    """
    import json

    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {_bytes_of(token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def _tokenizer(vocabulary: str, special: bool):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = not special
    return tokenizer


def token_ids(vocabulary: str, text: str, special: bool = True) -> list[int]:
    """The ids of a whole text. Without ``special`` the strings of special tokens are plain text.

    ``tiktoken`` gives up on white space of about a million characters in a row; ``tokenizers``
    itself takes such a text.
    """
    encoding = _encoding(vocabulary)
    try:
        return encoding.encode(text, allowed_special=encoding.special_tokens_set if special else set(), disallowed_special=())
    except ValueError:
        return _tokenizer(vocabulary, special).encode(text, add_special_tokens=False).ids


# Fixed value: the pre-tokenizer of byte-level BPE vocabularies of this kind.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _bytes_of(token: str) -> bytes:
    letters = _byte_letters()
    return bytes(letters[c] for c in token)


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` tokens begin: whole sequences but for the first, which may be shorter."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def tokenized(
    docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Rows ``(id, piece, start, length, ids_crc32[, ids])``: the token pieces of each row of ``docs``.

    A null text is empty, an empty one is the end id alone. Whole texts are tokenized; only those
    of more than ``capacity`` ids are cut. Null ids stay null and repeated rows stay; an empty
    table gives no rows. Other columns are not read. ``vocabulary`` must lie on every executor.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*token_ids(vocabulary, text.as_py() or ""), end_id], "<u4")
                at = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    doc.append(name)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(pieces, IDS_SCHEMA if with_ids else PIECE_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given.

    Among a new bin and the open bins of every residual gap that fits, takes the one after which
    the sum over gaps of the squared number of open bins is smallest; ties go to the tighter fit.
    Full bins are closed and no longer count.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for at, size in enumerate(lengths.tolist()):
        rest = capacity - size
        # Gap g becomes g - size: count[g]^2 falls and count[g - size]^2 rises, but for a full bin.
        change = 2 * count[: rest + 1] + 1
        change[0] = 0
        new = int(change[rest])
        change[:rest] += np.where(count[size:capacity] > 0, 1 - 2 * count[size:capacity], 1 << 60)
        best = int(np.argmin(change[:rest])) if rest else 0
        if rest and change[best] <= new:
            which = open_bins[best + size].pop()
            count[best + size] -= 1
        else:
            best, which = rest, len(used)
            used.append(0)
        bins[at], offsets[at] = which, used[which]
        used[which] += size
        if best:
            open_bins[best].append(which)
            count[best] += 1
    return bins, offsets


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given where the least room is left."""
    gaps: list[tuple[int, int]] = []
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for at, size in enumerate(lengths.tolist()):
        k = bisect_left(gaps, (size, -1))
        if k < len(gaps):
            gap, which = gaps.pop(k)
        else:
            gap, which, n = capacity, n, n + 1
        bins[at], offsets[at] = which, capacity - gap
        if gap > size:
            insort(gaps, (gap - size, which))
    return bins, offsets


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each of the descending ``lengths``.

    The sum-of-squares rule closes nearly all bins but ends with some open ones of many gaps,
    the price of looking ahead. What lies in these is placed once more, by best fit, and the
    better of both results stays.
    """
    bins, offsets = sum_of_squares(lengths, capacity)
    is_open = np.bincount(bins, weights=lengths) < capacity
    again = np.flatnonzero(is_open[bins])
    new, moved = best_fit(lengths[again], capacity)
    free = np.flatnonzero(is_open)
    if len(again) and new.max() < len(free):
        bins[again], offsets[again] = free[new], moved
    return bins, offsets


def placed(pieces: DataFrame, capacity: int = 1024, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, packed by the sum-of-squares rule.

    Pieces are dealt evenly by a hash, so that neither a document of many pieces nor one source
    gathers in a task; each task packs its share, long pieces first. ``pieces`` must be settled:
    tasks that run again then see the same rows. Sequence ids are unique, not dense.
    """
    parts = max(1, -(-pieces.count() // pieces_per_task))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if sum(map(len, held)):
            frame = pd.concat(held, ignore_index=True)
            part = frame.pop("part").to_numpy()
            bins, offsets = pack_lengths(frame["length"].to_numpy(), capacity)
            yield frame.assign(sequence_id=part * (1 << 40) + bins, offset=offsets)

    whole = (
        pieces.repartition(parts, "id", "piece", "ids_crc32")
        .withColumn("part", F.spark_partition_id().cast("long"))
        .sortWithinPartitions(F.desc("length"), "id", "piece", "ids_crc32")
    )
    columns = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    return whole.mapInPandas(task, f"{columns}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document lies: ``(<id_col>, piece, start, length, ids_crc32, sequence_id, offset)``."""
    pieces = settle(tokenized(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    return placed(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(sequence_id, ids)``: the packed token sequences themselves, at most ``capacity`` ids each."""
    pieces = settle(tokenized(docs, vocabulary, end_id, capacity, id_col, text_col, with_ids=True), "pieces")
    lying = placed(pieces, capacity).select("sequence_id", "offset", "ids")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return lying.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
