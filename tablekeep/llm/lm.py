"""Stupid-backoff scores: a table of n-gram counts, joined to the n-grams of the documents, summed per document."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import mix64, settle, text_slices, whole_groups
from tablekeep.llm.packing import token_ids
from tablekeep.session import shuffle_partitions

#: Longest n-gram, and the factor for each step back to a shorter one.
ORDER = 3
BACKOFF = 0.4
#: Bytes of text whose different n-grams are asked for together, and of text per part of the count table.
SLICE_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: Bits of a token in an n-gram of at most three; zero stands for no token.
TOKEN_BITS = 21


def grams_of(tokens: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of exactly ``order`` tokens as numbers; different orders never share a number."""
    n = max(0, len(tokens) - order + 1)
    out = np.zeros(n, np.int64)
    for k in range(order):
        out = out << TOKEN_BITS | (tokens[k : k + n] + 1)
    return out


def log_scores(tokens: np.ndarray, grams: np.ndarray, totals: np.ndarray, order: int, backoff: float, others_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of each token's stupid-backoff score, and which of them are still to be divided by all tokens.

    ``grams``, ascending, and ``totals`` are counts that hold every n-gram of the text. With
    ``others_only`` what the text itself counts is taken off first, so that only what other
    documents say is used. A token that is left without any count scores as the rarest would,
    one further step back.
    """
    counts: list[np.ndarray] = []
    for o in range(1, order + 1):
        own, place, times = np.unique(grams_of(tokens, o), return_inverse=True, return_counts=True)
        total = totals[np.searchsorted(grams, own)] if len(own) else np.zeros(0, np.int64)
        counts.append((total - times * others_only)[place])
    longest = np.minimum(order, np.arange(len(tokens)) + 1)
    scores, single = backoff ** longest.astype(np.float64), np.ones(len(tokens), bool)
    for o in range(1, order + 1):  # longer n-grams overwrite shorter ones
        seen = np.flatnonzero(counts[o - 1] > 0)
        at = seen + o - 1
        scores[at] = backoff ** (longest[at] - o) * counts[o - 1][seen] / (counts[o - 2][seen] if o > 1 else 1)
        single[at] = o == 1
    return np.log(scores), single


def _slice_grams(tokens: list[np.ndarray], order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of a slice, how often each occurs, and its part; by part, then by n-gram."""
    found = [np.unique(np.concatenate([grams_of(t, o) for t in tokens]), return_counts=True) for o in range(1, order + 1)]
    grams, times = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    part = (mix64(grams.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    return grams[by], times[by], part[by]


def _runs(part: np.ndarray) -> Iterator[tuple[int, int]]:
    bounds = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    return zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


_SENT = "part int, slice long, ids binary, known binary, lengths array<int>, tokens binary, grams binary, times binary"
_ANSWERED = "slice long, part int, ids binary, known binary, lengths array<int>, tokens binary, totals binary"


def _dealt(texts: DataFrame, vocabulary: str, order: int, slice_bytes: int, parts: int) -> DataFrame:
    """N-grams of slices of documents, dealt by hash to parts of the count table, and a row with each slice's tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = count(TaskContext.get().partitionId() << 32)
        for piece in (part for batch in batches for part in text_slices(batch, 1, slice_bytes)):
            tokens = [np.array(token_ids(vocabulary, text.as_py(), special=False), np.int64) for text in piece.column(1)]
            number, joined = next(slices), np.concatenate(tokens)
            kind = "<u2" if joined.max(initial=0) < 1 << 16 else "<u4"
            ids, known = (a.to_numpy(zero_copy_only=False).tobytes() for a in (piece.column(0).fill_null(0), piece.column(0).is_valid()))
            rows = [(number % parts, number, ids, known, [len(t) for t in tokens], _packed(joined.astype(kind)), None, None)]
            grams, times, part = _slice_grams(tokens, order, parts)
            rows += [(int(part[a]), number, None, None, None, None, _packed(np.diff(grams[a:b], prepend=0)), _packed(times[a:b].astype("<u4"))) for a, b in _runs(part)]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "slice", "ids", "known", "lengths", "tokens", "grams", "times"])

    return texts.mapInArrow(task, _SENT)


def _answered(dealt: DataFrame) -> DataFrame:
    """For each slice and part the counts over all documents, in the order of the n-grams asked for."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, ["part"]):
            for _, frame in group.groupby("part", sort=False):
                whole = frame["tokens"].notna()
                asked = frame[~whole]
                if whole.any():
                    yield frame.loc[whole, ["slice", "part", "ids", "known", "lengths", "tokens"]].assign(totals=None)
                if asked.empty:
                    continue
                grams = [np.cumsum(_unpacked(g, "<i8")) for g in asked["grams"]]
                times = np.concatenate([_unpacked(t, "<u4") for t in asked["times"]])
                _, places = np.unique(np.concatenate(grams), return_inverse=True)
                # The sums are of whole numbers far below 2 ** 53.
                totals = np.bincount(places, times)[places].astype(np.int64)
                ends = np.cumsum([len(g) for g in grams])
                found = [_packed(totals[e - len(g) : e]) for g, e in zip(grams, ends, strict=True)]
                yield asked[["slice", "part"]].assign(ids=None, known=None, lengths=None, tokens=None, totals=found)

    return dealt.repartition("part").sortWithinPartitions("part").mapInPandas(task, _ANSWERED)


def scored(
    docs: DataFrame, vocabulary: str, order: int = ORDER, backoff: float = BACKOFF, others_only: bool = True, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Rows ``(<id_col>, n_tokens, log_score, mean_log_score)``, one for each row of ``docs``.

    Counts are of the tokens of all whole texts, up to ``order`` in {1, 2, 3}. Texts are tokenized
    once. The n-grams of a slice of documents, each different one once with its number, are dealt
    by hash to the parts of the count table, compressed; a part adds them up over all slices and answers each
    slice in the order it asked, and the answers meet the slice's tokens, where the logarithms
    are summed per document. A frequent n-gram is one entry per slice in its part.

    ``log_score`` is 0 and the mean null for a null or empty text. Null ids and repeated rows
    stay, and count as often as they are there; an empty table gives no rows. Other columns are
    not read. Slices are numbered by task: a task that runs again must read its rows in the same
    order, as from files; settle a table that comes from a shuffle first.
    """
    if order not in (1, 2, 3):
        raise ValueError("the order is 1, 2 or 3")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(2 * shuffle_partitions(docs.sparkSession), -(-total_bytes // PART_BYTES))

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        first = group[group["tokens"].notna()].iloc[0]
        ends = np.cumsum(first["lengths"])
        plain = zstandard.decompress(first["tokens"])
        joined = np.frombuffer(plain, "<u2" if len(plain) == 2 * ends[-1] else "<u4").astype(np.int64)
        tokens = np.split(joined, ends[:-1])
        grams, _, part = _slice_grams(tokens, order, parts)
        answers = group[group["tokens"].isna()].sort_values("part", kind="stable")["totals"]
        totals = np.concatenate([_unpacked(t, "<i8") for t in answers]) if len(answers) else np.zeros(0, np.int64)
        by = np.argsort(grams, kind="stable")
        grams, totals = grams[by], totals[by]
        found = [log_scores(t, grams, totals, order, backoff, others_only) for t in tokens]
        values = [float(logs.sum()) for logs, _ in found]
        ids = pd.arrays.IntegerArray(np.frombuffer(first["ids"], np.int64).copy(), ~np.frombuffer(first["known"], bool))
        return pd.DataFrame({"id": ids, "n_tokens": first["lengths"], "part_score": values, "single": [int(s.sum()) for _, s in found]})

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(frames, ["slice"]):
            for _, frame in group.groupby("slice", sort=False):
                yield sums(frame)

    answered = _answered(_dealt(texts, vocabulary, order, slice_bytes, int(parts)))
    found = answered.repartition("slice").sortWithinPartitions("slice").mapInPandas(task, "id long, n_tokens long, part_score double, single long")
    found = settle(found, "document-sums")
    everything = found.agg(F.sum("n_tokens")).first()[0] or 0
    others = F.greatest(F.lit(1), F.lit(everything) - F.col("n_tokens") * int(others_only))
    log_score = F.col("part_score") - F.col("single") * F.log(others.cast("double"))
    rows = found.select(F.col("id").alias(id_col), "n_tokens", F.when(F.col("n_tokens") > 0, log_score).otherwise(F.lit(0.0)).alias("log_score"))
    return rows.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
