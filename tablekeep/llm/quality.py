"""Document quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import text_slices
from tablekeep.llm.language import held_out

#: Hashed terms, dimensions of the latent space, and the most labelled documents a model is fitted
#: on: what goes to the driver and to every task has these sizes, whatever the corpus.
BUCKETS = 4096
DIMENSIONS = 64
LABELLED = 4000
#: Neighbours that vote, and the power of the similarity that weighs a vote.
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
#: Share of different words, in steps, as a term of the text.
VARIETY_STEPS = 16


@dataclass(frozen=True)
class Model:
    """Term weights times the latent basis, the labelled unit vectors, and their labels."""

    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _bucket(kind: str, values: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(f"{kind}{value}") % BUCKETS for value in values], np.int64)


def _encoded(kind: str, values: pa.Array) -> np.ndarray:
    coded = values.dictionary_encode()
    return _bucket(kind, coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed terms, a row per text: words, their shapes and endings, repeats, and variety.

    A shape writes A, a and 9 for runs of capitals, other letters and digits. A word that equals
    the one before it counts as a repeat. Null and blank texts have no terms.
    """
    trimmed = pc.utf8_trim_whitespace(texts.cast(pa.large_string()))
    lists = pc.utf8_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, pa.large_string()), trimmed))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    shapes = pc.replace_substring_regex(words, r"\p{Lu}+", "A")
    shapes = pc.replace_substring_regex(shapes, r"[\p{Ll}\p{Lo}\p{Lm}]+", "a")
    shapes = pc.replace_substring_regex(shapes, r"\p{N}+", "9")
    terms = [_encoded("w", pc.utf8_lower(words)), _encoded("s", shapes), _encoded("e", pc.utf8_slice_codeunits(words, -3, 1 << 30))]
    owner = np.repeat(np.arange(len(texts)), lengths) * BUCKETS
    counts = np.zeros(len(texts) * BUCKETS)
    for term in terms:
        counts += np.bincount(owner + term[codes], minlength=len(counts))
    again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    counts += np.bincount(owner[1:][again] + _bucket("r", [""])[0], minlength=len(counts))
    counts = counts.reshape(len(texts), BUCKETS).astype(np.float32)
    full = np.flatnonzero(lengths)
    ends = np.cumsum(lengths)
    variety = [len(np.unique(codes[ends[k] - lengths[k] : ends[k]])) / lengths[k] for k in full]
    steps = _bucket("v", [str(k) for k in range(VARIETY_STEPS + 1)])
    counts[full, steps[(np.array(variety) * VARIETY_STEPS).astype(int)]] += lengths[full]
    return counts


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each term occurs, and the number of texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(BUCKETS, np.int64), 0
        for whole in batches:
            for batch in text_slices(whole, 0):
                found += (term_counts(batch.column(0)) > 0).sum(axis=0)
                rows += batch.num_rows
        terms = [pa.array(np.arange(-1, BUCKETS)), pa.array(np.append(rows, found))]
        yield pa.RecordBatch.from_arrays(terms, names=["term", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[sums["term"].to_numpy(np.int64) + 1] = sums["n"].to_numpy(np.int64)
    return out[1:], int(out[0])


def latent_basis(weighted: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of a matrix, by subspace iteration from fixed random directions."""
    start = np.random.default_rng(0).standard_normal((weighted.shape[0], dimensions + 16)).astype(np.float32)
    basis = np.linalg.qr(weighted.T @ start)[0]
    for _ in range(3):
        basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
    _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :dimensions]


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(lengths > 0, lengths, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """A model of at most ``labelled`` labelled documents, the first by a hash of their ids.

    Term frequencies come from all of ``docs``. Rows without id, label or text are not learned
    from, of repeated labels the mean counts, and of several texts of one id the first in order. Without labelled documents every score is 0.5.
    """
    frequencies, n = document_frequencies(docs, text_col)
    means = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("id").agg(F.avg("y").alias("y"))
    chosen = means.orderBy(F.xxhash64("id"), "id").limit(labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                counts = term_counts(batch.column(1))
                rows = [np.flatnonzero(row) for row in counts]
                columns = [batch.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array([c[r] for c, r in zip(counts, rows, strict=True)], pa.list_(pa.float32())), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "terms", "counts", "y"])

    single = texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    found = single.select("id", "text", "y").mapInArrow(task, "id long, terms array<int>, counts array<float>, y double")
    sample = found.toPandas().sort_values("id", kind="stable")
    counts = np.zeros((len(sample), BUCKETS), np.float32)
    for row, (terms, values) in enumerate(zip(sample["terms"], sample["counts"], strict=True)):
        counts[row, terms] = values
    idf = np.log((1 + n) / (1 + frequencies)).astype(np.float32) + 1
    y = sample["y"].to_numpy(np.float64)
    if not len(y):
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    weighted = _unit(np.log1p(counts) * idf)
    basis = latent_basis(weighted, min(DIMENSIONS, len(y)))
    return Model((idf[:, None] * basis).astype(np.float32), _unit(weighted @ basis).astype(np.float32), y, float(y.mean()))


def votes(model: Model, texts: pa.Array, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores from 0 to 1: labels of the nearest labelled vectors, weighed by cosine to a power.

    All cosines are computed, in blocks. A text without terms, or far from every labelled vector,
    has the mean label.
    """
    vectors = _unit(np.log1p(term_counts(texts)) @ model.basis)
    near = vectors @ model.vectors.T
    k = min(neighbours, near.shape[1])
    if not k:
        return np.full(len(texts), model.prior)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(near, top, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    mean = (weight * model.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.clip(np.where(total > 0, mean, model.prior), 0, 1)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(<id_col>, score, predicted)``, one for each row of ``docs``; whole texts count.

    Null and empty texts have the mean label of the model as score. Null ids and repeated rows
    stay; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                scores = votes(shared.value, batch.column(1))
                columns = [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``scored`` with ``held_out``; labels of the held-out fifth are never learned."""
    model = fit(docs, labels.where(~held_out(id_col, 5, 0)), id_col, text_col, label_col)
    return scored(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col, 5, 0))
