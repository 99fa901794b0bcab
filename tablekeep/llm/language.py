"""Language identification by mixtures: proportions by expectation-maximisation, sets by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import segment_sums, text_slices

#: Bytes of an n-gram and the number of hashed n-grams a model tells apart. The model on the
#: driver and in the broadcast has ``BUCKETS`` numbers for each language, whatever the corpus.
ORDER = 4
BUCKETS = 1 << 16
#: Added to each n-gram count.
SMOOTHING = 0.5
#: Rounds of expectation-maximisation, and the change of a proportion below which they end.
ROUNDS = 30
TOLERANCE = 1e-4
#: Log-likelihood that a further language must gain, for each parameter and log of the words.
PENALTY = 0.5
#: A word counts for no more than this against a language, so that one odd word decides nothing.
WORD_FLOOR = 12.0
#: Distinct words scored at once.
WORDS_AT_ONCE = 1 << 18

UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """Log-probabilities of hashed n-grams, one row per language, languages in sorted order."""

    languages: list[str]
    logs: np.ndarray


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lower-cased words: the bounds per text, the code of each, and the distinct ones. Null texts have none."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return bounds, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _grams(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words, from the blank before each to its last byte, and the bounds per word."""
    words = words.cast(pa.large_binary())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = ORDER - 1
    joined = np.frombuffer(b" " * blank + (b" " * blank).join(words.to_pylist()) + b" " * blank, np.uint8)
    starts = blank + np.concatenate([[0], np.cumsum(lengths + blank)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths + 1) + np.repeat(starts - 1, lengths + 1)
    grams = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        grams = (grams << np.uint64(8)) | joined[at + k]
    with np.errstate(over="ignore"):
        hashed = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (buckets.bit_length() - 1))
    return hashed.astype(np.int64), bounds


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS) -> Model:
    """N-gram log-probabilities of each language, from every row of ``docs`` with language and text.

    Counts are kept per task in a table of fixed size for each language and summed by Spark; only
    the sums, ``buckets`` numbers for each language, reach the driver. No rows give no languages.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            langs = np.array(batch.column(0).to_pylist(), object)
            bounds, codes, words = _words(batch.column(1))
            if not len(codes):
                continue
            grams, of_word = _grams(words, buckets)
            owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
            for lang in sorted(set(langs)):
                times = np.bincount(codes[(langs == lang)[owner]], minlength=len(words))
                found = np.bincount(grams, weights=np.repeat(times, np.diff(of_word)), minlength=buckets)
                counts[lang] = counts.get(lang, 0) + found.astype(np.int64)
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    sums = rows.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.full((len(languages), buckets), SMOOTHING)
    for k, lang in enumerate(languages):
        mine = sums[sums["lang"] == lang]
        counts[k, mine["gram"].to_numpy()] += mine["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def word_scores(model: Model, words: pa.Array) -> np.ndarray:
    """Log-likelihood of each word in each language, the sum over its n-grams."""
    grams, bounds = _grams(words, model.logs.shape[1])
    scores = segment_sums(model.logs[:, grams].T.astype(np.float64), bounds)
    return np.maximum(scores, scores.max(axis=1, keepdims=True) - WORD_FLOOR) if scores.size else scores


def proportions(scores: np.ndarray, weights: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Shares of the ``chosen`` languages in words of the given scores, and their log-likelihood."""
    top = scores[:, chosen].max(axis=1)
    likely = np.exp(scores[:, chosen] - top[:, None])
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(ROUNDS if len(chosen) > 1 else 0):
        mixed = likely * share
        new = (weights / mixed.sum(axis=1)) @ mixed / weights.sum()
        moved, share = np.abs(new - share).max(), new
        if moved < TOLERANCE:
            break
    return share, float(weights @ (np.log(likely @ share) + top))


def mixture(scores: np.ndarray, weights: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The set of languages of best penalised likelihood, grown one by one, and their shares."""
    alone = weights @ scores
    chosen = [int(np.argmax(alone))]
    share, best = np.ones(1), float(alone[chosen[0]])
    price = PENALTY * 2 * np.log(max(weights.sum(), 2))
    while len(chosen) < scores.shape[1]:
        reach = scores[:, chosen].max(axis=1)
        gains = {k: float(weights @ np.maximum(scores[:, k] - reach, 0)) for k in range(scores.shape[1]) if k not in chosen}
        further = max(gains, key=gains.get)
        if gains[further] <= price:
            break
        shares, fit = proportions(scores, weights, [*chosen, further])
        if fit - best <= price:
            break
        chosen, share, best = [*chosen, further], shares, fit
    return chosen, share


def _by_text(model: Model, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word scores and weights of the distinct words of each text."""
    bounds, codes, words = _words(texts)
    parts = [word_scores(model, words[a : a + WORDS_AT_ONCE]) for a in range(0, len(words), WORDS_AT_ONCE)]
    scores = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
    for a, b in zip(bounds, bounds[1:], strict=False):
        found, times = np.unique(codes[a:b], return_counts=True)
        yield scores[found], times.astype(np.float64)


def _labels(model: Model, texts: pa.Array) -> list[str]:
    """The first language of each text, undetermined if no set of languages explains the text.

    A text is undetermined where its words, those with digits aside if there are others, are
    likelier under n-grams drawn evenly than under the best set of languages in its shares.
    """
    bounds, codes, words = _words(texts)
    parts = [word_scores(model, words[a : a + WORDS_AT_ONCE]) for a in range(0, len(words), WORDS_AT_ONCE)]
    scores = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
    grams = pc.binary_length(words.cast(pa.large_binary())).to_numpy(zero_copy_only=False) + 1
    spelled = ~pc.match_substring_regex(words, r"\pN").to_numpy(zero_copy_only=False).astype(bool)
    labels = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        found, times = np.unique(codes[a:b], return_counts=True)
        if not len(found) or not model.languages:
            labels.append(UNDETERMINED)
            continue
        chosen, share = mixture(scores[found], times.astype(np.float64))
        judged = spelled[found] if spelled[found].any() else np.ones(len(found), bool)
        likely = scores[found[judged]][:, chosen]
        top = likely.max(axis=1)
        fit = times[judged] @ (np.log(np.exp(likely - top[:, None]) @ share) + top)
        even = -np.log(model.logs.shape[1]) * (times[judged] @ grams[found[judged]])
        labels.append(model.languages[chosen[0]] if fit > even else UNDETERMINED)
    return labels


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(<id_col>, lang_pred, score, languages, shares)``, one for each row of ``docs``.

    Whole texts count. ``languages`` are those of the chosen set, largest share first, and
    ``lang_pred`` is the first of them with its share as ``score``. A text that is null or has no
    letter, or a model without languages, gives ``und`` with score 0 and no languages. Ties go to
    the language that sorts first. Null ids and repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id long, lang_pred string, score double, languages array<string>, shares array<double>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.languages
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            found: list[tuple] = []
            for scores, weights in _by_text(shared.value, batch.column(1)):
                if not len(weights) or not names:
                    found.append((UNDETERMINED, 0.0, [], []))
                    continue
                chosen, share = mixture(scores, weights)
                order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
                ranked = [min(1.0, float(share[k])) for k in order]
                found.append((names[chosen[order[0]]], ranked[0], [names[chosen[k]] for k in order], ranked))
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "lang_pred", "score", "languages", "shares"])

    letters = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), letters.alias("text")).mapInArrow(task, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the row belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predicted`` with ``held_out``, by a model of the rows of ``docs`` that are not held out."""
    model = train(docs.where(~held_out(id_col, 4, 2)), lang_col, text_col)
    return predicted(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col, 4, 2))


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is undetermined.

    These are null texts, texts without a letter, and texts whose words are likelier under n-grams
    drawn evenly than under the languages that expectation-maximisation gives them shares of.
    Where no language can be learned nothing can be rejected, and all rows stay. All columns stay
    as they are. Rows are tested in place, nothing is shuffled.
    """
    model = train(docs.where(~held_out(id_col, 4, 2)), lang_col, text_col)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def first(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([label for part in text_slices(batch, 0) for label in _labels(shared.value, part.column(0))], pa.string())

    letters = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    return docs.where(first(letters) != UNDETERMINED)
