"""Spelling variants: words one edit apart, found in k-d trees over letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import group_bounds, settle

#: Letters a to z have a count each, all other code points share 32 counts.
LETTERS = 58
#: Words of one length that a task searches together, on average; more are parted by the tree.
LEAF_WORDS = 1 << 14
#: Words that the parting tree is fitted on; every word is parted by it.
SAMPLE_WORDS = 1 << 16
#: Code points of words searched together, for long words.
LEAF_LETTERS = 1 << 23
#: Words in a leaf of the tree inside a task.
BUCKET_WORDS = 64
#: Different words counted in a task before they are passed on.
COUNTED_WORDS = 1 << 19
#: What a near word's counts may have less and more than those of the word asked for, by kind of question.
SAME_LENGTH, ONE_SHORTER = 1, 2
REACH = {SAME_LENGTH: (1, 1), ONE_SHORTER: (1, 0)}


def damaged_runs(docs: DataFrame, every: int = 31, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(word, n)``: the words of ``least`` code points or more, with one code point taken from some.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A to Z in lower case. Where the
    crc32 of ``<id>:<word>`` is divisible by ``every``, the code point at that number modulo the
    length is taken out. Null texts have no words; a null id counts as an empty text.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def passed_on(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                begun = zlib.crc32(f"{doc.as_py()}:".encode() if doc.is_valid else b":")
                found = Counter(runs.findall(text.as_py().lower().decode())) if text.is_valid else {}
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) >= COUNTED_WORDS:
                    yield passed_on(counts)
                    counts.clear()
        yield passed_on(counts)

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def code_points(words: list[str]) -> np.ndarray:
    """A row of code points for each of the words, which have one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row."""
    folded = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 32).astype(np.uint8)
    return np.stack([(folded == letter).sum(axis=1, dtype=np.int32) for letter in range(LETTERS)], axis=1)


def odd_letters(counts: np.ndarray) -> np.ndarray:
    """One bit for each letter that occurs an odd number of times."""
    bits = (counts & 1).astype(np.uint64) << np.arange(LETTERS, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1)


class CountTree:
    """A k-d tree: inner nodes part the points at a value of their widest spread count."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.leaves: list[np.ndarray] = []
        self.root = self._grown(points, np.arange(len(points)), leaf)

    def _grown(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        values = points[rows]
        if len(rows) > leaf and (values.min(axis=0) < values.max(axis=0)).any():
            letter = int(np.argmax(values.var(axis=0)))
            column = values[:, letter]
            border = min(int(np.median(column)), int(column.max()) - 1)
            low = column <= border
            return letter, border, self._grown(points, rows[low], leaf), self._grown(points, rows[~low], leaf)
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def reached(self, asked: np.ndarray, less: int, more: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the rows of ``asked`` that reach their box by taking ``less`` letters off and adding ``more``."""
        nothing = np.zeros(len(asked), np.int32)
        waiting = [(self.root, np.arange(len(asked)), nothing, nothing, {}, {})]
        while waiting:
            node, rows, off, added, low, high = waiting.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            letter, border, left, right = node
            x = asked[rows, letter]
            down = off + np.maximum(x - border, 0) - np.maximum(x - high.get(letter, 1 << 30), 0)
            up = added + np.maximum(border + 1 - x, 0) - np.maximum(low.get(letter, 0) - x, 0)
            to_left, to_right = down <= less, up <= more
            waiting.append((left, rows[to_left], down[to_left], added[to_left], low, high | {letter: border}))
            waiting.append((right, rows[to_right], off[to_right], up[to_right], low | {letter: border + 1}, high))


def one_edit(kind: int, asked: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each row of ``asked`` becomes that of ``found`` by one replaced or, for shorter ones, one deleted letter."""
    if kind == SAME_LENGTH:
        return (asked != found).sum(axis=1) == 1
    before = np.cumprod(asked[:, :-1] == found, axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    after = np.cumprod((asked[:, 1:] == found)[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return before + after >= found.shape[1]


class NearWords:
    """Words of one length, searched by box-pruned ranges of their letter counts."""

    def __init__(self, words: list[str]):
        self.codes = code_points(words)
        counts = letter_counts(self.codes)
        self.odd, self.tree = odd_letters(counts), CountTree(counts, BUCKET_WORDS)

    def of(self, kind: int, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``words``, which have one length, and of the words here that are one edit away."""
        codes = code_points(words)
        counts = letter_counts(codes)
        odd = odd_letters(counts)
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
        for leaf, rows in self.tree.reached(counts, *REACH[kind]):
            here = self.tree.leaves[leaf]
            differ = np.bitwise_count(odd[rows, None] ^ self.odd[here])
            at, to = np.nonzero(differ <= 2 if kind == SAME_LENGTH else differ == 1)
            at, to = rows[at], here[to]
            near = one_edit(kind, codes[at], self.codes[to])
            yield at[near], to[near]


def _parting_trees(words: DataFrame) -> dict[int, CountTree]:
    """A tree for each length of which there are many words, fitted on a bounded sample of those words."""
    sizes = words.groupBy(F.char_length("word").alias("size")).count().where(F.col("count") > LEAF_WORDS)
    many = {row[0]: row[1] for row in sizes.collect()}
    if not many:
        return {}
    total = sum(many.values())
    sampled = words.where(F.char_length("word").isin(list(many))).orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).select("word").toPandas()
    # A leaf holds LEAF_WORDS words when it holds this many of the sample.
    leaf = max(1, int(LEAF_WORDS * len(sampled) / total))
    return {size: CountTree(letter_counts(code_points(list(group))), leaf) for size, group in sampled["word"].groupby(sampled["word"].str.len())}


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows ``(word, n, other, other_n)``, both ways, for words exactly one edit apart; ``words`` has one row per word.

    Words are parted by length and, where there are many of a length, by a k-d tree over their
    letter counts. A word asks the leaves of its own length and of one less whose box lies within
    one edit; a leaf with more words than a task should hold is dealt into parts, all of which
    are asked. Inside a task the leaf's words form a tree of their own.
    """
    trees = words.sparkSession.sparkContext.broadcast(_parting_trees(words))

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places, asked = [], []
            for size, at in frame.groupby(frame["word"].str.len()).indices.items():
                counts = letter_counts(code_points(frame["word"].iloc[at].tolist()))
                for kind, to_size, reach in ((0, size, (0, 0)), (SAME_LENGTH, size, REACH[SAME_LENGTH]), (ONE_SHORTER, size - 1, REACH[ONE_SHORTER])):
                    tree = trees.value.get(to_size)
                    for leaf, rows in tree.reached(counts, *reach) if tree else [(0, np.arange(len(at)))]:
                        places.append(at[rows])
                        asked.append(np.broadcast_to(np.array([to_size, leaf, kind], np.int32), (len(rows), 3)))
            if places:
                sent = frame.iloc[np.concatenate(places)]
                yield pd.DataFrame(np.concatenate(asked), columns=["size", "leaf", "kind"]).assign(word=sent["word"].to_numpy(), n=sent["n"].to_numpy())

    rows = settle(words.select("word", "n").mapInPandas(routed, "size int, leaf int, kind int, word string, n long"), "routed-words")
    sizes = rows.where("kind = 0").groupBy("size", "leaf").agg(F.count("*").alias("held"))
    parts = F.greatest(F.ceil(F.col("held") / (2 * LEAF_WORDS)), F.ceil(F.col("held") * F.col("size") / LEAF_LETTERS))
    rows = rows.join(settle(sizes.select("size", "leaf", parts.cast("int").alias("parts")), "word-leaves"), ["size", "leaf"])
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = rows.withColumn("part", F.explode(F.when(F.col("kind") == 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("parts")
    keys = ["size", "leaf", "part"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, index = None, [], None
        for frame in frames:
            bounds = group_bounds(frame, keys)
            for begin, end in zip(bounds, bounds[1:], strict=False):
                run = frame.iloc[begin:end]
                if tuple(run[keys].iloc[0]) != key:
                    key, held, index = tuple(run[keys].iloc[0]), [], None
                if (run["kind"] == 0).any():
                    held.append(run[run["kind"] == 0])
                for kind, asked in run[run["kind"] > 0].groupby("kind") if held else ():
                    if index is None:
                        here = pd.concat(held, ignore_index=True)
                        index = NearWords(here["word"].tolist())
                    found = list(index.of(int(kind), asked["word"].tolist()))
                    left, right = asked.iloc[np.concatenate([at for at, _ in found])], here.iloc[np.concatenate([to for _, to in found])]
                    yield pd.DataFrame({"word": left["word"].to_numpy(), "n": left["n"].to_numpy(), "other": right["word"].to_numpy(), "other_n": right["n"].to_numpy()})

    found = dealt.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInPandas(task, "word string, n long, other string, other_n long")
    once = settle(found.where("char_length(word) > char_length(other) OR word < other"), "near-words")
    return once.unionAll(once.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows ``(word, root)`` for links ``(word, form)``: the last form, found by doubling the way each round.

    Forms are more frequent than their words, so links have no circles.
    """
    links = settle(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = settle(moved, "roots")
        links = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return links


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Rows ``(word, form, root, n, n_near, form_n)``, one for each row ``(word, n)`` of ``words``.

    Words are near if one inserted, deleted or replaced code point turns one into the other. A
    word's form is its most frequent near word, of equal ones the first in code-point order, if it
    occurs ``ratio`` times as often or more; ``root`` follows forms to the last. Without a form,
    ``form`` and ``form_n`` are null and ``root`` is the word. Words must be distinct and not null;
    ``ratio`` must be above 1. Other columns are not read. An empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = settle(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    judged = words.join(settle(best, "best-near"), "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    judged = settle(
        judged.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "judged-words",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame, every: int = 31, least: int = 7, occurrences: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the damaged runs of ``docs`` that occur ``occurrences`` times or more.

    Repeated rows count each time. Null, empty and blank texts have no words; an empty table gives
    an empty result. Other columns are not read.
    """
    return variants(damaged_runs(docs, every, least, id_col, text_col).where(F.col("n") >= occurrences))
