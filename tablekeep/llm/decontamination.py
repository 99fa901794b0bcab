"""Benchmark decontamination by templates: typed placeholders, window hash join, slot consistency.

Items are joined as classes: whether a document leaks an item depends only on the item's template
and on which of its slots hold equal values. A class is met once, however many items it has.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import group_bounds, mix64, settle, text_slices, whole_groups

#: Tokens of a template window, and how many of them must be words and no placeholders.
WIDTH = 5
MIN_WORDS = 3
#: Share of an item's tokens that consistent windows must cover in a document.
COVERAGE = 0.8
#: Bits of the map of benchmark windows that goes to every task, whatever the benchmark's size.
MAP_BITS = 1 << 23

UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams ton tons tonne tonnes lb lbs pound pounds ounce ounces oz "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degree degrees kmh mph".split()
)
# Number words of four languages without their articles, and what they stand for.
_NUMBERS = "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 30 40 50 60 70 80 90 100 1000".split()
_NUMBER_NAMES = [
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand",
    "cero - dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil",
    "zéro - deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf "
    "vingt trente quarante cinquante soixante soixante-dix quatre-vingts quatre-vingt-dix cent mille",
    "null - zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend",
]
NUMBER_WORDS = {word: number for names in _NUMBER_NAMES for word, number in zip(names.split(), _NUMBERS, strict=True) if word != "-"}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—·"
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*(?P<unit>[^\W\d_]{0,5})")
_ENDS = re.compile(r"[.!?:](?:[\"')\]»”*#$%&!]*)$")

NUMBER, UNIT, TITLE, ENDS = 1, 2, 4, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


_NUMBER_MARK, _UNIT_MARK, _NAME_MARK, _AMOUNT_MARK = (np.uint64(_hash(f"\0{kind}")) for kind in ("number", "unit", "name", "amount"))


def _described(token: str) -> tuple[int, int]:
    """Hash and kind of a token without the punctuation around it; hash 0 if nothing is left."""
    core = token.strip(_PUNCTUATION)
    if not core:
        return 0, ENDS * bool(_ENDS.search(token))
    kind = ENDS * bool(_ENDS.search(token))
    if number := _NUMBER.fullmatch(core):
        return _hash(core.lower()), kind | NUMBER | UNIT * bool(number["unit"])
    low = core.lower()
    if spelled := NUMBER_WORDS.get(low):
        return _hash(spelled), kind | NUMBER
    if "-" in low and all(part in NUMBER_WORDS for part in low.split("-")):
        return _hash(" ".join(NUMBER_WORDS[part] for part in low.split("-"))), kind | NUMBER
    kind |= UNIT * (low in UNITS)
    kind |= TITLE * (core[0].isupper() and core[1:] == low[1:])
    return _hash(low), kind


def templates(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the template hashes of its tokens, their own hashes, and which are placeholders.

    Numbers in digits or words, units after a number and capitalised words inside a sentence become
    placeholders of their type. Case and punctuation around words do not count; tokens of nothing else are left out.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    described = [_described(token) for token in coded.dictionary.to_pylist()]
    hashes = np.array([d[0] for d in described], np.uint64)
    kinds = np.array([d[1] for d in described], np.uint8)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for a, b in zip(bounds, bounds[1:], strict=False):
        value, kind = hashes[codes[a:b]], kinds[codes[a:b]]
        begins = np.ones(len(value), bool)
        begins[1:] = (kind[:-1] & ENDS) > 0
        # What follows a token that is left out still begins a sentence if that one ended one.
        full = value != 0
        value, kind, begins = value[full], kind[full], begins[full]
        after_number = np.zeros(len(value), bool)
        after_number[1:] = (kind[:-1] & NUMBER) > 0
        number, unit = (kind & NUMBER) > 0, (kind & UNIT) > 0
        named = ((kind & TITLE) > 0) & ~begins
        template = np.where(named, _NAME_MARK, value)
        template = np.where(unit & after_number & ~number, _UNIT_MARK, template)
        template = np.where(number, np.where(unit, _AMOUNT_MARK, _NUMBER_MARK), template)
        yield template, value, template != value


def _rolling(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    hashes = np.full(max(0, len(values) - width + 1), seed, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            hashes = hashes * _BASE + values[k : k + len(hashes)]
    return mix64(hashes)


def _windows(template: np.ndarray, slot: np.ndarray, width: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of template windows with enough words, and their hashes."""
    before = np.concatenate([[0], np.cumsum(~slot)])
    n = max(0, len(template) - width + 1)
    at = np.flatnonzero(before[width : width + n] - before[:n] >= min_words)
    return at, _rolling(template, width, 0)[at]


def _item_class(keys: np.ndarray, numbers: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(keys.tobytes() + numbers.astype(np.int64).tobytes()) - (1 << 63)


def item_windows(template: np.ndarray, value: np.ndarray, slot: np.ndarray, width: int, min_words: int) -> tuple[int, int, bool, np.ndarray, np.ndarray, list]:
    """Class of one item, and of its windows the width, whether they are literal, positions, hashes and slots.

    The values of its slots are numbered in the order they first occur. An item shorter than a
    window, or with too few words in all of its windows, is taken literally, with numbers and names
    as they are; one of fewer than ``min_words`` tokens has no windows.
    """
    at, hashes = _windows(template, slot, width, min_words)
    if len(at):
        _, first, codes = np.unique(value[slot], return_index=True, return_inverse=True)
        numbers = np.zeros(len(value), np.int64)
        numbers[slot] = np.argsort(np.argsort(first))[codes]
        return _item_class(template, numbers[slot]), width, False, at, hashes, [numbers[a : a + width][slot[a : a + width]] for a in at.tolist()]
    size = min(width, len(value))
    if size < min_words:
        return 0, size, True, np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    hashes = _rolling(value, size, size)
    return _item_class(value, np.array([-1])), size, True, np.arange(len(hashes)), hashes, [np.zeros(0, np.int64)] * len(hashes)


def _item_rows(items: DataFrame, width: int, min_words: int) -> DataFrame:
    """Rows ``(item, class, at, size, literal, window, theirs, reach, tokens)`` for the windows of rows ``(item, text)``.

    ``reach`` counts the tokens of the item that windows cover.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "class", "at", "size", "literal", "window", "theirs", "reach", "tokens"]
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            for row, found in enumerate(templates(batch.column(1))):
                kind, size, literal, at, hashes, theirs = item_windows(*found, width, min_words)
                n, reach = len(at), len(np.unique(at[:, None] + np.arange(size)))
                if n:
                    same = [pa.array(np.full(n, x, np.int32)) for x in (size, reach, len(found[0]))]
                    columns = [batch.column(0).take(pa.array([row] * n)), pa.array([kind] * n, pa.int64()), pa.array(at.astype(np.int32)), same[0], pa.array(np.full(n, literal))]
                    columns += [pa.array(hashes.view(np.int64)), pa.array(theirs, pa.list_(pa.int64())), *same[1:]]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return items.mapInArrow(task, "item long, class long, at int, size int, literal boolean, window long, theirs array<long>, reach int, tokens int")


def _document_rows(docs: DataFrame, width: int, min_words: int, literal: Sequence[int], shown: np.ndarray) -> DataFrame:
    """Rows ``(id, mark, pos, window, slots)`` for the windows of rows ``(id, mark, text)`` that the map ``shown`` has.

    ``slots`` are the own hashes of a window's placeholders in order. Windows of the widths
    ``literal`` are taken literally as well.
    """
    seen = docs.sparkSession.sparkContext.broadcast(shown)

    def known(hashes: np.ndarray) -> np.ndarray:
        bit = hashes % np.uint64(MAP_BITS)
        return (seen.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            owner, pos, window, slots = [], [], [], []
            for row, (template, value, slot) in enumerate(templates(batch.column(2))):
                at, hashes = _windows(template, slot, width, min_words)
                kept = known(hashes)
                at, hashes = at[kept], hashes[kept]
                owner += [row] * len(at)
                pos.append(at)
                window.append(hashes)
                slots += [value[a : a + width][slot[a : a + width]].view(np.int64) for a in at.tolist()]
                for size in literal:
                    hashes = _rolling(value, size, size)
                    at = np.flatnonzero(known(hashes))
                    owner += [row] * len(at)
                    pos.append(at)
                    window.append(hashes[at])
                    slots += [[]] * len(at)
            if owner:
                mine = pa.array(owner)
                columns = [batch.column(0).take(mine), batch.column(1).take(mine), pa.array(np.concatenate(pos).astype(np.int32))]
                columns += [pa.array(np.concatenate(window).view(np.int64)), pa.array(slots, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "pos", "window", "slots"])

    return docs.mapInArrow(task, "id long, mark long, pos int, window long, slots array<long>")


def _map_of(windows: DataFrame) -> np.ndarray:
    """The windows as a bit map of fixed size; Spark sets the bits, the driver gets whole words of it."""
    bit = F.expr(f"pmod(window, {MAP_BITS})")  # as the unsigned remainder, for powers of two
    words = windows.groupBy((bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(window, {MAP_BITS}) % 64 AS INT))")).alias("bits"))
    found, out = words.toPandas(), np.zeros(MAP_BITS // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_order(pos: np.ndarray, at: np.ndarray) -> list[int]:
    """The most windows whose places increase in the document and in the item alike."""
    tails, ends, before = [], [], {}
    for k in np.lexsort((-at, pos)).tolist():
        place = bisect_left(tails, at[k])
        before[k] = ends[place - 1] if place else None
        tails[place : place + 1], ends[place : place + 1] = [at[k]], [k]
    chain, k = [], ends[-1] if ends else None
    while k is not None:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def covered_tokens(pos: np.ndarray, at: np.ndarray, slots: list, theirs: list, width: int) -> int:
    """Tokens of an item that windows of one document cover in its order, under one consistent filling of its slots.

    Goes through the longest chain of matching windows and keeps those whose placeholders agree with
    the ones kept: equal values stand for equal values and different for different ones.
    """
    there, back, covered = {}, {}, set()
    for k in in_order(pos, at):
        pairs = list(zip(theirs[k], slots[k], strict=False))
        if len(theirs[k]) != len(slots[k]) or any(there.get(a, b) != b or back.get(b, a) != a for a, b in pairs):
            continue
        for a, b in pairs:
            there[a], back[b] = b, a
        covered.update(range(at[k], at[k] + width))
    return len(covered)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))


def _leaked_classes(
    docs: DataFrame, benchmark: DataFrame, width: int, min_words: int, coverage: float, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, mark, class, covered)``, and the items of each class as rows ``(class, item)``."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    rows = settle(_item_rows(items, width, min_words), "benchmark-windows")
    theirs = settle(rows.drop("item").dropDuplicates(["class", "at"]), "benchmark-classes")
    literal = [row["size"] for row in theirs.where("literal").select("size").distinct().collect()]
    mine = _document_rows(_marked(docs, id_col, text_col), width, min_words, sorted(literal), _map_of(theirs))
    # Rows that repeat a row repeat its windows; they meet the items once. Ids are text, as pandas has no long with nulls.
    mine = mine.dropDuplicates(["mark", "pos", "window"]).withColumn("id", F.col("id").cast("string"))
    joined = mine.join(theirs.drop("literal"), "window")
    # The windows of one occurrence put its start less than the item's length apart; some cell holds them all.
    cell = F.floor((F.col("pos") - F.col("at")) / F.col("tokens"))
    joined = joined.withColumn("cell", F.explode(F.array(cell - 1, cell)))
    keys = ["mark", "class", "cell"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            bounds, out = group_bounds(frame, keys), []
            pos, at, size, reach = (frame[c].to_numpy() for c in ("pos", "at", "size", "reach"))
            slots, values = frame["slots"].tolist(), frame["theirs"].tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                share = covered_tokens(pos[a:b], at[a:b], slots[a:b], values[a:b], size[a]) / reach[a]
                if share >= coverage:
                    out.append((a, share))
            yield frame.iloc[[a for a, _ in out]][["id", "mark", "class"]].assign(covered=[s for _, s in out])

    sorted_rows = joined.repartition(*keys).sortWithinPartitions(*keys)
    found = sorted_rows.mapInPandas(task, "id string, mark long, class long, covered double")
    return found.groupBy("mark", "class").agg(F.first("id").cast("long").alias("id"), F.max("covered").alias("covered")), rows.select("class", "item").distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS, coverage: float = COVERAGE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows ``(id, mark, item, covered)``: documents that hold a benchmark item, maybe re-parameterised.

    Every window of every whole text is looked at. A bit map of fixed size, sent to the tasks,
    sorts out nearly all windows that no item has; the others are hash-joined with those of the
    items. A document leaks an item if consistent windows, in the item's order and near each
    other, cover at least ``coverage`` of those tokens of it that windows can cover. Windows are
    near if they put the start of the item into a stretch of at most twice its length; what one
    task holds of a document is bounded by the length of an item, however often the text repeats it.
    An item without any window of ``min_words`` words, or shorter than a window, must occur with
    its own numbers and names; of fewer than ``min_words`` tokens it matches nothing. Rows are told
    apart by id and text, so repeated ids are judged one by one. Null and empty texts and items
    match nothing; an empty table on either side gives no rows. Other columns are not read.
    """
    found, members = _leaked_classes(docs, benchmark, width, min_words, coverage, id_col, text_col, item_col, item_text_col)
    return found.join(members, "class").select("id", "mark", "item", "covered")


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows ``(<id_col>, contaminated, item_ids)``, one for each row of ``docs``; items ascending."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    items = found.groupBy("mark").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    marks = docs.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(id_col, text_col).alias("mark"))
    return marks.join(items, "mark", "left").select(
        id_col, F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that leak an item of ``benchmark``; all columns stay."""
    chosen = {"width": WIDTH, "min_words": MIN_WORDS, "coverage": COVERAGE, "item_col": "item_id", "item_text_col": "text"} | options
    found, _ = _leaked_classes(docs, benchmark, id_col=id_col, text_col=text_col, **chosen)
    marks = settle(found.select("mark").distinct(), "leaks")
    own = F.xxhash64(id_col, text_col)
    return docs.join(marks, own == marks["mark"], "left_anti")
