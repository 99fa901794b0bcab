import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablekeep.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    found = {}
    for word, n in counts.items():
        near = [(-counts[o], o) for o in counts if one_edit(word, o)]
        form = min(near)[1] if near and -min(near)[0] >= ratio * n else None
        found[word] = (form, n, len(near), counts[form] if form else None)
    rows = []
    for word, (form, n, near, form_n) in found.items():
        root = word
        while found[root][0]:
            root = found[root][0]
        rows.append((word, form, root, n, near, form_n))
    return sorted(rows, key=repr)


def damaged(draw, word):
    at = draw.randrange(len(word))
    return draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("aeÿÀ") + word[at:], word[:at] + draw.choice("xyà") + word[at + 1 :]])


def corpus(draw, n):
    counts = {}
    for _ in range(n):
        word = "".join(draw.choices("abcdeàÀ", k=draw.randrange(4, 9)))
        for _ in range(6):
            counts[word] = draw.choice([2, 3, 5, 20, 40, 400, 4000])
            word = damaged(draw, word) or "ab"
    return {word: n for word, n in counts.items() if word}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abÀà", min_size=5, max_size=5), min_size=1, max_size=40, unique=True), st.sampled_from([1, 2]))
def test_near_words_of_any_words(words, kind):
    asked = words if kind == spelling.SAME_LENGTH else [w + "a" for w in words] + ["b" + w for w in words]
    index, bucket = spelling.NearWords, spelling.BUCKET_WORDS
    try:
        spelling.BUCKET_WORDS = 3
        found = {(int(a), int(b)) for at, to in index(words).of(kind, asked) for a, b in zip(at, to, strict=True)}
    finally:
        spelling.BUCKET_WORDS = bucket
    assert found == {(a, b) for a, x in enumerate(asked) for b, y in enumerate(words) if one_edit(x, y)}


@pytest.mark.parametrize("leaf", [1 << 14, 20])
def test_same_variants_as_brute_force(spark, monkeypatch, leaf):
    counts = corpus(random.Random(leaf), 120)
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    words = spark.createDataFrame([(w, n, 1, 2) for w, n in counts.items()], "word string, n long, size int, part int").repartition(3)
    assert sorted(map(tuple, spelling.variants(words).collect()), key=repr) == plain(counts)


def test_more_words_of_equal_letters_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF_WORDS", 4)
    draw = random.Random(5)
    counts = {"".join(draw.sample("abcdef", 6)): 2 for _ in range(80)} | {"abcdee": 50, "bcdef": 900}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(words).collect()), key=repr) == plain(counts)


def test_a_chain_of_forms_ends_at_its_last(spark):
    counts = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000, "zzzzzzzz": 7, "zzzzzzzy": 69}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(words).collect()}
    assert rows["aaaaaaaa"] == ("aaaaaaab", "aaaabbbb") and rows["zzzzzzzz"] == (None, "zzzzzzzz")


def test_words_of_documents_with_nulls_ties_and_long_runs(docs_of):
    rows = [(1, "Wörterbuch WÖRTERBUCH wörterbuch; x1 letters7letters"), (2, None), (3, ""), (None, "letters wörterbuch"), (2, "12 \n ?"), (1, "Wörterbuch"), (5, "y" * 100_000 + " " + "Y" * 100_000)]
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    docs = docs_of(rows).repartition(2)
    assert sorted(map(tuple, spelling.corpus_variants(docs).collect()), key=repr) == plain(counts)
    assert spelling.corpus_variants(docs.limit(0)).collect() == []


def test_every_31st_word_loses_a_letter(docs_of):
    rows = [(i, "unbelievable circumstances notwithstanding") for i in range(120)]
    counts: Counter = Counter()
    for doc, text in rows:
        for run in text.split():
            h = zlib.crc32(f"{doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert len(counts) > 3
    assert {r["word"]: r["n"] for r in spelling.damaged_runs(docs_of(rows)).collect()} == dict(counts)


def test_ratio_must_be_above_one(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)
