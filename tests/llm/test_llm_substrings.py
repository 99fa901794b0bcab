import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from checks.compare import difference, duck
from tablekeep.llm import queries, substrings

SF_DIR = "/root/testdata/sf0.001"


def brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[p : p + length]) for w in words for p in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if counts[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(draw, n, vocabulary):
    texts = []
    for _ in range(n):
        words = draw.choices(vocabulary, k=draw.randrange(60))
        if texts and draw.random() < 0.6:
            other = draw.choice(texts).split()
            a = draw.randrange(len(other) + 1)
            words[draw.randrange(len(words) + 1) : 0] = other[a : a + draw.randrange(30)]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed,vocabulary,length,anchor", [(1, "abc", 7, 3), (2, "abcdefghij", 8, 8), (3, [f"w{k}" for k in range(500)], 9, 2), (4, "a", 6, 3), (5, "ab", 5, 1)])
def test_equal_to_brute_force(docs_of, seed, vocabulary, length, anchor):
    texts = [*rows_of(random.Random(seed), 40, list(vocabulary)), None, "", " \n", "x y\x0bz"]
    texts.append(texts[3])
    rows = substrings.deduplicated(docs_of(list(enumerate(texts))).repartition(3), length, anchor).collect()
    mine = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert mine == dict(enumerate(brute(texts, length)))


def test_repeated_rows_null_ids_and_no_rows(docs_of):
    text = " ".join(f"w{k}" for k in range(12))
    docs = docs_of([(1, text), (1, text), (None, text), (2, "other words")])
    rows = substrings.deduplicated(docs, 10, 4).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rows) == [(0, 12, 12), (1, 12, 12), (1, 12, 12), (2, 2, 0)]
    assert substrings.deduplicated(docs.limit(0)).collect() == []
    cleaned = substrings.cleaned(docs, 10, 4)
    assert cleaned.columns == docs.columns
    assert sorted(r["text"] for r in cleaned.collect()) == ["", "", "", "other words"]


def test_anchors_fit_into_a_repeat(docs_of):
    with pytest.raises(ValueError, match="anchor"):
        substrings.deduplicated(docs_of([(1, "a")]), 5, 6)


def test_query_equals_sql(spark):
    assert difference(queries.op6_substrings(spark, SF_DIR), duck(SF_DIR), queries.ORACLES["op6_substrings"]) is None


def test_words_are_those_between_ascii_white_space():
    draw = random.Random(5)
    texts = [None, "", " ", "\x0b", *("".join(draw.choice("ab é\x0b\x0c\t\n\r\x1c\x1f\x85  \0") for _ in range(draw.randrange(30))) for _ in range(500))]
    found = substrings._words(pa.array([t and t.encode() if t else t and b"" for t in texts], pa.binary()).slice(2))
    assert [[w.encode() for w in words or []] for words in found.to_pylist()] == [(t or "").encode().split() for t in texts[2:]]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 26])
def test_smallest_of_neighbours_is_the_first(width, monkeypatch):
    monkeypatch.setattr(substrings, "STEP", 10)
    draw = np.random.default_rng(width)
    for n in (width, width + 1, 9, 10, 11, 57, 300):
        hashes = draw.integers(0, 9, n + width).astype(np.uint64)
        views = np.lib.stride_tricks.sliding_window_view(hashes, width)
        assert (substrings._smallest(hashes, width) == np.arange(len(views)) + views.argmin(axis=1)).all()
        grams = substrings._rolling(hashes, 1, substrings._BASE)
        starts, at, _ = substrings.winnowed(hashes, np.array([0, len(hashes)]), width, 1)
        views = np.lib.stride_tricks.sliding_window_view(grams, width)
        assert (at == starts + views.argmin(axis=1)).all() and len(starts) == len(views)


def test_a_very_long_text(docs_of):
    passage = " ".join(f"p{k}" for k in range(50))
    long = " ".join(f"w{k % 700001}x{k // 700001}" for k in range(1_200_000))
    rows = substrings.deduplicated(docs_of([(1, f"{long} {passage}"), (2, f"a {passage} b")])).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in rows} == {(1, 1_200_050, 50), (2, 52, 50)}
