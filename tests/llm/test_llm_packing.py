import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablekeep.llm import packing
from tablekeep.llm.settings import VOCABULARY

TEXTS = ["", None, "Hello  world", "a<|endoftext|>b", "漢字 🙂 ½²", "\n\n x\ty", "don't I'll 123 4,5", "word " * 3000, "zß éÄ " * 1500]


def test_ids_are_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    blank = " " * 1_500_000
    for text in [*TEXTS, f"a{blank}b <|endoftext|>{blank}", "\n" * 1_500_000]:
        assert packing.token_ids(VOCABULARY, text or "") == tokenizer.encode(text or "", add_special_tokens=False).ids
    plain = packing.token_ids(VOCABULARY, "a <|endoftext|> b", special=False)
    assert packing.token_ids(VOCABULARY, f"a <|endoftext|> b{blank}", special=False)[: len(plain)] == plain


def test_only_the_first_piece_may_be_shorter():
    assert packing.cuts(1024, 1024) == [0]
    assert packing.cuts(1025, 1024) == [0, 1]
    assert packing.cuts(2048, 1024) == [0, 1024]
    assert packing.cuts(1, 1024) == [0]


@pytest.mark.parametrize("rule", [packing.sum_of_squares, packing.best_fit, packing.pack_lengths])
def test_bins_have_no_gaps_and_are_never_overfull(rule):
    lengths = np.array(sorted(random.Random(1).choices(range(1, 65), k=400), reverse=True))
    bins, offsets = rule(lengths, 64)
    for one in np.unique(bins):
        at = np.argsort(offsets[bins == one])
        inside = lengths[bins == one][at]
        assert inside.sum() <= 64
        assert offsets[bins == one][at].tolist() == [0, *np.cumsum(inside)[:-1].tolist()]


def test_the_rule_takes_the_smallest_sum_of_squares():
    capacity, lengths = 12, np.array([7, 6, 5, 5, 4, 3, 3, 2, 2, 1, 1])
    bins, _ = packing.sum_of_squares(lengths, capacity)
    fill: list[int] = []
    for size, which in zip(lengths.tolist(), bins.tolist(), strict=True):
        def squares(levels):
            gaps = [capacity - level for level in levels if level < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = [squares([*fill[:k], level + size, *fill[k + 1 :]]) for k, level in enumerate(fill) if level + size <= capacity]
        options.append(squares([*fill, size]))
        if which == len(fill):
            fill.append(0)
        fill[which] += size
        assert squares(fill) == min(options)


def test_few_sequences():
    lengths = np.array(sorted(random.Random(2).choices(range(1, 1025), k=3000), reverse=True))
    bins, _ = packing.pack_lengths(lengths, 1024)
    best_fit, _ = packing.best_fit(lengths, 1024)
    assert len(np.unique(bins)) <= 1.01 * len(np.unique(best_fit))


def test_pack_places_every_piece_once(spark, docs_of):
    docs = docs_of([*enumerate(TEXTS), (None, "no id"), (2, "Hello  world"), (2, "Hello  world")]).repartition(3)
    rows = packing.pack(docs, VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for k, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        if k == 2:
            assert len(mine) == 3
            continue
        assert [r["start"] for r in mine] == packing.cuts(len(ids), 1024)
        for r in mine:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
    assert sum(r["doc_id"] is None for r in rows) == 1
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []


def test_sequences_hold_the_tokens(docs_of):
    docs = docs_of(list(enumerate(TEXTS)))
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in TEXTS)
    rows = packing.sequences(docs, VOCABULARY).collect()
    assert sum(len(r["ids"]) for r in rows) == expected
    assert max(len(r["ids"]) for r in rows) <= 1024
