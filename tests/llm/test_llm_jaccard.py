import random

import numpy as np
import pytest

from tablekeep.llm import jaccard


def plain_set(text, width):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain(rows, width=4, percent=85):
    sets = [plain_set(text, width) for _, text in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for g, (doc, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, doc), doc)
    return sorted((doc, len(s), least[g]) for g, s, (doc, _) in zip(group, sets, rows, strict=True))


def copies(draw, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(edits + 1)):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([[], [f"new{draw.random()}"], [words[at], "more"]])
        yield " ".join(words)


def test_same_components_as_brute_force(docs_of, monkeypatch):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = draw.choices(vocabulary, k=40)
    texts = []
    for size in (12, 60, 61, 200):
        for _ in range(3):
            texts += copies(draw, draw.choices(vocabulary, k=size), 25, 4)
    texts += [" ".join([*shared, *draw.choices(vocabulary, k=k)]) for k in range(1, 60)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    for tile_rows, heavy in ((1024, 1 << 16), (7, 50)):
        monkeypatch.setattr(jaccard, "TILE_ROWS", tile_rows)
        monkeypatch.setattr(jaccard, "HEAVY", heavy)
        found = sorted(map(tuple, jaccard.near_duplicates(docs_of(rows).repartition(3)).collect()))
        assert found == plain(rows)


def test_threshold_is_met_exactly(docs_of):
    words = [f"x{i}" for i in range(20)]
    rows = [(4, " ".join(words)), (2, " ".join(words[:-3])), (3, " ".join(words[:-4]))]
    # 14 of 17 shingles are below 85 in a hundred; 13 of 14 are above.
    assert plain(rows) == [(2, 14, 2), (3, 13, 2), (4, 17, 4)]
    assert sorted(map(tuple, jaccard.near_duplicates(docs_of(rows)).collect())) == plain(rows)


def test_nulls_empty_short_and_repeated_rows(docs_of):
    rows = [(9, "One two"), (7, "one\ttwo"), (8, "two one"), (3, None), (5, ""), (6, " \x0b\n"), (9, "One two"), (4, "one two three four five"), (4, "entirely other words stand here")]
    found = jaccard.near_duplicates(docs_of([*rows, (None, "one two")]).repartition(4))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    expected = [(3, 0, 3), (4, 2, 4), (4, 2, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 8), (9, 1, 7), (9, 1, 7), (None, 1, None)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert jaccard.near_duplicates(docs_of(rows).limit(0)).collect() == []


def test_one_very_long_text_and_its_copies(docs_of):
    draw = random.Random(2)
    words = [f"v{draw.randrange(5000)}" for _ in range(120_000)]
    rows = [(2, " ".join(words)), (1, " ".join([*words[:50_000], "between", *words[50_000:]])), (5, " ".join(words[:60_000])), (3, "v1 v2 v3 v4")]
    assert sorted(map(tuple, jaccard.near_duplicates(docs_of(rows)).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1), (3, 3), (5, 5)]


def test_frequent_values_are_too_low_by_a_bound_only():
    draw = np.random.default_rng(1)
    values = draw.zipf(1.3, 20_000).astype(np.uint64)
    summary = jaccard.FrequentValues(50)
    for part in np.array_split(values, 17):
        summary.add(part)
    true = dict(zip(*np.unique(values, return_counts=True), strict=True))
    kept = dict(zip(summary.values, summary.counts, strict=True))
    assert len(kept) <= 50
    assert all(true[v] - len(values) / 50 <= kept.get(v, 0) <= true[v] for v in true)


def test_parameters_are_checked(docs_of):
    for bad in ({"percent": 0}, {"percent": 101}, {"width": 0}):
        with pytest.raises(ValueError):
            jaccard.near_duplicates(docs_of([]), **bad)
