import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tablekeep.llm import simhash


def plain(text, width=3):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abÄ AB\n\t\x0b ß", max_size=80))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.encode(), 3) % (1 << 64) == plain(text)


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(random.Random(3).choices(["a", "b", "cc", "D"], k=500))
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text.encode(), 3) % (1 << 64) == plain(text)


def test_masks_catch_every_close_pair():
    masks, draw = simhash.block_masks(3, 6), random.Random(5)
    assert len(masks) == 20
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def brute(prints, distance):
    group = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    return group


def test_links_keep_every_component(spark):
    draw = random.Random(7)
    base = [draw.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << bit for bit in draw.sample(range(64), draw.randrange(6))) for b in base for _ in range(25)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    reps = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, rep long")
    expected = brute(prints, 3)
    for tile_rows in (4, 1024):
        edges = [tuple(r) for r in simhash.links(reps, 3, 6, tile_rows).collect()]
        assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in edges)
        group = list(range(len(prints)))
        for a, b in edges:
            group = [group[a] if g == group[b] else g for g in group]
        assert len(set(group)) == len(set(expected))
        assert len(set(zip(group, expected, strict=True))) == len(set(expected))


ROWS = [
    (5, "one two three four five six seven eight nine ten"),
    (3, "ONE two three four five six seven eight nine ten"),
    (9, "something else entirely is written in this other text here"),
    (8, None), (4, ""), (6, " \n\t"), (None, "one two three four five six seven eight nine ten"), (9, "something else entirely is written in this other text here"),
]


def test_near_duplicates_with_nulls_empty_texts_and_repeats(docs_of):
    docs = docs_of(ROWS).repartition(3)
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(5, 3), (3, 3), (9, 9), (9, 9), (8, 4), (4, 4), (6, 4), (None, None)], key=repr)
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}
    assert prints[4] == prints[8] == "0" * 16 and prints[5] == f"{plain(ROWS[0][1]):016x}"
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_document_of_each_group_stays(docs_of):
    kept = simhash.deduplicated(docs_of(ROWS)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == [3, 4, 9, None]
    assert all(r["window"] == 7 for r in kept)


def test_same_components_as_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(simhash.near_duplicates(docs).collect())
    prints = [int(r["fingerprint"], 16) for r in rows]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert prints == [plain(texts[r["doc_id"]]) for r in rows]
    group = brute(prints, 3)
    first: dict = {}
    for g, r in zip(group, rows, strict=True):
        first[g] = min(first.get(g, 1 << 60), r["doc_id"])
    assert [r["component_id"] for r in rows] == [first[g] for g in group]


def test_only_linked_rows_of_one_id_go(docs_of):
    first, other = ROWS[0][1], ROWS[2][1]
    kept = simhash.deduplicated(docs_of([(1, first), (1, other), (2, first.upper()), (2, None), (1, first)])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, first), (1, other), (2, None)], key=repr)
