import random

import numpy as np
import pyarrow as pa

from tablekeep.llm import language

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.identified(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) > 100
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_expectation_maximisation_finds_the_shares():
    draw = np.random.default_rng(1)
    likely = np.log(np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]))
    word = draw.choice(2, size=3000, p=[0.7, 0.3])
    scores = likely[[draw.choice(3, p=np.exp(likely[w])) for w in word]]
    chosen, share = language.mixture(scores, np.ones(len(scores)))
    assert chosen == [0, 1]
    assert abs(share[0] - 0.7) < 0.05
    assert language.mixture(scores[word == 0][:50], np.ones(int(min(50, (word == 0).sum()))))[0] == [0]


def test_grams_of_a_word_do_not_depend_on_its_neighbours():
    alone, _ = language._grams(pa.array(["ab"]), 1 << 16)
    among, bounds = language._grams(pa.array(["x", "ab", "y"]), 1 << 16)
    assert among[bounds[1] : bounds[2]].tolist() == alone.tolist() and len(alone) == 3


def rows_of(texts):
    return [(k, t, lang) for k, (t, lang) in enumerate(texts)]


TEXTS = [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20 + [(None, "en"), ("", "de"), ("12 !!", "en"), ("the dog", None)]


def test_nulls_texts_without_letters_and_mixtures(docs_of):
    docs = docs_of([*rows_of(TEXTS), (None, "the dog and the cat", "en"), (1, "der hund", "de"), (1, "der hund", "de")], "doc_id long, text string, lang string")
    rows = language.identified(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(TEXTS) + 3
    assert [by[k]["lang_pred"] for k in (0, 40, 41, 42, 43)] == ["en", "und", "und", "und", "en"]
    assert by[40]["score"] == 0 and by[40]["languages"] == [] and by[0]["score"] > 0.5
    assert by[None]["lang_pred"] == "en" and by[None]["held_out"] is False
    mixed = docs_of([(1, "the cat and the dog " * 40 + "der hund und die katze " * 20, "en")], "doc_id long, text string, lang string")
    (row,) = language.predicted(mixed, language.train(docs)).collect()
    assert row["languages"] == ["en", "de"] and abs(row["shares"][0] - 0.667) < 0.1


def test_no_rows_and_no_languages(docs_of):
    docs = docs_of(rows_of(TEXTS), "doc_id long, text string, lang string")
    assert language.identified(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.predicted(docs, language.train(docs.limit(0))).collect()} == {"und"}


def test_the_stage_drops_what_has_no_language(docs_of):
    docs = docs_of(rows_of(TEXTS), "doc_id long, text string, lang string")
    kept = language.with_language(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 43]
    assert language.with_language(docs.limit(0)).collect() == []


def test_texts_that_no_language_explains_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(8)
    letters = "qxzjkwvßðþøæ"
    noise = [(10_000_000 + k, " ".join("".join(draw.choices(letters, k=9)) for _ in range(40)), None) for k in range(8)]
    mixed = [(20_000_000, "the attion and of wherethe, token = " + "0a1b2c3d" * 5, None)]
    added = docs.unionByName(spark.createDataFrame([*noise, *mixed], docs.schema))
    kept = {r["doc_id"] for r in language.with_language(added).select("doc_id").collect()}
    assert not kept & {row[0] for row in noise} and 20_000_000 in kept
    with_letters = {r["doc_id"] for r in docs.where("text RLIKE '\\\\p{L}'").select("doc_id").collect()}
    assert with_letters == kept - {20_000_000}


def test_nothing_is_rejected_where_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert language.with_language(docs).count() == 2
