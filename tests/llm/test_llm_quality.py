import numpy as np
import pyarrow as pa

from tablekeep.llm import quality

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_labels_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.classified(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_votes_are_weighed_by_similarity():
    vectors = np.eye(3, dtype=np.float32)
    texts = pa.array(["good words here", "bad!! words!!", None])
    counts = quality.term_counts(texts)
    model = quality.Model(np.zeros((quality.BUCKETS, 3), np.float32), vectors, np.array([1.0, 0.0, 0.5]), 0.25)
    assert quality.votes(model, texts).tolist() == [0.25] * 3
    basis = np.zeros((quality.BUCKETS, 3), np.float32)
    basis[counts[0] > 0, 0] = 1
    basis[(counts[1] > 0) & (counts[0] == 0), 1] = 1
    scores = quality.votes(quality.Model(basis, vectors, np.array([1.0, 0.0, 0.5]), 0.25), texts)
    assert scores[0] == 1 and scores[1] < 0.5 and scores[2] == 0.25


def test_terms():
    counts = quality.term_counts(pa.array(["a a b", None, "", " \n", "a"]))
    assert counts.shape == (5, quality.BUCKETS)
    assert counts.sum(axis=1).tolist() == [9 + 1 + 3, 0, 0, 0, 3 + 1]


GOOD, BAD = "a quiet sentence with several plain words", "BUY!! NOW!! CHEAP!! OFFER!! BUY!! NOW!!"


def test_nulls_empty_texts_and_repeats(docs_of):
    docs = docs_of([*[(k, (GOOD if k % 2 else BAD) + " x" * (k % 5)) for k in range(40)], (50, None), (51, ""), (None, GOOD), (1, GOOD), (1, GOOD)])
    labels = docs_of([*[(k, k % 2) for k in range(40)], (1, 1), (50, 1), (77, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.classified(docs, labels).collect()
    assert len(rows) == 45
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["predicted"] == 1 and by[2]["predicted"] == 0 and by[None]["predicted"] == 1 and by[None]["held_out"] is False
    assert by[50]["score"] == by[51]["score"]
    assert quality.classified(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.classified(docs, labels.limit(0)).collect()} == {0.5}


def test_at_most_so_many_labelled_documents(docs_of):
    docs = docs_of([(k, f"{GOOD} {k}") for k in range(30)])
    model = quality.fit(docs, docs_of([(k, 1) for k in range(30)], "doc_id long, quality int"), labelled=10)
    assert len(model.labels) == 10


def test_the_model_is_bounded_when_ids_repeat(docs_of, spark):
    rows = [(7, f"text number {k}") for k in range(300)] + [(k, f"other words {k}") for k in range(20, 30)]
    labels = spark.createDataFrame([(7, 1), *((k, 0) for k in range(20, 30))], "doc_id long, quality int")
    model = quality.fit(docs_of(rows).repartition(4), labels, labelled=5)
    assert len(model.labels) == 5
    assert len(quality.fit(docs_of(rows), labels).labels) == 11
