import math
from collections import Counter

import pytest

from tablekeep.llm import lm
from tablekeep.llm.packing import _encoding
from tablekeep.llm.settings import VOCABULARY

ROWS = [(1, "the cat and the dog and the cat"), (2, "the cat sat"), (3, None), (4, ""), (5, "zebra"), (None, "the dog"), (2, "the cat sat"), (6, "a a a a a")]


def brute(texts, order, others_only):
    tokens = [_encoding(VOCABULARY).encode_ordinary(t or "") for t in texts]
    counts = [Counter(tuple(x[i : i + k]) for k in range(1, order + 1) for i in range(len(x) - k + 1)) for x in tokens]
    everything, n = sum(counts, Counter()), sum(map(len, tokens))
    out = []
    for x, own in zip(tokens, counts, strict=True):
        seen = everything - own if others_only else everything
        total, score = n - len(x) * others_only, 0.0
        for j in range(len(x)):
            longest = min(order, j + 1)
            value = 0.4**longest / max(1, total)
            for k in range(1, longest + 1):
                gram = tuple(x[j - k + 1 : j + 1])
                if seen[gram]:
                    value = 0.4 ** (longest - k) * seen[gram] / (seen[gram[:-1]] if k > 1 else total)
            score += math.log(value)
        out.append((len(x), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("others_only", [True, False])
def test_scores_equal_brute_force(docs_of, order, others_only):
    rows = lm.scored(docs_of(ROWS).repartition(3), VOCABULARY, order=order, others_only=others_only, slice_bytes=16).collect()
    mine = sorted(((r["doc_id"] or 0, r["n_tokens"], round(r["log_score"], 9)) for r in rows))
    expected = sorted((i or 0, n, round(s, 9)) for (i, _), (n, s) in zip(ROWS, brute([t for _, t in ROWS], order, others_only), strict=True))
    assert mine == expected
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in rows)


def test_empty_table_and_wrong_order(docs_of):
    assert lm.scored(docs_of(ROWS).limit(0), VOCABULARY).collect() == []
    with pytest.raises(ValueError, match="order"):
        lm.scored(docs_of(ROWS), VOCABULARY, order=4)


def test_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in lm.scored(docs, VOCABULARY, slice_bytes=1 << 17).collect()}
    for (i, _), (n, score) in zip(texts.items(), brute(list(texts.values()), 3, True), strict=True):
        assert rows[i]["n_tokens"] == n and math.isclose(rows[i]["log_score"], score, rel_tol=1e-9)


def test_many_repeated_rows_count_each_time(docs_of):
    rows = [(k % 3 or None, "the cat and the dog") for k in range(3000)] + [(9, "a zebra")]
    found = lm.scored(docs_of(rows).repartition(5), VOCABULARY, slice_bytes=1 << 10).collect()
    assert len(found) == 3001
    expected = brute([t for _, t in rows[-2:]], 3, False)
    everything = 3000 * expected[0][0] + expected[1][0]
    assert {r["n_tokens"] for r in found} == {n for n, _ in expected}
    scores = {round(r["log_score"], 9) for r in found if r["doc_id"] != 9}
    tokens = _encoding(VOCABULARY).encode_ordinary(rows[0][1])
    counts = Counter(tuple(tokens[i : i + k]) for k in (1, 2, 3) for i in range(len(tokens) - k + 1))
    value = sum(math.log(counts[tuple(tokens[max(0, j - 2) : j + 1])] / counts[tuple(tokens[max(0, j - 2) : j])]) if j else math.log(2999 * counts[tuple(tokens[:1])] / (everything - len(tokens))) for j in range(len(tokens)))
    assert scores == {round(value, 9)}
