import numpy as np
import pandas as pd
import pyarrow as pa

from tablekeep.llm import common
from tablekeep.llm.graph import components


def test_groups_are_never_divided():
    frame = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    for size in (1, 2, 4, 6):
        parts = list(common.whole_groups((frame.iloc[a : a + size] for a in range(0, 6, size)), ["k"]))
        assert pd.concat(parts)["v"].tolist() == list(range(6))
        seen = [k for part in parts for k in part["k"].unique()]
        assert len(seen) == len(set(seen))
    assert list(common.whole_groups(iter([frame.iloc[:0]]), ["k"])) == []


def test_bounds_and_sums():
    frame = pd.DataFrame({"a": [1, 1, 1, 2], "b": [1, 2, 2, 2]})
    assert common.group_bounds(frame, ["a", "b"]).tolist() == [0, 1, 3, 4]
    assert common.group_bounds(frame.iloc[:0], ["a"]).tolist() == [0]
    assert common.segment_sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "", "b" * 50, "c"])], names=["t"])
    parts = list(common.text_slices(batch, 0, 10))
    assert [part.num_rows for part in parts] == [3, 1, 1]
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert [part.num_rows for part in common.text_slices(batch, 0, 1000, 2)] == [2, 2, 1]
    assert list(common.text_slices(batch.slice(0, 0), 0)) == []


def test_words_lie_between_ascii_white_space():
    bounds, codes, words = common.ascii_words(pa.array(["a\x0bb c a".encode(), None, b" \n"], pa.binary()))
    assert bounds.tolist() == [0, 3, 3, 3]
    assert [words[c] for c in codes] == [b"a", "b c".encode(), b"a"]


def test_components_of_long_paths_stars_and_repeats(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*path, *star, (1, 1), (200, 7), (300, 5), (None, 3)], "a long, b long")
    found = {row["node"]: row["component"] for row in components(edges).collect()}
    assert found == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]} | {5: 5, 300: 5}
    assert components(edges.limit(0)).collect() == []
