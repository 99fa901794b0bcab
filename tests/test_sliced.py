"""Sliced computations against brute force, with one group holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tablekeep.plans.chunks import chunk_plan
from tablekeep.plans.sliced import last_before, next_after, running_sum, slice_rows


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows, seen = [], set()
    while len(rows) < 3000:
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(40)}"
        at = int(rng.paretovariate(0.5) * 10) % 10**9 if rng.random() < 0.7 else 500
        row = (group, at, len(rows), rng.choice([None, 1, 5, 9]))
        if row[:3] not in seen:
            seen.add(row[:3])
            rows.append(row)
    return rows


@pytest.fixture(scope="module", params=[600, 1 << 28])
def frame(request, spark, data):
    """Rows in many slices, and in a single one."""
    df = spark.createDataFrame(data, "g string, at long, id long, v long").repartition(7)
    return slice_rows(df, ["g", "at", "id"], slice_bytes=request.param)


def by_group(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def collected(df, out):
    return {r["id"]: r[out] for r in df.collect()}


def test_slices_follow_the_order(frame):
    order = F.struct("g", "at", "id")
    pairs = frame.groupBy("_slice").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).orderBy("_slice").collect()
    assert len(pairs) == 1 or len(pairs) > 20
    assert all(tuple(a["hi"]) < tuple(b["lo"]) for a, b in zip(pairs, pairs[1:]))


def test_running_sum_and_rank(frame, data):
    total, newest_first = {}, {}
    for rows in by_group(data).values():
        running = 0
        for i, row in enumerate(rows):
            running += row[3] or 0
            total[row[2]], newest_first[row[2]] = running, len(rows) - i
    order = ["at", "id"]
    assert collected(running_sum(frame, ["g"], order, "_slice", F.col("v"), "out"), "out") == total
    rank = running_sum(frame, ["g"], order, "_slice", F.lit(1), "out", descending=True)
    assert collected(rank, "out") == newest_first


def test_last_before_and_next_after(frame, data):
    last, following = {}, {}
    for rows in by_group(data).values():
        seen = None
        for i, row in enumerate(rows):
            last[row[2]] = seen
            seen = row[3] if row[3] is not None else seen
            following[row[2]] = rows[i + 1][3] if i + 1 < len(rows) else None
    assert collected(last_before(frame, ["g"], ["at", "id"], "_slice", F.col("v"), "out"), "out") == last
    assert collected(next_after(frame, ["g"], ["at", "id"], "_slice", F.col("v"), "out"), "out") == following


def test_many_slices(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).alias("k"), F.lit(3).alias("n"))
    got = chunk_plan(df, "k", "n", 100, slice_bytes=150).orderBy("k").collect()
    assert [r["chunk_id"] for r in got] == [3 * i // 100 for i in range(5000)]


def test_any_key_and_null_keys(spark):
    rows = [("b", 2, 5), ("a", 9, 5), (None, 1, 5), ("b", 1, 5), ("a", None, None)]
    df = spark.createDataFrame(rows, "t string, i long, n long")
    got = chunk_plan(df, ["t", "i"], "n", 10, slice_bytes=6).collect()
    assert {(r["t"], r["i"]): r["chunk_id"] for r in got} == {(None, 1): 0, ("a", None): 0, ("a", 9): 0, ("b", 1): 1, ("b", 2): 1}


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "k long, n long")
    assert chunk_plan(empty, "k", "n", 10).count() == 0
    single = spark.createDataFrame([(5, 100)], "k long, n long")
    assert [tuple(r) for r in chunk_plan(single, "k", "n", 10).collect()] == [(5, 100, 0)]


def test_chunks_are_bounded(spark):
    df = spark.createDataFrame([(i, (i * 37) % 91) for i in range(2000)], "k long, n long")
    sizes = chunk_plan(df, "k", "n", 1000).groupBy("chunk_id").agg(F.sum("n").alias("s"), F.max("n").alias("m")).collect()
    assert all(r["s"] < 1000 + 91 for r in sizes)
