import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablekeep.operators import changes
from tablekeep.plans.sliced import slice_rows

LOG = "seq long, k long, op string, a string, b double"
BASE = "k long, a string, b double"


@pytest.fixture(scope="module")
def log_rows():
    rng = random.Random(11)
    return [(i, 7 if rng.random() < 0.4 else rng.randrange(60), rng.choice("IUUD"), rng.choice(["x", "y", None]), float(i)) for i in range(1000)]


def replay(base, log):
    state = {k: (a, b) for k, a, b in base}
    for _, key, op, a, b in sorted(log):
        if op == "D":
            state.pop(key, None)
        else:
            state[key] = (a, b)
    return state


@pytest.mark.parametrize("incremental", [False, True])
def test_replay(spark, log_rows, incremental):
    base = [(k, "old", -1.0) for k in range(30, 120)]
    log = spark.createDataFrame(random.Random(1).sample(log_rows, len(log_rows)), LOG).repartition(6)
    got = changes.apply_changes(spark.createDataFrame(base, BASE), log, "k", "seq", ("a", "b"), incremental=incremental)
    assert {r["k"]: (r["a"], r["b"]) for r in got.collect()} == replay(base, log_rows)
    assert got.count() == len(replay(base, log_rows))


def test_repeated_changes_do_no_harm(spark, log_rows):
    base = spark.createDataFrame([(1, "old", 0.0)], BASE)
    log = spark.createDataFrame(log_rows, LOG)
    once = changes.apply_changes(base, log, "k", "seq", ("a", "b"))
    twice = changes.apply_changes(base, log.union(log.where("seq < 500")), "k", "seq", ("a", "b"))
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_several_key_columns(spark):
    base = spark.createDataFrame([(1, "p", 1.0), (1, "q", 2.0)], "k long, part string, b double")
    log = spark.createDataFrame([(1, 1, "q", "D", 0.0), (2, 2, "p", "I", 5.0)], "seq long, k long, part string, op string, b double")
    for incremental in (False, True):
        got = changes.apply_changes(base, log, ["k", "part"], "seq", ("b",), incremental=incremental)
        assert {tuple(r) for r in got.collect()} == {(1, "p", 1.0), (2, "p", 5.0)}


def test_small_logs_leave_the_base_in_place(spark):
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("a"), F.lit(1.0).alias("b"))
    log = spark.createDataFrame([(1, 5, "U", "z", 2.0)], LOG)
    got = changes.apply_changes(base, log, "k", "seq", ("a", "b"), incremental=True)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("slice_bytes", [500, 1 << 28])
def test_versions(spark, slice_bytes):
    start = datetime(2024, 1, 1)
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", start + timedelta(seconds=rng.randrange(300)), i) for i in range(800)]
    versions = spark.createDataFrame(data, "k string, ts timestamp_ntz, id long").repartition(4)
    following, newest, previous = {}, {}, {}
    for key, ts, i in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        if key in previous:
            following[previous[key]] = ts
        following[i] = None
        previous[key] = newest[key] = i
    got = changes.dump_view(versions, "k", "ts", history=True, tie="id", slice_bytes=slice_bytes).collect()
    assert {r["id"]: r["valid_to"] for r in got} == following
    assert {r["k"]: r["id"] for r in changes.dump_view(versions, "k", "ts", tie="id").collect()} == newest


def test_drift(spark):
    schema = "table string, max_seq long, max_ts long, n_rows long"
    before = spark.createDataFrame([("same", 1, None, 1), ("moved", 1, 1, 1), ("gone", 1, 1, 1)], schema)
    after = spark.createDataFrame([("same", 1, None, 1), ("moved", 2, 1, 1), ("new", 1, 1, 1)], schema)
    assert {r["table"] for r in changes.position_drift(before, after).collect()} == {"moved", "gone", "new"}


def test_views_without_dependencies_are_valid(spark):
    views = spark.createDataFrame([("a",), ("b",), ("c",)], "view string")
    deps = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "view string, object int")
    objects = spark.createDataFrame([(2,)], "object int")
    valid, quarantined = changes.invalid_views(views, deps, objects)
    assert {r[0] for r in valid.collect()} == {"b", "c"}
    assert {r[0] for r in quarantined.collect()} == {"a"}


@pytest.mark.parametrize("slice_bytes", [60, 1 << 28])
def test_versions_without_time_or_key(spark, slice_bytes):
    day = datetime(2024, 1, 1)
    rows = [("a", None, 1), ("a", None, 2), ("a", day, 3), (None, day, 4), (None, day, 5), (None, None, 6)]
    versions = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long").repartition(3)
    got = changes.dump_view(versions, "k", "ts", history=True, tie="id", slice_bytes=slice_bytes).collect()
    assert {r["id"]: r["valid_to"] for r in got} == {1: None, 2: day, 3: None, 6: day, 4: day, 5: None}


def test_a_hot_key_with_equal_times_is_cut(spark):
    rows = [("hot", datetime(2024, 1, 1), i) for i in range(2000)]
    versions = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long").repartition(4)
    sizes = [r["count"] for r in slice_rows(versions, ["k", "ts", "id"], slice_bytes=5_000).groupBy("_slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 400


def test_ties_repeats_and_changes_without_operation(spark):
    base = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "k long, value double")
    log = [(1, 5, "U", 1.0), (1, 5, "U", 2.0), (2, 7, "U", 9.0), (2, 7, "D", None), (3, 1, "U", None), (3, 1, "U", None)]
    for rows in (log, log[::-1]):
        frame = spark.createDataFrame(rows, "k long, seq long, op string, value double").coalesce(1)
        for incremental in (False, True):
            got = changes.apply_changes(base, frame, "k", "seq", incremental=incremental).collect()
            assert {r["k"]: r["value"] for r in got} == {1: 2.0, 3: None}
    broken = spark.createDataFrame([(1, 5, None, 1.0)], "k long, seq long, op string, value double")
    with pytest.raises(PySparkException, match="no operation"):
        changes.apply_changes(base, broken, "k", "seq").collect()


def broken(spark, views, deps, objects):
    found = changes.broken_views(
        spark.createDataFrame([(v,) for v in views], "view string"), spark.createDataFrame(deps, "view string, object string"), spark.createDataFrame([(o,) for o in objects], "object string")
    )
    return {r["view"]: (r["depth"], r["missing"]) for r in found.collect()}


def test_views_over_broken_views(spark):
    deps = [("v1", "gone"), ("v1", "t"), ("v2", "v1"), ("v3", "v2"), ("v3", "lost"), ("v4", "t"), ("v5", "v4"), ("c1", "c2"), ("c2", "c1"), ("c2", "t"), ("d1", "d2"), ("d2", "d1"), ("d2", "v3"), ("d1", "v2")]
    views = ["v1", "v2", "v3", "v4", "v5", "c1", "c2", "d1", "d2", "none"]
    assert broken(spark, views, deps, ["t"]) == {"v1": (1, "gone"), "v2": (2, "gone"), "v3": (1, "lost"), "d2": (2, "lost"), "d1": (3, "gone")}
    assert broken(spark, [], [], []) == {}


def test_many_views_over_one_broken_one(spark):
    views = ["bad", *[f"v{i}" for i in range(10_000)]]
    found = broken(spark, views, [("bad", "gone"), *[(v, "bad") for v in views[1:]], ("w", "bad")], [])
    assert len(found) == 10_001 and set(found.values()) == {(1, "gone"), (2, "gone")}


def test_invalid_views_are_set_aside_for_what_they_read(spark):
    views = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "view string")
    deps = spark.createDataFrame([("v1", "gone"), ("v2", "v1"), ("v3", "t")], "view string, object string")
    valid, aside = changes.invalid_views(views, deps, spark.createDataFrame([("t",)], "object string"))
    assert {r[0] for r in valid.collect()} == {"v3"} and {r[0] for r in aside.collect()} == {"v1", "v2"}


def test_names_of_views_are_looked_up_once_and_dropped_when_found(spark, monkeypatch):
    seen, settled = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def noted(df, label, settle=changes.settle):
        settled.append((label, result := settle(df, label)))
        return result

    monkeypatch.setattr(changes, "settle", noted)
    views = [f"v{i:02d}" for i in range(40)]
    deps = [(v, "t") for v in views] + [(v, "t") for v in views] + [(b, a) for a, b in zip(views, views[1:])]
    deps += [("v00", "gone"), ("v00", "c1"), ("c1", "c2"), ("c2", "c1"), ("c2", None), (None, "gone"), ("w", "gone")]
    schema = "view string, object string"
    names = spark.createDataFrame(deps, schema).repartition(2).mapInArrow(counted, schema)
    known = spark.createDataFrame([(v,) for v in [*views, "c1", "c2", "c1", None]], "view string")
    found = changes.broken_views(known, names, spark.createDataFrame([("t",), ("t",), (None,)], "object string"))
    assert sorted(map(tuple, found.collect())) == [(v, i + 1, "gone") for i, v in enumerate(views)]
    assert seen.value == len(deps)
    left = [df.count() for label, df in settled if label == "views-of-views"]
    assert len(left) > 3 and left == sorted(left, reverse=True) and left[-1] <= 6
