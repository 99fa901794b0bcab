import random

import pytest
from pyspark.sql import functions as F

from tablekeep.operators import changes, kept

LOG = "seq long, k long, op string, a string, b double"
BASE = "k long, a string, b double"


def files(spark, root):
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/data").select("path", "modificationTime")
    return {r["path"]: r["modificationTime"] for r in paths.collect() if r["path"].endswith(".parquet")}


def test_a_log_in_three_parts_equals_one_go(spark, folder, as_rows):
    draw = random.Random(4)
    base = spark.createDataFrame([(k, "old", float(k)) for k in range(40, 200)], BASE)
    rows = [(i, 7 if draw.random() < 0.3 else draw.randrange(120), draw.choice("IUUD"), draw.choice(["x", None]), float(i)) for i in range(600)]
    log = spark.createDataFrame(rows, LOG)
    root = f"{folder}/kept"
    kept.keep(base, root, "k", buckets=8)
    for part in ("seq < 100", "seq >= 100 AND seq < 450", "seq >= 450"):
        kept.apply_log(spark, root, log.where(part), "seq", ("a", "b"))
    assert as_rows(kept.kept(spark, root)) == as_rows(changes.apply_changes(base, log, "k", "seq", ("a", "b")))


def test_untouched_buckets_keep_their_files(spark, folder):
    root = f"{folder}/kept"
    kept.keep(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("a"), F.lit(1.0).alias("b")), root, "k", buckets=16)
    before = files(spark, root)
    kept.apply_log(spark, root, spark.createDataFrame([(1, 5, "U", "z", 2.0)], LOG), "seq", ("a", "b"))
    after = files(spark, root)
    assert before.items() <= after.items() and len(after) == len(before) + 1
    read = set(kept.kept(spark, root).select(F.input_file_name().alias("f")).distinct().toPandas()["f"])
    assert len(read) == 16 and sum("/data/1/" in f for f in read) == 1
    plan = kept._Kept(spark, root).table([3])
    assert len(plan.inputFiles()) == 1


def test_a_call_that_fails_changes_nothing(spark, folder, monkeypatch, as_rows):
    root = f"{folder}/kept"
    kept.keep(spark.createDataFrame([(1, "a", 1.0)], BASE), root, "k", buckets=4)
    log = spark.createDataFrame([(1, 1, "U", "z", 2.0), (2, 9, "I", "n", 3.0)], LOG)
    with monkeypatch.context() as patched:
        patched.setattr(kept, "_list", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            kept.apply_log(spark, root, log, "seq", ("a", "b"))
    assert as_rows(kept.kept(spark, root)) == [(1, "a", 1.0)]
    kept.apply_log(spark, root, log, "seq", ("a", "b"))
    assert as_rows(kept.kept(spark, root)) == [(1, "z", 2.0), (9, "n", 3.0)]


def test_buckets_that_come_out_empty_and_wrong_tables(spark, folder):
    root = f"{folder}/kept"
    kept.keep(spark.createDataFrame([(1, "a", 1.0)], BASE), root, "k", buckets=2)
    kept.apply_log(spark, root, spark.createDataFrame([(1, 1, "D", "z", 2.0)], LOG), "seq", ("a", "b"))
    assert kept.kept(spark, root).collect() == []
    kept.apply_log(spark, root, spark.createDataFrame([], LOG), "seq", ("a", "b"))
    with pytest.raises(ValueError, match="columns"):
        kept.apply_log(spark, root, spark.createDataFrame([], LOG), "seq", ("a",))
    with pytest.raises(ValueError, match="not empty"):
        kept.keep(spark.createDataFrame([(1, "a", 1.0)], BASE), root, "k")
    with pytest.raises(ValueError, match="no kept table"):
        kept.kept(spark, f"{folder}/nothing")


def test_history_in_any_order_of_arrival(spark, folder, as_rows):
    draw = random.Random(9)
    rows = [(3 if draw.random() < 0.4 else draw.randrange(30), draw.choice([None, *range(50)]), i, f"v{i}", 1) for i in range(400)]
    schema = "k long, at long, n long, v string, _slice long"
    whole = spark.createDataFrame(rows, schema)
    draw.shuffle(rows)
    root = f"{folder}/history"
    kept.keep_history(spark.createDataFrame(rows[:50], schema), root, "k", "at", "n", buckets=4)
    for begin, end in ((50, 60), (55, 300), (300, 400), (0, 10)):
        kept.add_versions(spark, root, spark.createDataFrame(rows[begin:end], schema), "at", "n")
    expected = kept._with_ends(whole, ["k"], "at", "n")
    assert as_rows(kept.kept(spark, root)) == as_rows(expected)
    assert kept.kept(spark, root).columns == ["k", "at", "n", "v", "_slice", "valid_to"]
