import os
import random

import pytest

from tablekeep.operators.changes import apply_changes
from tablekeep.sources.dumps import restore, restore_tables
from tablekeep.streaming.changes import compact, stream_apply, streamed_state
from tablekeep.streaming.dump import Position, fold_dump, stream_dump, stream_dump_table

SCHEMA = "seq long, k long, op string, value double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, 3 if rng.random() < 0.4 else rng.randrange(20), rng.choice("IUD"), float(i)) for i in range(400)]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def follow(spark, folder):
    stream_apply(stream(spark, folder), "k", "seq", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()


def test_late_and_repeated_changes(spark, folder, rows):
    base = spark.createDataFrame([(k, -1.0) for k in range(10, 40)], "k long, value double")
    expected = apply_changes(base, spark.createDataFrame(rows, SCHEMA), "k", "seq")
    feed(spark, folder, rows[200:])
    follow(spark, folder)
    feed(spark, folder, rows[:250])  # older changes come last, and some a second time
    follow(spark, folder)
    assert same(streamed_state(spark, f"{folder}/out", base, "k", "seq"), expected)
    compact(spark, f"{folder}/out", "k", "seq")
    compact(spark, f"{folder}/out", "k", "seq")
    (folded,) = [name for name in os.listdir(f"{folder}/out") if "=" in name]
    assert folded.startswith("upto=")
    assert same(streamed_state(spark, f"{folder}/out", base, "k", "seq"), expected)
    late = [(1000, 3, "U", 5.0), (1001, 77, "I", 6.0)]
    feed(spark, folder, late)
    follow(spark, folder)
    after = apply_changes(base, spark.createDataFrame([*rows, *late], SCHEMA), "k", "seq")
    assert same(streamed_state(spark, f"{folder}/out", base, "k", "seq"), after)


def test_a_fresh_checkpoint_on_old_batches_is_refused(spark, folder, rows):
    feed(spark, folder, rows)
    follow(spark, folder)
    before = spark.read.parquet(f"{folder}/out").count()
    with pytest.raises(ValueError, match="checkpoint"):
        stream_apply(stream(spark, folder), "k", "seq", f"{folder}/out", f"{folder}/other")
    assert spark.read.parquet(f"{folder}/out").count() == before


@pytest.mark.parametrize(("fmt", "codec"), [("parquet", "zstd"), ("json", "gzip")])
def test_resumed_dump_has_every_row_once(spark, folder, rows, fmt, codec):
    for part in (rows[:100], rows[100:]):
        feed(spark, folder, part)
        stream_dump(stream(spark, folder), f"{folder}/out", f"{folder}/checkpoint", fmt, codec).awaitTermination()
    assert same(spark.read.format(fmt).schema(SCHEMA).load(f"{folder}/out"), spark.createDataFrame(rows, SCHEMA))


def test_a_fresh_checkpoint_after_folding_is_refused(spark, folder, rows):
    feed(spark, folder, rows[:200])
    follow(spark, folder)
    compact(spark, f"{folder}/out", "k", "seq")
    feed(spark, folder, rows[200:])
    with pytest.raises(ValueError, match="checkpoint"):
        stream_apply(stream(spark, folder), "k", "seq", f"{folder}/out", f"{folder}/other")
    follow(spark, folder)
    base = spark.createDataFrame([(1, -1.0)], "k long, value double")
    assert same(streamed_state(spark, f"{folder}/out", base, "k", "seq"), apply_changes(base, spark.createDataFrame(rows, SCHEMA), "k", "seq"))


def dump_stream(spark, folder, checkpoint, position=None, fmt="parquet"):
    stream_dump_table(stream(spark, folder), f"{folder}/out", "shop.log", f"{folder}/{checkpoint}", fmt, position=position).awaitTermination()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_streamed_dump_is_restored_at_any_time(spark, folder, rows, fmt):
    for upto in (100, 250, 400):
        feed(spark, folder, rows[upto - 100 if upto == 100 else 100 if upto == 250 else 250 : upto])
        dump_stream(spark, folder, "checkpoint", fmt=fmt)
        for _ in range(2):
            assert same(restore(spark, f"{folder}/out", "log", "shop"), spark.createDataFrame(rows[:upto], SCHEMA))
            fold_dump(spark, f"{folder}/out", "shop.log")
    assert [name for name in os.listdir(f"{folder}/out/backup_data/shop/log") if "=" in name and not name.startswith("upto")] == []
    assert restore_tables(spark, f"{folder}/out", ["shop.*"])["shop.log"].count() == 400


def test_a_lost_checkpoint_goes_on_from_its_position(spark, folder, rows):
    feed(spark, folder, rows[:150])
    dump_stream(spark, folder, "one")
    feed(spark, folder, rows[150:])
    with pytest.raises(ValueError, match="checkpoint"):
        dump_stream(spark, folder, "two")
    source = spark.read.schema(SCHEMA).parquet(f"{folder}/in")
    position = Position(source, "seq", "value")
    dump_stream(spark, folder, "two", position)
    feed(spark, folder, [(1000, 1, "U", 2.0)])
    dump_stream(spark, folder, "two", position)
    assert same(restore(spark, f"{folder}/out", "log", "shop"), spark.createDataFrame([*rows, (1000, 1, "U", 2.0)], SCHEMA))
    moved = Position(source.where("seq <> 7"), "seq", "value")
    with pytest.raises(ValueError, match="moved"):
        dump_stream(spark, folder, "three", moved)
