import glob
import os

import pytest

from tablekeep.sources import snapshots


def pinned(spark, folder):
    spark.range(10).repartition(3).write.parquet(f"{folder}/t")
    spark.range(5).write.parquet(f"{folder}/other")
    snapshots.pin(spark, {"t": f"{folder}/t", "other": f"{folder}/other"}, f"{folder}/pins")


def test_files_added_later_do_not_belong(spark, folder):
    pinned(spark, folder)
    spark.range(100).write.mode("append").parquet(f"{folder}/t")
    assert snapshots.read_pinned(spark, f"{folder}/pins", "t", "id long").count() == 10
    assert snapshots.changed_files(spark, f"{folder}/pins").isEmpty()


def test_changed_and_lost_files_are_named(spark, folder):
    pinned(spark, folder)
    first, second, *_ = sorted(glob.glob(f"{folder}/t/part-*"))
    os.utime(first, (1, 1))
    with pytest.raises(ValueError, match=os.path.basename(first)):
        snapshots.read_pinned(spark, f"{folder}/pins", "t", "id long")
    os.rename(second, f"{folder}/elsewhere")
    reasons = {os.path.basename(r["path"]): r["reason"] for r in snapshots.changed_files(spark, f"{folder}/pins").collect()}
    assert reasons == {os.path.basename(first): "changed", os.path.basename(second): "gone"}
    assert snapshots.read_pinned(spark, f"{folder}/pins", "other", "id long").count() == 5


def test_unknown_tables_and_unfinished_snapshots(spark, folder):
    pinned(spark, folder)
    with pytest.raises(ValueError, match="no table"):
        snapshots.read_pinned(spark, f"{folder}/pins", "nothing", "id long")
    with pytest.raises(ValueError, match="no finished snapshot"):
        snapshots.read_pinned(spark, f"{folder}/nowhere", "t", "id long")
