import os
from datetime import datetime
from pathlib import Path

import pytest

from tablekeep.operators.retention import retention_plan
from tablekeep.sources import documents, files, jdbc, runs

RECORD = """# written by a run
[other]
plugin = wrong
failed = yes

[run]
plugin = "sql"
start_time = 1704067207.25
stop-time = 1704067300
failed = no
estimated-size = 2048.0
on-disk-size = 1000
purge-policy = before-backup
backups_to_keep = 3

[sql]
plugin = nested
"""


def put(root, name, text):
    path = Path(root, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_run_records(spark, folder):
    put(folder, "a/20240101_000007/backup.conf", RECORD)
    put(folder, "a/20240102_000000/backup.conf", "[run]\nfailed = yes\n")
    put(folder, "a/20240103_000000/backup.conf", "")
    put(folder, "a/newest/backup.conf", RECORD)
    put(folder, "b c/20231231_235959/backup.conf", RECORD.replace("\n", "\r\n"))
    got = {(r["backupset"], r["name"]): r for r in runs.scan_runs(spark, folder).collect()}
    assert set(got) == {("a", "20240101_000007"), ("a", "20240102_000000"), ("a", "20240103_000000"), ("b c", "20231231_235959")}
    full = got["a", "20240101_000007"]
    assert full["plugin"] == "sql" and full["failed"] is False
    assert full["start_time"] == datetime(2024, 1, 1, 0, 0, 7, 250000)
    assert (full["estimated_size"], full["on_disk_size"], full["backups_to_keep"]) == (2048, 1000, 3)
    assert (full["purge_policy"], full["historic_size_factor"], full["historic_size"]) == ("before-backup", 1.5, True)
    assert got["a", "20240102_000000"]["failed"] is True
    empty = got["a", "20240103_000000"]
    assert (empty["plugin"], empty["failed"], empty["backups_to_keep"], empty["auto_purge_failures"]) == ("", False, 1, True)
    assert got["b c", "20231231_235959"]["plugin"] == "sql"


def test_a_key_written_twice_is_no_trouble(spark, folder):
    put(folder, "a/20240101_000007/backup.conf", RECORD.replace("[run]", "[run]\nbackups-to-keep = 9\nbackups_to_keep = 8"))
    assert [r["backups_to_keep"] for r in runs.scan_runs(spark, folder).collect()] == [3]


def test_many_records_are_written_by_tasks(spark, folder):
    rows = [("a=b c", "20240101_000000", "sql", 7, True), ("z", "20240102_000000", None, None, False)]
    runs.write_run_records(spark.createDataFrame(rows, "backupset string, name string, plugin string, on_disk_size long, failed boolean"), f"{folder}/many")
    got = runs.scan_runs(spark, f"{folder}/many", file_name="part-*").collect()
    assert {(r["backupset"], r["name"], r["plugin"], r["on_disk_size"], r["failed"]) for r in got} == {
        ("a=b c", "20240101_000000", "sql", 7, True), ("z", "20240102_000000", "", 0, False)}
    with pytest.raises(ValueError, match="unknown"):
        runs.write_run_records(spark.createDataFrame([("a", "n", 1)], "backupset string, name string, colour long"), f"{folder}/x")


def test_runs_are_recorded_planned_and_deleted(spark, folder):
    for day in (1, 2, 3):
        values = {"plugin": "sql", "on-disk-size": 100.0 * day, "failed": "no"}
        runs.write_run_record(spark, folder, "a", f"2024010{day}_000000", values)
    runs.write_run_record(spark, folder, "a", "20240103_000000", {"plugin": "sql", "on-disk-size": 7})
    plan = retention_plan(runs.scan_runs(spark, folder), 1, order=["name"])
    assert {r["name"]: (r["on_disk_size"], r["action"]) for r in plan.collect()} == {
        "20240101_000000": (100, "purge"), "20240102_000000": (200, "purge"), "20240103_000000": (7, "keep")}
    assert len(os.listdir(f"{folder}/a")) == 3
    assert runs.delete_runs(spark, folder, plan) == 2
    assert os.listdir(f"{folder}/a") == ["20240103_000000"]


def test_only_runs_are_written_and_deleted(spark, folder):
    for backupset, name in (("..", "20240101_000000"), ("a/b", "20240101_000000"), ("a", ".."), ("a", "newest")):
        with pytest.raises(ValueError):
            runs.write_run_record(spark, folder, backupset, name, {})
        plan = spark.createDataFrame([(backupset, name, "purge")], "backupset string, name string, action string")
        with pytest.raises(ValueError):
            runs.delete_runs(spark, folder, plan)
    with pytest.raises(ValueError):
        runs.write_run_record(spark, folder, "a", "20240101_000000", {"colour": "red"})


def test_inventory(spark, folder):
    for name, size in (("x", 3), ("d/y.log", 5), ("d/e/z.conf", 7), (".hidden", 11), ("d/em pty+%41", 0)):
        put(folder, name, "q" * size)
    inventory = files.file_inventory(spark, folder)
    assert files.tree_size(inventory).first()[0] == 15
    assert files.tree_size(files.exclude_files(inventory, "*.LOG")).first()[0] == 10
    listed = {r["path"].split("/")[-1]: r["length"] for r in files.file_inventory(spark, folder).collect()}
    assert listed == {"x": 3, "y.log": 5, "z.conf": 7, "em pty+%41": 0}
    assert "content" not in inventory._jdf.queryExecution().executedPlan().toString()


def test_documents(spark, folder):
    os.makedirs(f"{folder}/c")
    put(folder, "c/a.json", '{"a": 1}\n{"a": 2, "b": {"c": "x"}}\n')
    assert documents.scan_documents(spark, f"{folder}/c").schema.simpleString() == "struct<a:bigint,b:struct<c:string>>"
    assert documents.scan_documents(spark, f"{folder}/c", "a int").collect() == [(1,), (2,)]


def test_database_ranges():
    """The reader gets the ranges; no database is started for tests."""

    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def options(self, **options):
            self.seen.update(options)
            return self

        def load(self):
            return self.seen

    class Session:
        read = Reader()

    seen = jdbc.scan_jdbc(Session, "jdbc:x", "t", "id", 0, 100, 8, {"fetchsize": "1000", "url": "ignored"})
    assert seen == {
        "format": "jdbc", "fetchsize": "1000", "url": "jdbc:x", "dbtable": "t", "partitionColumn": "id",
        "lowerBound": "0", "upperBound": "100", "numPartitions": "8",
    }
