import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablekeep.operators import packing
from tablekeep.operators.retention import retention_plan
from tablekeep.sources import files, runs, stores

TREE = {
    "x": b"abc", ".x": b"hidden", "_y": b"also", "e": b"", ".e": b"", "d/a b+%41.log": b"1", "d/.git/deep/_z": b"22",
    "_tmp/1/2/3": bytes(range(256)) * 50, "é/ü": b"333", "p=1/f": b"4444",
}


def put(root, tree=TREE):
    for name, data in tree.items():
        path = Path(root, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def test_every_byte_of_a_tree_counts(spark, folder):
    put(folder)
    os.symlink(folder, f"{folder}/d/circle")
    os.symlink(f"{folder}/gone", f"{folder}/broken")
    os.symlink(f"{folder}/x", f"{folder}/link")
    os.makedirs(f"{folder}/no/files")
    inventory = files.file_inventory(spark, folder, hidden=True)
    assert files.tree_size(inventory).first()[0] == sum(map(len, TREE.values())) + 3
    listed = {r["member"]: r["length"] for r in stores.list_files(spark, folder).collect()}
    assert listed == {name: len(data) for name, data in TREE.items()} | {"link": 3}
    seen = {r["path"].removeprefix(f"file:{folder}/") for r in files.file_inventory(spark, folder).collect()}
    assert seen == {"x", "e", "d/a b+%41.log", "é/ü", "p=1/f", "link"}
    levels = stores.listing(spark, folder, levels=2).groupBy("level").count().collect()
    assert sorted(r["level"] for r in levels) == [1, 2]
    assert stores.listing(spark, f"{folder}/no/files").count() == 0
    assert [(r["path"], r["length"]) for r in files.file_inventory(spark, f"{folder}/x").collect()] == [(f"file:{folder}/x", 3)]
    with pytest.raises(Exception, match="FileNotFound"):
        files.file_inventory(spark, f"{folder}/absent")


def test_contents_are_read_whole_or_in_parts(spark, folder):
    put(folder)
    listed = stores.list_files(spark, folder)
    whole = {r["member"]: bytes(r["content"]) for r in stores.read_contents(listed).collect()}
    assert whole == TREE
    parts = stores.read_contents(listed.select("path", "member", "length"), 1000).collect()
    for name, data in TREE.items():
        mine = sorted((r["part"], bytes(r["content"])) for r in parts if r["member"] == name)
        assert b"".join(content for _, content in mine) == data
        assert len(mine) == {r["parts"] for r in parts if r["member"] == name}.pop() == max(1, -(-len(data) // 1000))
    assert len({r["entry"] for r in parts}) == len(TREE)
    with pytest.raises(ValueError, match="at least one byte"):
        stores.read_contents(listed, 0)


def test_a_file_that_changed_since_it_was_listed_is_named(spark, folder):
    put(folder)
    contents = stores.read_contents(stores.list_files(spark, folder))
    Path(folder, "x").write_bytes(b"longer than before")
    with pytest.raises(Exception, match="/x had 3 bytes when it was listed and has 18 now"):
        contents.collect()


def test_files_are_packed_and_unpacked_with_hidden_and_empty_ones(spark, folder):
    put(f"{folder}/in")
    inventory = packing.read_files(spark, f"{folder}/in", part_bytes=1000)
    notes = spark.createDataFrame([("all", "note", "é")], "archive string, member string, text string")
    packing.pack_indexed(inventory, F.lit("all"), f"{folder}/pack", extra=notes, shard_bytes=4000)
    assert packing.unpack(packing.pack_parts(spark, f"{folder}/pack", ["*"]), f"{folder}/out") == len(TREE) + 12 + 1
    found = {str(p.relative_to(f"{folder}/out")): p.read_bytes() for p in Path(folder, "out").rglob("*") if p.is_file()}
    assert found == TREE | {"note": "é".encode()}
    assert sorted(os.listdir(folder)) == ["in", "out", "pack"]
    packing.pack(packing.read_files(spark, f"{folder}/in"), F.lit("all"), f"{folder}/plain")
    assert {r["member"]: r["length"] for r in packing.pack_list(spark, f"{folder}/plain").collect()} == {k: len(v) for k, v in TREE.items()}


def test_files_are_written_below_their_folder_only(spark, folder):
    def members(*rows):
        return spark.createDataFrame(rows, "member string, content binary")

    for name in ("../x", "/x", "a//b", "a/./b", "", None, "a/.."):
        with pytest.raises(ValueError, match="no name of a file"):
            stores.write_files(members((name, bytearray(b"1"))), f"{folder}/out")
    with pytest.raises(ValueError, match="name of 2 members"):
        stores.write_files(members(("a", bytearray(b"1")), ("a", bytearray(b"2"))), f"{folder}/out")
    assert not os.path.exists(f"{folder}/out")
    assert stores.write_files(members(), f"{folder}/none") == 0
    assert stores.write_files(members(("a", bytearray(b"1")), ("b", None)), f"{folder}/out") == 2
    assert stores.write_files(members(("a", bytearray(b"22"))), f"{folder}/out") == 1
    assert {p.name: p.read_bytes() for p in Path(folder, "out").iterdir()} == {"a": b"22", "b": b""}
    parts = spark.createDataFrame([("a", 0, bytearray(b"1")), ("a", 2, bytearray(b"3"))], "member string, part int, content binary")
    with pytest.raises(Exception, match="'a' has no part 1"):
        stores.write_files(parts, f"{folder}/parts")


def test_purged_runs_are_deleted_by_tasks_in_either_layout(spark, folder):
    rows = [("a+b c", f"202401{day:02d}_000000", "sql") for day in range(1, 21)]
    runs.write_run_records(spark.createDataFrame(rows, "backupset string, name string, plugin string"), f"{folder}/many")
    scanned = runs.scan_runs(spark, f"{folder}/many", file_name="part-*")
    plan = retention_plan(scanned, 3, order=["name"])
    assert runs.delete_runs(spark, f"{folder}/many", plan) == 17
    assert sorted(r["name"] for r in runs.scan_runs(spark, f"{folder}/many", file_name="part-*").collect()) == [r[1] for r in rows[-3:]]
    assert len(os.listdir(f"{folder}/many/backupset=a+b c")) == 3
    gone = spark.createDataFrame([("a+b c", "20240101_000000", "purge"), ("z", "20240101_000000", "purge")], "backupset string, name string, action string")
    assert runs.delete_runs(spark, f"{folder}/many", gone) == 0
    with pytest.raises(ValueError, match="no name of a run|not the name of a run"):
        runs.delete_runs(spark, f"{folder}/many", spark.createDataFrame([(None, "20240101_000000", "purge")], "backupset string, name string, action string"))


def test_members_are_read_once_for_their_names_and_once_for_their_contents(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "member string, content binary"
    members = spark.createDataFrame([(f"a/{i}", bytearray(b"x")) for i in range(30)], schema).mapInArrow(counted, schema)
    assert stores.write_files(members, f"{folder}/out") == 30
    assert seen.value == 60
    twice = spark.createDataFrame([("b", b"1"), ("b", b"2"), ("../c", b"3")], schema)
    with pytest.raises(ValueError, match="no name of a file"):
        stores.write_files(twice, f"{folder}/bad")
    with pytest.raises(ValueError, match="'b' is the name of 2"):
        stores.write_files(twice.where("member = 'b'"), f"{folder}/bad")
    assert not os.path.exists(f"{folder}/bad")
