from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablekeep.operators import packing


def test_files_are_packed_and_extracted(spark, folder):
    contents = {f"member{i}.txt": b"x" * i for i in range(15)} | {"deep/er/a b.bin": bytes(range(256))}
    for name, data in contents.items():
        path = Path(folder, "in", name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    extra = spark.createDataFrame([("one", "note.txt", "é")], "archive string, member string, text string")
    inventory = packing.read_files(spark, f"{folder}/in")
    packing.pack(inventory, F.lit("one"), f"{folder}/out", extra=extra)
    listed = {r["member"]: (r["archive"], r["length"]) for r in packing.pack_list(spark, f"{folder}/out").collect()}
    expected = {name: ("one", len(data)) for name, data in contents.items()} | {"note.txt": ("one", 2)}
    assert listed == expected
    got = {r["member"]: bytes(r["content"]) for r in packing.pack_extract(spark, f"{folder}/out", ["*"]).collect()}
    assert got == contents | {"note.txt": "é".encode()}
    assert packing.pack_extract(spark, f"{folder}/out", []).count() == 0
    assert {r["member"] for r in packing.pack_extract(spark, f"{folder}/out", ["MEMBER1?.txt"], ["o*"]).collect()} == {
        f"member{i}.txt" for i in range(10, 15)
    }


def test_scans_are_pruned(spark, folder):
    members = spark.createDataFrame([("a", "m", 1, bytearray(b"x")), ("1", "n", 1, bytearray(b"y"))], "archive string, member string, length long, content binary")
    packing.pack(members, "archive", f"{folder}/out")
    plan = packing.pack_list(spark, f"{folder}/out")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    plan = packing.pack_extract(spark, f"{folder}/out", ["*"], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(archive" in plan or "RLIKE(archive" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert {r["archive"] for r in packing.pack_list(spark, f"{folder}/out").collect()} == {"a", "1"}


def test_indexed_packs_open_only_the_shards_of_their_members(spark, folder):
    contents = [("a", f"m{i:03d}", bytes([i % 256]) * 100) for i in range(300)]
    contents += [("b", "long", bytes(range(256)) * 40), ("b", "empty", b""), ("b", "gone", None), ("b", "twice", b"1"), ("b", "twice", b"2")]
    rows = [(archive, member, len(data or b""), data and bytearray(data)) for archive, member, data in contents]
    files = spark.createDataFrame(rows, "archive string, member string, length long, content binary")
    notes = spark.createDataFrame([("b", "note", "é")], "archive string, member string, text string")
    root = f"{folder}/pack"
    packing.pack_indexed(files, "archive", root, extra=notes, shard_bytes=2000, part_bytes=1000)

    sizes = packing.pack_index(spark, root).groupBy("shard").agg(F.count("*").alias("n")).collect()
    assert len(sizes) >= 40000 // 3000
    for path in Path(root, "shards").glob("*.parquet"):
        assert spark.read.parquet(str(path)).agg(F.sum(F.octet_length("content"))).first()[0] < 3000
    one = packing.pack_parts(spark, root, names=["m123"])
    assert len(one.inputFiles()) == 1
    assert [(r["member"], bytes(r["content"])) for r in one.collect()] == [("m123", bytes([123]) * 100)]
    long = packing.pack_parts(spark, root, ["LONG"], ["b*"])
    assert 1 < len(long.inputFiles()) < len(sizes)
    assert sorted((r["part"], r["parts"]) for r in long.collect()) == [(k, 11) for k in range(11)]
    assert packing.pack_parts(spark, root, ["nothing*"]).count() == packing.pack_parts(spark, root).count() == 0
    assert packing.pack_parts(spark, root, ["m00?"], names=["note"]).count() == 11

    whole = packing.whole_members(packing.pack_parts(spark, root, ["*"])).collect()
    expected = [(a, m, data or b"") for a, m, data in contents] + [("b", "note", "é".encode())]
    assert sorted((r["archive"], r["member"], bytes(r["content"])) for r in whole) == sorted(expected)


def test_indexed_packs_without_rows_or_index(spark, folder):
    empty = spark.createDataFrame([], "archive string, member string, length long, content binary")
    packing.pack_indexed(empty, "archive", f"{folder}/none")
    assert packing.pack_index(spark, f"{folder}/none").count() == packing.pack_parts(spark, f"{folder}/none", ["*"]).count() == 0
    with pytest.raises(FileNotFoundError, match="no finished pack"):
        packing.pack_index(spark, f"{folder}/absent")
    with pytest.raises(ValueError, match="at least one byte"):
        packing.pack_indexed(empty, "archive", f"{folder}/bad", part_bytes=0)


def test_indexed_packs_write_many_shards_in_a_task_and_read_the_inventory_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "archive string, member string, length long, content binary"
    rows = [(None if i % 50 == 0 else f"a{i % 3}", f"m{i:03d}", 100, bytearray([i % 256]) * 100) for i in range(400)]
    files = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    root = f"{folder}/pack"
    packing.pack_indexed(files, "archive", root, shard_bytes=1000, part_bytes=500)
    assert seen.value == 400

    shards = sorted(Path(root, "shards").rglob("part-*.parquet"))
    assert len(shards) == 40
    assert len({path.parent for path in shards}) <= 7 and len({path.name for path in shards}) <= 7
    found = []
    for path in shards:
        held = [(r["archive"] or "", r["member"], r["part"]) for r in spark.read.parquet(str(path)).collect()]
        assert len(held) == 10 and held == sorted(held)
        found.append(held)
    ordered = sorted(found)
    assert all(a[-1] < b[0] for a, b in zip(ordered, ordered[1:])) and sum(map(len, ordered)) == 400

    every = packing.pack_parts(spark, root, ["*"])
    assert every.columns == ["archive", "member", "entry", "part", "parts", "length", "content"]
    assert sorted((r["archive"] or "", r["member"], bytes(r["content"])) for r in every.collect()) == sorted(
        (archive or "", member, bytes(content)) for archive, member, _, content in rows
    )
    some = packing.pack_parts(spark, root, ["m00?"])
    assert some.columns == every.columns and some.count() == 10 and len(some.inputFiles()) < 20
