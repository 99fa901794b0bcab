import glob
import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablekeep.operators import dump
from tablekeep.plans.formats import ORC_CODECS, PARQUET_CODECS, TEXT_CODECS, codec_for
from tablekeep.sources import dumps, files

SCHEMA = "id long, s string, d double, dec decimal(12,3), b boolean, day date, at timestamp_ntz, z timestamp"


@pytest.fixture(scope="module")
def frame(spark):
    at = datetime(2024, 2, 29, 23, 59, 58, 123456)
    rows = [
        (1, "plain", 1.5, Decimal("10.125"), True, date(2024, 1, 1), at, at),
        (2, 'q"uote,\ncomma\\', -0.1, None, False, None, None, None),
        (3, "", 1e300, Decimal("-1.000"), None, date(1969, 12, 31), datetime(1969, 1, 1), at),
        (4, None, None, Decimal("0.001"), True, date(9999, 1, 1), at, at),
        (6, " lead and trail ", -0.0, None, None, None, None, None),
        (7, "cr\rcrlf\r\n\ttab", float("nan"), None, None, None, None, None),
        (8, "null", 0.0, None, None, None, None, None),
        (5, "é😀 'x'", float("inf"), None, None, None, at, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(left, right):
    return left.schema.simpleString() == right.schema.simpleString() and left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


CASES = (
    [(f, c) for f in ("csv", "json") for c in TEXT_CODECS]
    + [("parquet", c) for c in PARQUET_CODECS]
    + [("orc", c) for c in ORC_CODECS]
)


@pytest.mark.parametrize(("fmt", "codec"), CASES)
def test_round_trip(spark, frame, folder, fmt, codec):
    dump.dump({"db.t": frame}, f"{folder}/d", fmt=fmt, codec=codec)
    assert same(dumps.restore(spark, f"{folder}/d", "t"), frame)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_round_trip_of_one_dataset(spark, frame, folder, fmt):
    other = spark.createDataFrame([(1, [1, 2], {"k": "v"}, (1, "n"), bytearray(b"\0\xff"))], "id int, a array<int>, m map<string,string>, st struct<x:int,y:string>, bin binary")
    tables = {("a", "t"): frame, ("a/b", "_odd name"): other}
    dump.dump(tables, f"{folder}/d", per_database=False, fmt=fmt, codec="gzip")
    assert same(dumps.restore(spark, f"{folder}/d", "t"), frame)
    assert [r.asDict(True) for r in dumps.restore(spark, f"{folder}/d", "_odd name", database="a/b").collect()] == [r.asDict(True) for r in other.collect()]


def test_odd_table_names(spark, folder):
    df = spark.range(3)
    names = [("a.b", "_x"), ("a", "b.c"), ("a", "*"), ("", "solo"), ("é", "x y"), ("A", "?")]
    dump.dump({n: df for n in names}, f"{folder}/d")
    for database, table in names:
        assert dumps.restore(spark, f"{folder}/d", table, database=database).count() == 3
    assert set(dumps.restore_tables(spark, f"{folder}/d", ["a.b*"])) == {"a.b._x", "a.b.c"}


def test_a_dump_without_manifest_failed(spark, folder):
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(PySparkException):
        dump.dump({"db.good": spark.range(3), "db.bad": broken}, f"{folder}/d")
    with pytest.raises(ValueError, match="no manifest"):
        dumps.restore(spark, f"{folder}/d", "good")


def test_dry_run_writes_nothing(spark, frame, folder):
    plan = dump.dump({"db.t": frame}, f"{folder}/d", dry_run=True)
    assert [(r["database"], r["name"], r["path"]) for r in plan.collect()] == [("db", "t", "backup_data/db/t")]
    assert not os.path.exists(f"{folder}/d")


def test_schema_only_and_data_only(spark, frame, folder):
    dump.dump({"db.t": frame}, f"{folder}/ddl", what="ddl")
    assert not os.path.exists(f"{folder}/ddl/backup_data")
    dump.dump({"db.t": frame}, f"{folder}/data", what="data", fmt="json")
    assert same(dumps.restore(spark, f"{folder}/data", "t", schema=frame.schema), frame)
    with pytest.raises(ValueError):
        dump.dump({"db.t": frame}, f"{folder}/x", what="all")


def test_unknown_and_ambiguous_tables(spark, folder):
    dump.dump({"a.t": spark.range(1), "b.t": spark.range(2)}, f"{folder}/d")
    with pytest.raises(ValueError):
        dumps.restore(spark, f"{folder}/d", "t")
    with pytest.raises(ValueError):
        dumps.restore(spark, f"{folder}/d", "u")
    assert dumps.restore(spark, f"{folder}/d", "t", database="b").count() == 2


def test_files_are_split(spark, folder):
    dump.dump({"t": spark.range(1000).coalesce(1)}, f"{folder}/d", max_records_per_file=300)
    assert len(glob.glob(f"{folder}/d/backup_data/t/part-*")) == 4
    assert dump.records_per_file(spark.range(10), 80) == 10


def test_rows_are_ordered_within_and_across_files(spark, folder):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(4)
    dump.dump({"t": df}, f"{folder}/d", order_by={"t": ["k"]})
    stored = dumps.restore(spark, f"{folder}/d", "t")
    rows = stored.select("k", F.col("_metadata.file_path"), F.col("_metadata.row_index")).collect()
    by_file = {}
    for key, file, at in rows:
        by_file.setdefault(file, []).append((at, key))
    ranges = []
    for pairs in by_file.values():
        keys = [k for _, k in sorted(pairs)]
        assert keys == sorted(keys)
        ranges.append((keys[0], keys[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_compression_levels(spark, folder):
    text = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("value"))
    sizes = {}
    for level in (0, 1, 9):
        dump.dump({"t": text.coalesce(1)}, f"{folder}/{level}", fmt="text", codec="gzip", level=level)
        sizes[level] = files.tree_size(files.file_inventory(spark, f"{folder}/{level}/backup_data")).first()[0]
    assert sizes[0] == 20000 * 65
    assert sizes[9] < sizes[1] < sizes[0]


def test_csv_refuses_what_it_would_change(spark, folder):
    dump.dump({"t": spark.createDataFrame([(None,), ("",)], "s string")}, f"{folder}/d", fmt="csv")
    assert {r[0] for r in dumps.restore(spark, f"{folder}/d", "t").collect()} == {None, ""}
    with pytest.raises(PySparkException):
        dump.dump({"t": spark.createDataFrame([("\\N",)], "s string")}, f"{folder}/e", fmt="csv")


def test_codecs_that_do_not_fit():
    for method, fmt in (("zstd", "csv"), ("bzip2", "parquet"), ("lzop", "json"), ("xz", "text")):
        with pytest.raises(ValueError, match=method):
            codec_for(method, fmt)
    with pytest.raises(ValueError):
        codec_for("gzip", "avro")
    assert codec_for("lzop", "csv", level=0) == "none"


def test_utc(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 12), datetime(2024, 1, 1, 12))], "a timestamp_ntz, b timestamp_ntz")
    assert tuple(dump.to_utc(df, "Europe/Paris").first()) == (datetime(2024, 7, 1, 10), datetime(2024, 1, 1, 11))


def test_snapshot_cut_is_inclusive(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 1, 0, 0, 1),)], "ts timestamp_ntz")
    cut = dump.snapshot_cut({"t": df, "u": df}, {"t": "ts"}, datetime(2024, 1, 1))
    assert (cut["t"].count(), cut["u"].count()) == (1, 2)


def test_insert_statements(spark):
    row = (1, "it's\\\n", None, True, bytearray(b"\x0a\xff"), date(2024, 1, 1), [1, 2])
    df = spark.createDataFrame([row], "id int, s string, n double, b boolean, bin binary, d date, a array<int>")
    [(statement,)] = dump.to_insert_sql(df, "o`dd", extended=False, hex_blob=True, ignore=True).collect()
    assert statement == "INSERT IGNORE INTO `o``dd` VALUES (1,'it\\'s\\\\\\n',NULL,1,0x0AFF,'2024-01-01','[1,2]');"
    [(bare,)] = dump.to_insert_sql(df.select("id"), "t", extended=False, quote_names=False).collect()
    assert bare == "INSERT INTO t VALUES (1);"
    with pytest.raises(ValueError):
        dump.to_insert_sql(df, "t")


def test_extended_statements_hold_every_row_in_order(spark):
    df = spark.range(1000).repartition(5)
    got = dump.to_insert_sql(df, "t", key="id", chunk_bytes=500).orderBy("chunk_id").collect()
    head = "INSERT INTO `t` VALUES "
    assert len(got) > 5 and all(len(r["statement"]) < len(head) + 500 + 20 + 200 for r in got)
    values = ",".join(r["statement"].removeprefix(head).removesuffix(";") for r in got)
    assert values == ",".join(f"({i})" for i in range(1000))


def test_plan_order(spark):
    tbls = spark.createDataFrame([("a", "x", 9, 0, False), ("a", "y", 1, 1, False), ("b", "z", 5, 0, True), ("a", "w", 2, 0, False)],
                                 "database string, name string, data_size long, index_size long, excluded boolean")
    plan = dump.dump_plan(tbls, "/d", order_by_size=True).collect()
    assert [(r["name"], r["est_bytes"], r["path"]) for r in plan] == [
        ("w", 2, "/d/backup_data/a/w"), ("y", 2, "/d/backup_data/a/y"), ("x", 9, "/d/backup_data/a/x")]


def test_arguments_go_by_encoded_name(spark):
    dbs = spark.createDataFrame([("a b",), ("c",), ("a(20)b",)], "name string")
    got = {r["name"]: r["extra_arg"] for r in dump.with_args(dbs, '{"a(20)b": "x"}').collect()}
    assert got == {"a b": "x", "c": None, "a(20)b": "x"}
    assert dump.with_args(dbs, None).where("extra_arg is not null").isEmpty()


def test_many_databases_in_one_job(spark, folder):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot / x").otherwise(F.concat(F.lit("d"), F.col("id") % 5)).alias("database"), "id")
    dump.dump_partitioned(df, f"{folder}/d")
    assert same(spark.read.parquet(f"{folder}/d/backup_data").select("database", "id"), df)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_one_dataset_keeps_odd_names_apart(spark, folder, fmt):
    tables = {("", "orders"): 5, ("1", "t"): 2, ("01", "t"): 3, ("é/b", "x=%y"): 4, ("(empty)", "orders"): 1}
    frames = {name: spark.range(n).withColumn("t", F.lit("x")) for name, n in tables.items()}
    dump.dump(frames, f"{folder}/d", per_database=False, fmt=fmt)
    for (database, name), n in tables.items():
        assert dumps.restore(spark, f"{folder}/d", name, database=database).count() == n


def test_levels_are_passed_on_or_refused(spark, folder):
    for fmt, codec in (("orc", "gzip"), ("orc", "zstd"), ("csv", "bzip2"), ("parquet", "snappy")):
        with pytest.raises(ValueError, match="no level"):
            dump.dump({"t": spark.range(3)}, f"{folder}/{fmt}-{codec}", fmt=fmt, codec=codec, level=3)
    dump.dump({"t": spark.range(3)}, f"{folder}/deflate", fmt="csv", codec="deflate", level=9)
    assert dumps.restore(spark, f"{folder}/deflate", "t").count() == 3


def test_files_are_split_by_bytes(spark, folder):
    rows = spark.range(20_000).coalesce(1)
    dump.dump({"t": rows}, f"{folder}/s", fmt="json", codec="none", split_bytes=50_000)
    sizes = [r[0] for r in dumps.restore(spark, f"{folder}/s", "t").select("_metadata.file_size").distinct().collect()]
    files = dumps.restore(spark, f"{folder}/s", "t").select("_metadata.file_path").distinct().count()
    assert files > 4 and max(sizes) < 60_000
    with_both = dump.dump({"big": rows, "small": spark.range(2)}, f"{folder}/o", order_by_size=True, dry_run=True)
    assert [r["name"] for r in with_both.collect()] == ["small", "big"]


@pytest.mark.parametrize("per_database", [True, False])
def test_no_file_exceeds_the_limit_by_more_than_a_row(spark, folder, per_database):
    rows = spark.range(4000).select("id", F.repeat(F.lit("x"), F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 900).cast("int")).alias("text"), F.lit(5).alias("_slice"))
    dump.dump({"a.t": rows, "a.u": spark.range(10)}, f"{folder}/s", fmt="json", codec="none", split_bytes=100_000, per_database=per_database, order_by={"a.t": ["id"]} if per_database else None)
    back = dumps.restore(spark, f"{folder}/s", "t")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/s/backup_data").agg(F.max("length")).first()[0]
    assert files < 100_000 + 1100 and back.columns == ["id", "text", "_slice"]
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()


def test_numbers_that_sql_cannot_write(spark):
    rows = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "k long, v double")
    texts = [r["statement"] for r in dump.to_insert_sql(rows.coalesce(1), "t", extended=False).collect()]
    assert texts == ["INSERT INTO `t` VALUES (1,NULL);", "INSERT INTO `t` VALUES (2,NULL);", "INSERT INTO `t` VALUES (3,1.5);"]
    with pytest.raises(PySparkException, match="no number"):
        dump.to_insert_sql(rows, "t", extended=False, strict=True).collect()
    by_text = rows.select(F.concat(F.lit("x"), "k").alias("name"), "k")
    chunks = dump.to_insert_sql(by_text, "t", key=["name", "k"], chunk_bytes=20).orderBy("chunk_id").collect()
    assert "".join(r["statement"] for r in chunks).count("(") == 3
