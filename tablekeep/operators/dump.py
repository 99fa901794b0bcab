"""Writing dumps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.functions.text import path_name, path_name_column, safe_name
from tablekeep.operators.sizing import table_size
from tablekeep.plans.chunks import chunk_plan
from tablekeep.plans.formats import FORMAT_OPTIONS, codec_for, writer_for
from tablekeep.plans.settled import settle
from tablekeep.plans.sliced import unused

DATA_DIR = "backup_data"
MANIFEST_DIR = "manifest"
ALL_DATABASES = "all_databases"
DUMP_THREADS = 4
# No encoded name looks like this: letters in parentheses are hexadecimal digits.
EMPTY_NAME = "(empty)"
# What a manifest says of a table that a stream writes batch by batch.
STREAMED = "stream"
COMBINED_SCHEMA = "database string, name string, row string"

MANIFEST_SCHEMA = (
    "database string, name string, path string, format string, codec string, per_database boolean, "
    "what string, schema string"
)

TableName = tuple[str, str]


def manifest(dbs: DataFrame, ext: str = "") -> DataFrame:
    """``DF(name, file)`` of the databases that are not excluded."""
    return dbs.where(~F.col("excluded")).select(
        "name", F.concat(safe_name("name"), F.lit(".sql" + ext)).alias("file")
    )


def with_args(dbs: DataFrame, args_json: str | None) -> DataFrame:
    """Add ``extra_arg``, looked up by the *encoded* database name in a JSON object."""
    args = F.from_json(F.lit(args_json or "{}"), "map<string,string>")
    return dbs.withColumn("extra_arg", F.try_element_at(args, safe_name("name")))


def dump_plan(
    tbls: DataFrame, root: str, per_database: bool = True, order_by_size: bool = False
) -> DataFrame:
    """What a dump would write, as ``DF(database, name, path, est_bytes)``; nothing is written.

    ``order_by_size`` puts small tables first.
    """
    folder = f"{root}/{DATA_DIR}"
    if per_database:
        path = F.concat_ws("/", F.lit(folder), path_name_column("database"), path_name_column("name"))
    else:
        path = F.lit(f"{folder}/{ALL_DATABASES}")
    kept = tbls.where(~F.col("excluded"))
    order = ["est_bytes", "database", "name"] if order_by_size else ["database", "name"]
    return kept.select("database", "name", path.alias("path"), table_size().alias("est_bytes")).orderBy(*order)


def ddl(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The columns of each table and its number of rows:
    ``DF(table, position, column, type, n_rows)``."""

    def columns(name: str, df: DataFrame) -> DataFrame:
        fields = F.array(
            *(
                F.struct(
                    F.lit(at).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")
                )
                for at, f in enumerate(df.schema.fields, start=1)
            )
        )
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        return counted.select(F.lit(name).alias("table"), F.inline(fields), "n_rows")

    return reduce(DataFrame.unionByName, (columns(name, df) for name, df in tables.items()))


def snapshot_cut(
    tables: Mapping[str, DataFrame], ts_cols: Mapping[str, str], cut: datetime
) -> dict[str, DataFrame]:
    """Every table as it was at one instant; a table without a time column stays whole."""
    return {
        name: df.where(F.col(ts_cols[name]) <= F.lit(cut).cast(df.schema[ts_cols[name]].dataType))
        if name in ts_cols
        else df
        for name, df in tables.items()
    }


def to_utc(df: DataFrame, zone: str) -> DataFrame:
    """Local times of ``zone`` in every zone-less timestamp column, written as UTC."""
    return df.withColumns(
        {
            f.name: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(f.name))
            for f in df.schema.fields
            if isinstance(f.dataType, T.TimestampNTZType)
        }
    )


def combine_tables(tables: Mapping[TableName, DataFrame]) -> DataFrame:
    """All tables as one: ``DF(database, name, row)`` with each row as JSON."""

    def rows(table: TableName, df: DataFrame) -> DataFrame:
        as_json = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), FORMAT_OPTIONS["json"])
        return df.select(F.lit(table[0]).alias("database"), F.lit(table[1]).alias("name"), as_json.alias("row"))

    return reduce(DataFrame.unionByName, (rows(table, df) for table, df in tables.items()))


def text_bytes(df: DataFrame) -> int:
    """Bytes of the rows as text."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0] or 0


def records_per_file(df: DataFrame, split_bytes: int) -> int:
    """Rows that make about ``split_bytes`` of text when rows are alike. Reads the table once to get the mean."""
    size = F.octet_length(F.to_json(F.struct("*")))
    mean = df.agg(F.avg(size)).first()[0]
    return max(1, int(split_bytes / mean)) if mean else 1


def cut_by_bytes(df: DataFrame, split_bytes: int, order_by: Sequence[str] = (), row_bytes: Column | None = None) -> DataFrame:
    """``df`` with one partition, and so one file, for every ``split_bytes`` of its rows as text.

    A row counts as ``row_bytes``, or as its JSON text and a line break. A partition has less than ``split_bytes`` plus
    one row, however unlike the rows are. Rows are taken in the order of ``order_by``, which must
    be unique, or in the order they are read.
    """
    numbered, files, order, file = number_by_bytes(df, split_bytes, order_by, row_bytes)
    dealt = numbered.repartitionById(files, F.col(file).cast("int"))
    return (dealt.sortWithinPartitions(*order) if order_by else dealt).select(*(F.col(f"`{c}`") for c in df.columns))


def number_by_bytes(
    df: DataFrame, split_bytes: int, order_by: Sequence[str] = (), row_bytes: Column | None = None
) -> tuple[DataFrame, int, list[str], str]:
    """The rows, how many files they make for ``cut_by_bytes``, the columns to sort by and that of the file's number.

    The rows are settled once, however dear they are to make. Only their keys and sizes are put in
    order and added up; the numbers are joined back to the settled rows.
    """
    at, size, file, row, same = (unused(df, name) for name in ("_at", "_bytes", "chunk_id", "_row", "_same"))
    if file != "chunk_id":
        raise ValueError("a table cut by bytes has no column of its own called chunk_id")
    if row_bytes is None:
        row_bytes = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), FORMAT_OPTIONS["json"])) + 1
    sized = settle(df.withColumns({row: F.monotonically_increasing_id(), size: row_bytes}), "sized-rows")
    place = F.struct(*order_by) if order_by else F.col(row)
    plan = chunk_plan(sized.select(place.alias(at), F.col(row).alias(same), size), at, size, split_bytes)
    plan = settle(plan.select(same, file), "cut-rows")
    files = int(plan.agg(F.max(file)).first()[0] or 0) + 1
    numbered = sized.drop(size).join(plan.hint("shuffle_hash"), F.col(row) == F.col(same)).drop(same)
    return numbered, files, [*order_by, row], file


def table_name(name: str | TableName) -> TableName:
    """``'db.table'`` as a pair; a name without a dot has an empty database."""
    if isinstance(name, tuple):
        return name
    database, _, table = name.rpartition(".") if name.count(".") < 2 else name.partition(".")
    return database, table


def partition_name(name: str) -> str:
    """A name as the value of a partition column: never empty, never taken for a number's other spelling."""
    return path_name(name) or EMPTY_NAME


def table_path(database: str, table: str) -> str:
    return "/".join(path_name(part) for part in (database, table) if part)


def dump(
    tables: Mapping[str | TableName, DataFrame],
    root: str,
    per_database: bool = True,
    fmt: str = "parquet",
    codec: str | None = None,
    level: int | None = None,
    max_records_per_file: int = 0,
    split_bytes: int = 0,
    order_by_size: bool = False,
    order_by: Mapping[str | TableName, Sequence[str]] | None = None,
    what: str = "both",
    local_zone: str | None = None,
    dry_run: bool = False,
    threads: int = DUMP_THREADS,
) -> DataFrame:
    """Write tables below ``root`` and return the manifest.

    Tables are written in the given order, or small ones first with ``order_by_size``, up to ``threads`` jobs at a time, each by its own
    tasks. The manifest comes last: a dump without one failed. ``what`` is ddl, data or both;
    the schemas are in the manifest. ``local_zone`` turns local times into UTC. ``order_by``
    names the columns a table is sorted by, across its files too; make them a unique key, as rows
    with equal keys stay in one task. ``split_bytes`` cuts files after so many bytes of text, as
    ``cut_by_bytes`` counts them, by running totals: none has more than that plus one row.
    ``dry_run`` writes nothing.
    """
    if what not in ("ddl", "data", "both"):
        raise ValueError("what must be ddl, data or both")
    if not tables:
        raise ValueError("no tables to dump")
    named = {table_name(name): to_utc(df, local_zone) if local_zone else df for name, df in tables.items()}
    sort_keys = {table_name(name): list(keys) for name, keys in (order_by or {}).items()}
    if order_by_size:
        named = dict(sorted(named.items(), key=lambda item: text_bytes(item[1])))
    spark = next(iter(named.values())).sparkSession
    chosen = codec_for(codec, fmt, level)

    def relative(table: TableName) -> str:
        return f"{DATA_DIR}/{table_path(*table) if per_database else ALL_DATABASES}"

    plan = spark.createDataFrame(
        [
            (*table, relative(table), fmt, chosen, per_database, what, df.schema.json() if what != "data" else None)
            for table, df in named.items()
        ],
        MANIFEST_SCHEMA,
    )
    if dry_run:
        return plan

    def write(table: TableName) -> None:
        df = named[table]
        if split_bytes:
            df = cut_by_bytes(df, split_bytes, sort_keys.get(table, ()))
        elif table in sort_keys:
            df = df.repartitionByRange(*sort_keys[table]).sortWithinPartitions(*sort_keys[table])
        writer = writer_for(df, fmt, codec, level)
        writer.option("maxRecordsPerFile", max_records_per_file).save(f"{root}/{relative(table)}")

    if what != "ddl" and per_database:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for done in [pool.submit(inheritable_thread_target(spark)(write), table) for table in named]:
                done.result()
    elif what != "ddl":
        # one folder per table keeps a selective restore from reading the rest
        together = combine_tables({tuple(map(partition_name, table)): df for table, df in named.items()})
        if split_bytes:
            together = cut_by_bytes(together, split_bytes)
        writer = writer_for(together, fmt, codec, level).partitionBy("database", "name")
        writer.option("maxRecordsPerFile", max_records_per_file).save(f"{root}/{DATA_DIR}/{ALL_DATABASES}")
    plan.coalesce(1).write.json(f"{root}/{MANIFEST_DIR}")
    return plan


def dump_partitioned(
    df: DataFrame, root: str, database: str = "database", fmt: str = "parquet", codec: str | None = None
) -> None:
    """Write one table that holds many databases, one folder each, in one job.

    Spark gathers each database into few files and splits the large ones over several tasks.
    """
    balanced = df.hint("rebalance", database)
    writer_for(balanced, fmt, codec, None).partitionBy(database).save(f"{root}/{DATA_DIR}")


_ESCAPES = [("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")]


def _literal(field: T.StructField, hex_blob: bool, strict: bool) -> Column:
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.BooleanType):
        text = col.cast("int").cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        refused = F.raise_error(F.lit(f"{field.name} holds a value that is no number")).cast("string")
        odd = F.isnan(col) | (F.abs(col) == float("inf"))
        text = F.when(odd, refused if strict else F.lit(None).cast("string")).otherwise(col.cast("string"))
    elif isinstance(kind, T.NumericType):
        text = col.cast("string")
    elif isinstance(kind, T.BinaryType) and hex_blob:
        text = F.when(F.length(col) == 0, "''").otherwise(F.concat(F.lit("0x"), F.hex(col)))
    else:
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        plain = F.to_json(col) if nested else col.cast("string")
        for raw, escaped in _ESCAPES:
            plain = F.replace(plain, F.lit(raw), F.lit(escaped))
        text = F.concat(F.lit("'"), plain, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def _identifier(name: str, quote_names: bool) -> str:
    return "`" + name.replace("`", "``") + "`" if quote_names else name


def to_insert_sql(
    df: DataFrame,
    table: str,
    extended: bool = True,
    hex_blob: bool = False,
    ignore: bool = False,
    quote_names: bool = True,
    key: str | Sequence[str] | None = None,
    chunk_bytes: int = 1024**2,
    strict: bool = False,
) -> DataFrame:
    """The rows as ``INSERT`` statements, ``DF(statement)``.

    NaN and infinite numbers, which SQL cannot write, become NULL, or an error if ``strict``.

    The extended form puts many rows, in the order of the unique ``key``, one or more columns, into
    statements of about ``chunk_bytes`` and adds ``chunk_id``. No statement is larger than that
    plus one row, so no task gathers more.
    """
    values = F.concat(
        F.lit("("), F.concat_ws(",", *(_literal(f, hex_blob, strict) for f in df.schema.fields)), F.lit(")")
    )
    head = F.lit(f"INSERT {'IGNORE ' if ignore else ''}INTO {_identifier(table, quote_names)} VALUES ")
    if not extended:
        return df.select(F.concat(head, values, F.lit(";")).alias("statement"))
    if key is None:
        raise ValueError("extended statements need the key that orders the rows")
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(F.struct(*keys).alias("_order"), values.alias("_values"))
    sized = rows.withColumn("_bytes", F.octet_length("_values"))
    in_order = F.sort_array(F.collect_list(F.struct("_order", "_values")))
    return (
        chunk_plan(sized, "_order", "_bytes", chunk_bytes)
        .groupBy("chunk_id")
        .agg(in_order.alias("_rows"))
        .select("chunk_id", F.concat(head, F.array_join("_rows._values", ","), F.lit(";")).alias("statement"))
    )
