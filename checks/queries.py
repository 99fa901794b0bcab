"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import adapters as a
from tablekeep.functions import globs, sizes, text, times, values
from tablekeep.operators import changes, dump, filters, history, kept, packing, retention, settings, sizing
from tablekeep.plans.chunks import chunk_plan
from tablekeep.session import scratch_dir
from tablekeep.sources import catalog, documents, dumps, files, runs, snapshots, stores
from tablekeep.sources.inserts import from_insert_sql
from tablekeep.streaming.changes import compact, stream_apply, streamed_state
from tablekeep.streaming.dump import Position, fold_dump, stream_dump, stream_dump_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

CUTS = (datetime(2000, 1, 1), datetime(2024, 1, 15))
RUN_ORDER = ("name", "run_id")
POSITION_CUT = datetime(2024, 1, 15)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


# Scans


@query
def list_databases(spark, sf):
    return a.databases(spark, sf)


@query
def list_databases_flags(spark, sf):
    return catalog.catalog_databases(a.raw_databases(spark, sf), kind="pg")


@query
def table_metadata(spark, sf):
    return a.tables(spark, sf)


@query
def table_metadata_fast(spark, sf):
    return catalog.catalog_tables(a.raw_tables(spark, sf), sizes=False)


def _recorded_runs(spark, sf, root=None):
    """A run for each type and day of all events, written as records and read back."""
    root = root or scratch_dir(spark, "runs")
    daily = a.table(spark, sf, "events").groupBy(F.col("event_type").alias("backupset"), F.to_date("ts").alias("day"))
    found = daily.agg(
        times.run_name(F.max("ts")).alias("name"),
        F.when(F.max("event_id") % 5 == 0, "").otherwise(F.max("event_type")).alias("plugin"),
        (F.sum("event_id") % 3 == 0).alias("failed"),
        F.sum("event_id").alias("estimated_size"),
        F.count(F.lit(1)).alias("on_disk_size"),
    )
    runs.write_run_records(found.drop("day"), root)
    return runs.scan_runs(spark, root, file_name="part-*")


@query
def scan_runs(spark, sf):
    return _recorded_runs(spark, sf).select("backupset", "name", "plugin", "failed", "estimated_size", "on_disk_size")


@query
def retention_scanned(spark, sf):
    return retention.retention_plan(_recorded_runs(spark, sf), 3).select("backupset", "name", "action")


@query
def runs_left(spark, sf):
    """What is left after the runs a plan purges are deleted."""
    root = scratch_dir(spark, "runs")
    plan = retention.retention_plan(_recorded_runs(spark, sf, root), 3)
    runs.delete_runs(spark, root, plan)
    return runs.scan_runs(spark, root, file_name="part-*").select("backupset", "name")


@query
def run_name_filter(spark, sf):
    name = times.run_name("ts")
    which = F.col("event_id") % 4
    candidate = (
        F.when(which == 0, name)
        .when(which == 1, F.concat(name, F.lit("x")))
        .when(which == 2, F.concat_ws("_", "event_type", F.col("event_id").cast("string")))
        .otherwise(F.date_format("ts", "yyyy13dd_HHmmss"))
    )
    return runs.run_name_filter(a.table(spark, sf, "events").select("event_id", candidate.alias("name")))


@query
def tree_size(spark, sf):
    root = scratch_dir(spark, "tree")
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    line = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    a.table(spark, sf, "lineitem").select(line.alias("value")).write.text(root)
    return files.tree_size(files.file_inventory(spark, root))


@query
def tree_size_hidden(spark, sf):
    root = scratch_dir(spark, "tree")
    a.file_tree(spark, sf, root)
    return files.tree_size(files.file_inventory(spark, root, hidden=True))


@query
def tree_listing(spark, sf):
    """Files and folders per level of a tree with hidden names."""
    root = scratch_dir(spark, "tree")
    a.file_tree(spark, sf, root)
    return stores.listing(spark, root).groupBy("level", "is_folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("is_folder"), 0).otherwise(F.col("length"))).alias("bytes")
    )


@query
def restore_orders(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump({"shop.orders": a.table(spark, sf, "orders")}, root)
    return dumps.restore(spark, root, "orders", database="shop")


def _shop(spark, sf) -> dict[str, DataFrame]:
    return {
        "shop.customer": a.table(spark, sf, "customer"),
        "shop.orders": a.table(spark, sf, "orders"),
        "stock.part": a.table(spark, sf, "part"),
        "stock.supplier": a.table(spark, sf, "supplier"),
    }


@query
def restore_selected(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump(_shop(spark, sf), root, fmt="csv", codec="gzip", level=1)
    restored = dumps.restore_tables(spark, root, ["shop.*", "PART"])
    return changes.record_positions(
        restored,
        {"shop.customer": "c_custkey", "shop.orders": "o_orderkey", "stock.part": "p_partkey"},
        {"shop.customer": "c_acctbal", "shop.orders": "o_totalprice", "stock.part": "p_retailprice"},
    )


@query
def documents_json_roundtrip(spark, sf):
    root = scratch_dir(spark, "collection")
    a.table(spark, sf, "conversations").write.json(root, compression="gzip")
    return documents.scan_documents(spark, root)


def _drifting(spark, sf) -> DataFrame:
    """Turns as documents of two shapes whose fields have other types."""
    root = scratch_dir(spark, "drifting")
    turns = a.table(spark, sf, "conversations").select(
        "conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct("conv_id", "turn", "role", "text"))).otherwise(
            F.to_json(F.struct(
                F.concat(F.lit("c"), "conv_id").alias("conv_id"), F.struct(F.col("turn").alias("n")).alias("turn"),
                "role", F.array(F.octet_length("text").cast("bigint"), F.lit(None)).alias("parts"), F.struct(F.struct("text").alias("body")).alias("meta"),
            ))
        ).alias("line"),
    )
    turns.select("line").write.text(root, compression="gzip")
    return documents.scan_variants(spark, root)


@query
def documents_fields(spark, sf):
    return documents.field_catalog(_drifting(spark, sf))


@query
def documents_field_types(spark, sf):
    return documents.field_types(documents.field_catalog(_drifting(spark, sf)))


@query
def documents_columns(spark, sf):
    cut = documents.cut_columns(
        _drifting(spark, sf),
        {
            "number": ("bigint", "$.conv_id"),
            "name": ("string", "$.conv_id"),
            "turn": ("bigint", "$.turn", "$.turn.n"),
            "role": ("string", "$.role"),
            "text": ("string", "$.text", "$.meta.body.text"),
        },
    )
    return cut.drop("doc")


# Sinks


@query
def dump_per_database(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump_partitioned(a.tables(spark, sf), root)
    back = spark.read.parquet(f"{root}/{dump.DATA_DIR}")
    return back.groupBy("database").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("data_size").alias("data_bytes"), F.sum("index_size").alias("index_bytes")
    )


@query
def dump_all_counts(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump(_shop(spark, sf), root, per_database=False, fmt="parquet", codec="gzip")
    together = spark.read.parquet(f"{root}/{dump.DATA_DIR}/{dump.ALL_DATABASES}")
    return together.groupBy("database", "name").agg(F.count("row").alias("n_rows"))


@query
def restore_from_all(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump(_shop(spark, sf), root, per_database=False)
    return dumps.restore(spark, root, "orders")


@query
def restore_without_database(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump({"orders": a.table(spark, sf, "orders"), "x.orders": a.table(spark, sf, "customer")}, root, per_database=False, fmt="json")
    return dumps.restore(spark, root, "orders", database="")


@query
def restore_numeric_names(spark, sf):
    root, counts = scratch_dir(spark, "dump"), []
    tables = {("1", "t"): a.table(spark, sf, "orders"), ("01", "t"): a.table(spark, sf, "customer"), ("é b", "1.t"): a.table(spark, sf, "nation")}
    for fmt in ("parquet", "json", "csv"):
        dump.dump(tables, f"{root}/{fmt}", per_database=False, fmt=fmt)
        for database, name in tables:
            found = dumps.restore(spark, f"{root}/{fmt}", name, database=database)
            counts.append(found.agg(F.lit(fmt).alias("format"), F.lit(database).alias("database"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows")))
    return reduce(DataFrame.unionByName, counts)


CODECS = [
    ("csv", "bzip2"),
    ("csv", "lz4"),
    ("json", "deflate"),
    ("json", "gzip"),
    ("json", "snappy"),
    ("orc", "gzip"),
    ("orc", "zstd"),
    ("parquet", "none"),
    ("parquet", "pigz"),
    ("parquet", "zstd"),
]


@query
def codec_roundtrip(spark, sf):
    root = scratch_dir(spark, "codecs")
    result = None
    for fmt, codec in CODECS:
        where = f"{root}/{fmt}-{codec}"
        dump.dump({"orders": a.table(spark, sf, "orders")}, where, fmt=fmt, codec=codec)
        read = dumps.restore(spark, where, "orders").agg(
            F.lit(fmt).alias("format"),
            F.lit(codec).alias("codec"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("o_orderkey").alias("key_sum"),
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
            F.max("o_orderdate").alias("newest"),
        )
        result = read if result is None else result.unionByName(read)
    return result


@query
def chunk_plan_query(spark, sf):
    sized = a.table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    return chunk_plan(sized, "doc_id", "bytes", 64 * 1024)


@query
def chunk_plan_text_key(spark, sf):
    """By a text and a number together; the text is often the same."""
    sized = a.table(spark, sf, "conversations").select("role", "conv_id", "turn", F.octet_length("text").alias("bytes"))
    return chunk_plan(sized, ["role", "conv_id", "turn"], "bytes", 16 * 1024, slice_bytes=256 * 1024)


@query
def split_files_by_bytes(spark, sf):
    root = scratch_dir(spark, "dump")
    limit = 256 * 1024
    tables = {t: a.table(spark, sf, t) for t in ("orders", "documents")}
    dump.dump(tables, root, fmt="json", codec="none", split_bytes=limit, order_by_size=True)
    results = []
    for name, df in tables.items():
        size = F.octet_length(F.to_json(F.struct("*")))
        per_file = (
            dumps.restore(spark, root, name)
            .select(size.alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
            .groupBy("file", "size")
            .agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("largest"))
        )
        within = F.max(F.col("size") - F.col("largest")) <= limit
        results.append(per_file.agg(F.lit(name).alias("table"), F.sum("n").alias("n_rows"), within.alias("within_limit")))
    return results[0].unionByName(results[1])


@query
def split_files(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump({"orders": a.table(spark, sf, "orders")}, root, max_records_per_file=1000)
    per_file = (
        dumps.restore(spark, root, "orders")
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 1000).alias("within_limit"))


@query
def restore_insert_sql(spark, sf):
    """Tables written as statements, of one row and of many, and read back."""
    root, keys = scratch_dir(spark, "inserts"), {"conversations": ["conv_id", "turn"], "documents": ["doc_id"], "orders": ["o_orderkey"]}
    back = {}
    for name, key in keys.items():
        df = a.table(spark, sf, name)
        statements = dump.to_insert_sql(df, name, extended=name != "conversations", key=key, chunk_bytes=64 * 1024)
        statements.select("statement").write.parquet(f"{root}/{name}")
        back[name] = from_insert_sql(spark.read.parquet(f"{root}/{name}"), df.schema)
    talks = back["conversations"].select(F.lit("conversations").alias("table"), F.col("conv_id").alias("key"), F.col("turn").cast("string").alias("detail"), "text")
    docs = back["documents"].select(F.lit("documents").alias("table"), F.col("doc_id").alias("key"), F.col("lang").alias("detail"), "text")
    orders = back["orders"].select(
        F.lit("orders").alias("table"), F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("detail"), F.col("o_orderpriority").alias("text")
    )
    return talks.unionByName(docs).unionByName(orders)


@query
def manifest(spark, sf):
    dbs, _ = a.filtered(spark, sf)
    return dump.manifest(dbs, ".gz")


@query
def insert_sql(spark, sf):
    return dump.to_insert_sql(a.table(spark, sf, "conversations"), "chat", extended=False, ignore=True)


@query
def insert_sql_extended(spark, sf):
    return dump.to_insert_sql(a.table(spark, sf, "orders"), "orders", key="o_orderkey", chunk_bytes=64 * 1024)


@query
def order_by_primary(spark, sf):
    root = scratch_dir(spark, "dump")
    dump.dump({"orders": a.table(spark, sf, "orders")}, root, order_by={"orders": ["o_orderkey"]})
    stored = dumps.restore(spark, root, "orders").select(
        "o_orderkey", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    in_file = Window.partitionBy("file").orderBy("at")
    backwards = F.lag("o_orderkey").over(in_file) > F.col("o_orderkey")
    return stored.select("o_orderkey", backwards.alias("backwards")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("backwards").alias("n_unsorted"), F.sum("o_orderkey").alias("key_sum")
    )


@query
def ddl_columns(spark, sf):
    return dump.ddl({t: a.table(spark, sf, t) for t in ("customer", "lineitem", "orders")})


@query
def dump_current(spark, sf):
    return changes.dump_view(a.table(spark, sf, "events"), "user_id", "ts", tie="event_id")


@query
def dump_history(spark, sf):
    return changes.dump_view(a.table(spark, sf, "events"), "user_id", "ts", history=True, tie="event_id")


@query
def snapshot_cut_counts(spark, sf):
    tables = {t: a.table(spark, sf, t) for t in ("events", "lineitem", "nation", "orders")}
    columns = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}
    counts = [
        df.agg(F.lit(f"{at:%Y}").alias("cut"), F.lit(t).alias("table"), F.count(F.lit(1)).alias("n_rows"))
        for at in CUTS
        for t, df in dump.snapshot_cut(tables, columns, at).items()
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result


@query
def snapshot_pinned(spark, sf):
    """Tables that grow after their files were pinned."""
    root, names = scratch_dir(spark, "snapshot"), ("events", "orders")
    tables = {t: a.table(spark, sf, t) for t in names}
    for t, df in tables.items():
        df.repartition(3).write.parquet(f"{root}/{t}")
    snapshots.pin(spark, {t: f"{root}/{t}" for t in names}, f"{root}/pins")
    for t, df in tables.items():
        df.write.mode("append").parquet(f"{root}/{t}")
    events, orders = (snapshots.read_pinned(spark, f"{root}/pins", t, tables[t].schema) for t in names)
    keys = events.select(F.lit("events").alias("table"), F.col("event_id").alias("key"))
    return keys.unionByName(orders.select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("key")))


@query
def tz_utc(spark, sf):
    return dump.to_utc(a.table(spark, sf, "events"), "+02:00").select("event_id", "ts")


@query
def dump_plan(spark, sf):
    _, tbls = a.filtered(spark, sf)
    return dump.dump_plan(tbls, "/dumps/today")


@query
def order_by_size(spark, sf):
    _, tbls = a.filtered(spark, sf)
    return dump.dump_plan(tbls, "/dumps/today", per_database=False, order_by_size=True)


# Filters


@query
def filter_include(spark, sf):
    return a.tables(spark, sf).where(globs.include_glob("database", "Brand#[!12]", "*#2?"))


@query
def filter_exclude(spark, sf):
    return a.tables(spark, sf).where(globs.exclude_glob("name", "*RING*", "?????_w*[0-4]"))


@query
def filter_qualified(spark, sf):
    return a.tables(spark, sf).where(
        globs.include_glob_qualified("database", "name", "red_*", "brand#1?.*")
        & globs.exclude_glob_qualified("database", "name", "*5", "Brand#1.*")
    )


@query
def filter_regex(spark, sf):
    return a.tables(spark, sf).where(
        globs.include_regex("name", r"(?:red|small)_\w+_\d{2,3}$", "Blue") & globs.exclude_regex("database", r"brand#1\d")
    )


@query
def filter_engine(spark, sf):
    return filters.filter_engines(a.tables(spark, sf), ["*isam", "inno*", "view"], ["mrg_*"])


@query
def filtered_catalog(spark, sf):
    _, tbls = a.filtered(spark, sf)
    return tbls


@query
def filtered_databases(spark, sf):
    dbs, _ = a.filtered(spark, sf)
    return dbs


@query
def filter_optional(spark, sf):
    spec = filters.FilterSpec(exclude_engines=["view"])
    _, tbls = filters.apply_filters(a.databases(spark, sf), a.tables(spark, sf), spec)
    return tbls


@query
def excluded_tables(spark, sf):
    _, tbls = a.filtered(spark, sf)
    return filters.excluded(tbls).drop("excluded")


@query
def ignore_lines(spark, sf):
    _, tbls = a.filtered(spark, sf)
    return filters.ignore_lines(tbls)


@query
def find_tables(spark, sf):
    return filters.find_tables(a.tables(spark, sf), dbexc=["BRAND#3*"], tinc=["*_widget_*", "brand#4.*"], texc=["red*"])


@query
def find_excluded_tables(spark, sf):
    return filters.find_tables(a.tables(spark, sf), dbinc=["brand#?"], texc=["red*"], excluded=True)


@query
def find_databases(spark, sf):
    names = a.raw_databases(spark, sf).select("name")
    return filters.find_databases(names, dbexc=["*_schema", "brand#1*"])


@query
def valid_runs(spark, sf):
    return history.valid_runs(a.backup_runs(spark, sf)).select("backupset", "name", "run_id", "plugin")


@query
def exclude_files(spark, sf):
    inventory = a.files(spark, sf).select(F.concat_ws("/", "archive", "member").alias("path"), "length")
    return files.exclude_files(inventory, "*/FR/*", "*.log", "*1.txt")


@query
def filter_objects(spark, sf):
    kind = (
        F.when(F.col("event_type") == "click", "routine")
        .when(F.col("event_type") == "view", "event")
        .when(F.col("event_type") == "error", "trigger")
        .otherwise("user")
    )
    objects = a.table(spark, sf, "events").select(
        kind.alias("kind"),
        F.concat(F.lit("db"), F.col("user_id").cast("string")).alias("database"),
        F.concat_ws("_", "event_type", F.col("event_id").cast("string")).alias("name"),
    )
    return filters.filter_objects(
        objects, {"routine": (["db1*.*"], []), "event": ([], ["*7"]), "trigger": (["*_1*"], ["db2.*"])}
    )


# Joins


@query
def dump_set(spark, sf):
    _, tbls = a.filtered(spark, sf)
    return filters.dump_set(tbls)


@query
def invalid_views(spark, sf):
    valid, quarantined = changes.invalid_views(*a.views(spark, sf))
    return valid.withColumn("status", F.lit("valid")).unionByName(
        quarantined.withColumn("status", F.lit("quarantined"))
    )


@query
def invalid_views_deep(spark, sf):
    return changes.broken_views(*a.nested_views(spark, sf))


@query
def arg_per_database(spark, sf):
    return dump.with_args(a.databases(spark, sf), '{"Brand#1": "--hex-blob", "Brand#22": "--where=1", "gone": "x"}')


@query
def merge_settings(spark, sf):
    override = a.set_settings(spark, sf)
    provider = settings.for_scopes(override.select("scope").distinct(), a.SETTINGS)
    return settings.merge_settings(provider, override)


@query
def validate_settings(spark, sf):
    return settings.validate_settings(a.set_settings(spark, sf), a.SETTINGS)


@query
def position_drift(spark, sf):
    events = a.table(spark, sf, "events")
    before = changes.position_marks(
        events.where(F.col("ts") <= F.lit(POSITION_CUT).cast("timestamp_ntz")), "event_type", "event_id", "ts"
    )
    return changes.position_drift(before, changes.position_marks(events, "event_type", "event_id", "ts"))


@query
def apply_changes(spark, sf):
    return changes.apply_changes(a.base_state(spark, sf), a.change_log(spark, sf), "key", "seq")


@query
def apply_changes_incremental(spark, sf):
    return changes.apply_changes(
        a.base_state(spark, sf), a.change_log(spark, sf), "key", "seq", incremental=True
    )


@query
def apply_log_kept(spark, sf):
    """The log in three parts, applied in place; the second part is late."""
    root = scratch_dir(spark, "kept")
    kept.keep(a.base_state(spark, sf), root, "key", buckets=8)
    log = a.change_log(spark, sf)
    for part in (F.col("seq") % 3 == 0, F.col("seq") % 3 == 2, F.col("seq") % 3 == 1):
        latest = log.where(part)
        newer = log.join(latest.select("key").distinct(), "key", "left_semi")
        kept.apply_log(spark, root, newer, "seq", ("value",))
    return kept.kept(spark, root)


@query
def history_kept(spark, sf):
    """Versions delivered in three parts, the oldest last, and some twice."""
    root = scratch_dir(spark, "kept")
    events, day = a.table(spark, sf, "events"), F.dayofmonth("ts")
    kept.keep_history(events.where(day > 20), root, "user_id", "ts", "event_id", buckets=8)
    kept.add_versions(spark, root, events.where(day.between(8, 22)), "ts", "event_id")
    kept.add_versions(spark, root, events.where(day < 8), "ts", "event_id")
    return kept.kept(spark, root)


# Aggregations


@query
def table_size(spark, sf):
    return a.tables(spark, sf).select("database", "name", sizing.table_size().alias("size"))


@query
def database_sizes(spark, sf):
    return sizing.database_sizes(*a.filtered(spark, sf))


@query
def estimate_total(spark, sf):
    return sizing.estimate(*a.filtered(spark, sf))


@query
def estimate_pages(spark, sf):
    return sizing.estimate_pages(a.table(spark, sf, "part"), F.col("p_size"))


@query
def estimate_storage(spark, sf):
    return sizing.estimate_storage(a.raw_tables(spark, sf), F.col("data_length"))


@query
def historic_estimate(spark, sf):
    return history.historic_estimate(a.backup_runs(spark, sf), order=RUN_ORDER).select(
        "backupset", "name", "run_id", "required_bytes", "basis"
    )


@query
def space_check(spark, sf):
    capacity = a.capacity(spark, sf)
    return history.space_check(capacity.select("backupset", "required_bytes"), capacity)


@query
def low_space(spark, sf):
    return history.low_space(a.capacity(spark, sf)).select("backupset", "free_bytes", "total_bytes")


@query
def estimate_accuracy(spark, sf):
    return history.estimate_accuracy(a.backup_runs(spark, sf)).select("backupset", "run_id", "percent")


@query
def lock_mode(spark, sf):
    return sizing.lock_mode(*a.filtered(spark, sf))


@query
def lock_mode_fixed(spark, sf):
    dbs, tbls = a.filtered(spark, sf)
    chosen = [sizing.lock_mode(dbs, tbls, method).withColumn("method", F.lit(method)) for method in sizing.LOCK_OPTIONS]
    return reduce(DataFrame.unionByName, chosen)


@query
def lock_mode_all(spark, sf):
    """One option for everything: restricted, unrestricted, and for InnoDB tables only."""
    _, tbls = a.filtered(spark, sf)
    safe = tbls.where(F.col("engine") == "innodb")
    found = [
        sizing.lock_mode_all(frame, unrestricted).withColumn("kind", F.lit(kind))
        for kind, frame, unrestricted in (("some", tbls, False), ("all", tbls, True), ("innodb", safe, False))
    ]
    return reduce(DataFrame.unionByName, found)


@query
def non_transactional(spark, sf):
    return sizing.non_transactional(a.tables(spark, sf))


@query
def purge_summary(spark, sf):
    return retention.purge_summary(retention.retention_plan(a.backup_runs(spark, sf), 3, RUN_ORDER))


@query
def run_report(spark, sf):
    return history.run_report(a.backup_runs(spark, sf))


@query
def record_positions(spark, sf):
    tables = {t: a.table(spark, sf, t) for t in ("events", "lineitem", "orders")}
    return changes.record_positions(
        tables,
        {"events": "event_id", "lineitem": "l_orderkey", "orders": "o_orderkey"},
        {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"},
    )


@query
def run_sets(spark, sf):
    return history.run_sets(a.backup_runs(spark, sf))


# Windows, sorts and sets


def _planned(plan: DataFrame) -> DataFrame:
    return plan.select("backupset", "name", "run_id", "action")


@query
def retention_plan(spark, sf):
    return _planned(retention.retention_plan(a.backup_runs(spark, sf), 3, RUN_ORDER))


@query
def retention_policies(spark, sf):
    user = F.substring("backupset", 4, 20).cast("bigint")
    policy = F.when(user % 3 == 0, "manual").when(user % 3 == 1, "before-backup").otherwise("after-backup")
    result = None
    for event in ("before-backup", "after-backup", "all"):
        counted = a.backup_runs(spark, sf).withColumn(
            "keep", retention.effective_keep((user % 4).cast("int"), policy, event)
        )
        plan = _planned(retention.retention_plan(counted, "keep", RUN_ORDER)).withColumn("event", F.lit(event))
        result = plan if result is None else result.unionByName(plan)
    return result


@query
def purge_on_demand(spark, sf):
    return _planned(retention.purge_on_demand(a.backup_runs(spark, sf), a.capacity(spark, sf), RUN_ORDER))


@query
def newest_oldest(spark, sf):
    return history.newest_oldest(a.backup_runs(spark, sf))


@query
def list_runs(spark, sf):
    return history.list_runs(history.valid_runs(a.backup_runs(spark, sf)), order=RUN_ORDER).select(
        F.concat_ws("/", "backupset", "name").alias("run"),
        "run_id",
        times.format_datetime("start_time").alias("started"),
        times.format_datetime("stop_time").alias("finished"),
        sizes.format_bytes("estimated_size").alias("estimated"),
        sizes.format_bytes("on_disk_size").alias("on_disk"),
    )


@query
def find_run(spark, sf):
    return history.find_run(a.backup_runs(spark, sf), "set8/20240101_000007").select("backupset", "name", "run_id")


@query
def newest_n(spark, sf):
    return retention.newest_n(a.backup_runs(spark, sf), 2, RUN_ORDER).select("backupset", "name", "run_id")


@query
def survivors(spark, sf):
    all_runs = a.backup_runs(spark, sf)
    plan = retention.retention_plan(all_runs.where(~F.col("failed")), 2, RUN_ORDER)
    return retention.survivors(all_runs, plan, order=RUN_ORDER).select("backupset", "name", "run_id")


@query
def partition_sources(spark, sf):
    sources = a.raw_tables(spark, sf)
    good, bad = filters.partition_sources(sources, F.col("data_length") > 1_000_000)
    return (
        good.withColumn("valid", F.lit(True))
        .unionByName(bad.withColumn("valid", F.lit(False)))
        .select("database", "name", "valid")
    )


# Scalars


@query
def safe_name(spark, sf):
    return a.names(spark, sf).select(text.safe_name("s").alias("safe"))


@query
def format_bytes(spark, sf):
    n = F.floor(F.col("value") * F.pow(F.lit(8.0), (F.col("event_id") % 11).cast("double")))
    return a.table(spark, sf, "events").select("event_id", sizes.format_bytes(n).alias("size"))


@query
def format_bytes_signed(spark, sf):
    n = F.floor((F.col("value") - 20) * F.pow(F.lit(8.0), (F.col("event_id") % 11).cast("double")))
    return a.table(spark, sf, "events").select("event_id", sizes.format_bytes_signed(n).alias("size"))


@query
def parse_size(spark, sf):
    return a.size_texts(spark, sf).select("event_id", sizes.parse_size("s").alias("bytes"))


@query
def parse_bytes(spark, sf):
    return a.size_texts(spark, sf).select("event_id", sizes.parse_bytes("s").alias("bytes"))


@query
def format_interval(spark, sf):
    seconds = (F.col("event_id") * 977) % 2_000_000 + F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") / 4)
    return a.table(spark, sf, "events").select("event_id", times.format_interval(seconds).alias("interval"))


@query
def run_name(spark, sf):
    return a.table(spark, sf, "events").select(
        "event_id",
        times.run_name("ts").alias("name"),
        times.parse_run_name(times.run_name("ts")).alias("parsed"),
        times.format_datetime("ts").alias("shown"),
    )


@query
def key_names(spark, sf):
    key = F.concat_ws("_", F.translate("p_name", " ", "-"), F.col("p_type"), F.col("p_partkey").cast("string"))
    canonical = text.canonical_key(key)
    return a.table(spark, sf, "part").select(
        "p_partkey", canonical.alias("canonical"), text.kebab_to_camel(canonical).alias("camel")
    )


@query
def parse_version(spark, sf):
    number = F.concat_ws(
        ".", (F.col("event_id") % 12).cast("string"), (F.col("user_id") % 20).cast("string"), F.regexp_extract("props", r"(\d+)", 1)
    )
    banner = F.when(F.col("event_id") % 7 == 0, "unknown").otherwise(F.concat(F.lit("server "), number, F.lit("-log")))
    version = values.parse_version(values.find_version(banner))
    return a.table(spark, sf, "events").select(
        "event_id",
        F.array_join(version.cast("array<string>"), ".").alias("version"),
        (version >= F.array(F.lit(8), F.lit(4))).alias("recent"),
    )


@query
def fill_template(spark, sf):
    template = F.concat(F.lit("run $backupset in ${backupdir} for $hook, $missing, $$5, "), F.col("plugin"))
    filled = text.fill_template(
        template,
        {"backupset": F.col("backupset"), "backupdir": F.concat_ws("/", F.lit("/spool"), "backupset", "name"), "hook": "after"},
    )
    return a.backup_runs(spark, sf).select("run_id", filled.alias("command"))


@query
def archive_name(spark, sf):
    path = F.concat(F.lit("//srv/"), F.col("url"))
    return a.table(spark, sf, "pages").select("page_id", text.archive_name(path).alias("archive"))


@query
def relative_path(spark, sf):
    path = F.concat_ws("/", F.lit("/spool"), "backupset", "name")
    return a.backup_runs(spark, sf).select(
        "run_id",
        text.relative_to(path, "/spool/set1").alias("relative"),
        text.remap_path(path, "/spool", "/mnt/snapshot").alias("remapped"),
    )


@query
def quoting(spark, sf):
    return a.names(spark, sf).select(
        text.quote_double("s").alias("double_quoted"),
        text.quote_identifier("s").alias("identifier"),
        text.quote_url("s").alias("url"),
    )


@query
def flatten_list(spark, sf):
    lists = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    words = text.flatten_list(lists)
    return a.table(spark, sf, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, "|").alias("words")
    )


@query
def reserve_size(spark, sf):
    return a.capacity(spark, sf).select("backupset", sizes.reserve_size("free_bytes", "total_bytes").alias("reserve"))


# Streams


def _event_files(spark, sf, folder: str, condition=None) -> None:
    events = a.table(spark, sf, "events")
    if condition is not None:
        events = events.where(condition)
    events.repartitionByRange(4, "event_id").write.mode("append").parquet(folder)


def _event_stream(spark, sf, folder: str) -> DataFrame:
    schema = a.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def stream_dump_counts(spark, sf):
    root = scratch_dir(spark, "stream")
    _event_files(spark, sf, f"{root}/in")
    stream_dump(_event_stream(spark, sf, f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("id_sum"), F.max("ts").alias("newest")
    )


@query
def stream_apply_query(spark, sf):
    root = scratch_dir(spark, "stream")
    _event_files(spark, sf, f"{root}/in")
    log = a.change_columns(_event_stream(spark, sf, f"{root}/in"))
    stream_apply(log, "key", "seq", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return streamed_state(spark, f"{root}/out", a.base_state(spark, sf), "key", "seq")


@query
def stream_apply_compacted(spark, sf):
    """Folded after the first half, while the stream goes on afterwards."""
    root = scratch_dir(spark, "stream")
    early = F.col("ts") <= F.lit(POSITION_CUT).cast("timestamp_ntz")
    for part in (early, ~early):
        _event_files(spark, sf, f"{root}/in", part)
        log = a.change_columns(_event_stream(spark, sf, f"{root}/in"))
        stream_apply(log, "key", "seq", f"{root}/out", f"{root}/checkpoint").awaitTermination()
        compact(spark, f"{root}/out", "key", "seq")
    return streamed_state(spark, f"{root}/out", a.base_state(spark, sf), "key", "seq")


@query
def stream_resume(spark, sf):
    root = scratch_dir(spark, "stream")
    early = F.col("ts") <= F.lit(POSITION_CUT).cast("timestamp_ntz")
    for part in (early, ~early):
        _event_files(spark, sf, f"{root}/in", part)
        stream_dump(_event_stream(spark, sf, f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def restore_streamed(spark, sf):
    """Restored between two batches, after folding and at the end."""
    root = scratch_dir(spark, "stream")
    early = F.col("ts") <= F.lit(POSITION_CUT).cast("timestamp_ntz")
    for part in (early, ~early):
        _event_files(spark, sf, f"{root}/in", part)
        stream_dump_table(_event_stream(spark, sf, f"{root}/in"), f"{root}/out", "shop.events", f"{root}/checkpoint").awaitTermination()
        fold_dump(spark, f"{root}/out", "shop.events")
    return dumps.restore(spark, f"{root}/out", "events", "shop")


@query
def resume_from_position(spark, sf):
    """The checkpoint is lost between two halves; the dump goes on from what it holds."""
    root = scratch_dir(spark, "stream")
    half = a.table(spark, sf, "events").agg(F.expr("max(event_id) div 2").alias("half")).first()["half"]
    early = F.col("event_id") <= half
    for number, part in enumerate((early, ~early)):
        _event_files(spark, sf, f"{root}/in", part)
        source = spark.read.schema(a.table(spark, sf, "events").schema).parquet(f"{root}/in")
        stream = _event_stream(spark, sf, f"{root}/in")
        stream_dump_table(
            stream, f"{root}/out", "shop.events", f"{root}/checkpoint{number}", position=Position(source, "event_id", "ts")
        ).awaitTermination()
    return dumps.restore(spark, f"{root}/out", "events", "shop")


# Packs


@query
def pack_totals(spark, sf):
    root = scratch_dir(spark, "pack")
    packing.pack(a.files(spark, sf), "archive", root)
    return packing.packed(spark, root).groupBy("archive").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("length").alias("bytes"),
        F.sum(F.octet_length("content")).alias("content_bytes"),
    )


@query
def pack_list(spark, sf):
    root = scratch_dir(spark, "pack")
    packing.pack(a.files(spark, sf), "archive", root)
    return packing.pack_list(spark, root)


@query
def pack_extract(spark, sf):
    root = scratch_dir(spark, "pack")
    packing.pack(a.files(spark, sf), "archive", root)
    found = packing.pack_extract(spark, root, ["en/doc 1*", "*[05].txt"], archives=["src[0-2]", "src5"])
    return found.select("archive", "member", F.decode("content", "UTF-8").alias("text"))


@query
def pack_extract_indexed(spark, sf):
    root = scratch_dir(spark, "pack")
    packing.pack_indexed(a.files(spark, sf), "archive", root, shard_bytes=1 << 18, part_bytes=4096)
    parts = packing.pack_parts(spark, root, ["en/doc 1*", "*[05].txt"], archives=["src[0-2]", "src5"])
    count = parts.groupBy("entry").agg(F.count(F.lit(1)).alias("parts"))
    found = packing.whole_members(parts).join(count, "entry")
    return found.select("archive", "member", "parts", F.decode("content", "UTF-8").alias("text"))


@query
def pack_index(spark, sf):
    root = scratch_dir(spark, "pack")
    packing.pack_indexed(a.files(spark, sf), "archive", root, shard_bytes=1 << 18, part_bytes=4096)
    return packing.pack_index(spark, root).select("archive", "member", "part", "parts", "length")


@query
def pack_files(spark, sf):
    """Files of a tree, hidden and empty ones too, read in parts, packed and put together again."""
    root = scratch_dir(spark, "pack")
    a.file_tree(spark, sf, f"{root}/in")
    inventory = packing.read_files(spark, f"{root}/in", part_bytes=4096)
    packing.pack_indexed(inventory, F.substring_index("member", "/", 1), f"{root}/out", shard_bytes=1 << 18)
    found = packing.whole_members(packing.pack_parts(spark, f"{root}/out", ["*"]))
    return found.select("archive", "member", "length", F.decode("content", "UTF-8").alias("text"))


@query
def unpack_files(spark, sf):
    """A pack's parts written as files, and what lies there then."""
    root = scratch_dir(spark, "pack")
    packing.pack_indexed(a.files(spark, sf), "archive", f"{root}/pack", shard_bytes=1 << 18, part_bytes=4096)
    packing.unpack(packing.pack_parts(spark, f"{root}/pack", ["*"]), f"{root}/out")
    found = packing.read_files(spark, f"{root}/out")
    return found.select("member", "length", F.decode("content", "UTF-8").alias("text"))


@query
def pack_add_string(spark, sf):
    root = scratch_dir(spark, "pack")
    documents = a.table(spark, sf, "documents")
    notes = documents.groupBy(F.col("source").alias("archive")).agg(
        F.lit("NOTE.txt").alias("member"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" files é")).alias("text")
    )
    packing.pack(a.files(spark, sf), "archive", root, extra=notes)
    return packing.pack_list(spark, root)
