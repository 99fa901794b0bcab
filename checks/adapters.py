"""The relations the operators work on, derived from the test tables.

``checks/oracles.py`` defines the same relations in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.functions.times import run_name
from tablekeep.operators.filters import FilterSpec, apply_filters
from tablekeep.operators.settings import Setting
from tablekeep.plans.settled import settle
from tablekeep.sources import stores
from tablekeep.sources.catalog import catalog_databases, catalog_tables

MIB = 1024**2

SPEC = FilterSpec(
    exclude_databases=["brand#2?"],
    exclude_tables=["small*", "Brand#1.red*"],
    exclude_engines=["memory"],
)

SETTINGS = [
    Setting("run", "plugin"),
    Setting("run", "backups-to-keep", "integer", "1", minimum=0),
    Setting(
        "run",
        "purge-policy",
        "option",
        "after-backup",
        options=("manual", "before-backup", "after-backup"),
    ),
    Setting("run", "historic-size", "boolean", "yes"),
    Setting("run", "estimated-size-factor", "float", "1.0", minimum=1),
    Setting("run", "log-level", "logging_level", "info"),
    Setting("run", "umask", "octal", "022", maximum=0o37),
    Setting("run", "databases", "list", "*", maximum=2),
    Setting("run", "options", "cmd_args", ""),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    extra = spark.createDataFrame(
        [
            ("information_schema", False, True),
            ("performance_schema", False, True),
            ("lost+found", False, True),
            ("template1", True, True),
            ("closed", False, False),
        ],
        "name string, is_template boolean, allow_conn boolean",
    )
    return brands.select("name", F.lit(False).alias("is_template"), F.lit(True).alias("allow_conn")).unionByName(extra)


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_size = F.col("p_size") % 8
    engine = (
        F.when(by_size == 1, "MyISAM")
        .when(by_size == 2, "MRG_MyISAM")
        .when(by_size == 3, "FEDERATED")
        .when(by_size == 4, "MEMORY")
        .when(by_size > 4, "InnoDB")
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("database"),
        F.concat_ws("_", F.translate("p_name", " ", "_"), "p_partkey").alias("name"),
        F.when(by_size != 0, F.floor(F.col("p_retailprice") * 1024)).alias("data_length"),
        F.when(F.col("p_size") % 5 != 0, (F.col("p_size") * 4096).cast("bigint")).alias("index_length"),
        engine.alias("engine"),
    )


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_databases(raw_databases(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_tables(raw_tables(spark, sf_dir))


def filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return apply_filters(databases(spark, sf_dir), tables(spark, sf_dir), SPEC)


def backup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = F.floor(F.col("value") * MIB)
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("set"), F.col("user_id").cast("string")).alias("backupset"),
        run_name("ts").alias("name"),
        F.col("event_id").alias("run_id"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("plugin"),
        F.col("ts").alias("start_time"),
        F.expr("ts + make_dt_interval(0, 0, 0, event_id % 7200)").alias("stop_time"),
        failed.alias("failed"),
        F.floor(disk.cast("double") * (F.col("event_id") % 100 + 50) / 100.0).alias("estimated_size"),
        F.when(failed, F.lit(0)).otherwise(disk).cast("bigint").alias("on_disk_size"),
        F.when(F.col("event_id") % 37 == 0, 0.0).otherwise(1.0).alias("estimated_size_factor"),
    )


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_set = (
        backup_runs(spark, sf_dir)
        .groupBy("backupset")
        .agg(
            (F.sum("on_disk_size") + 512 * MIB).alias("total_bytes"),
            F.max("estimated_size").alias("required_bytes"),
        )
    )
    user = F.substring("backupset", 4, 20).cast("bigint")
    free = F.floor((user % 20) * F.col("total_bytes") / 100.0)
    return per_set.select("backupset", "total_bytes", free.alias("free_bytes"), "required_bytes")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_columns(table(spark, sf_dir, "events"))


def change_columns(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    return events.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("key"), op.alias("op"), "value"
    )


def base_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Views, what they refer to, and the objects that exist."""
    deps = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("v_"), F.col("l_orderkey").cast("string")).alias("view"), F.col("l_partkey").alias("object")
    )
    objects = table(spark, sf_dir, "part").where(F.col("p_size") % 8 != 3).select(F.col("p_partkey").alias("object"))
    return deps.select("view").distinct(), deps, objects


def nested_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``views``, where most views read the one before theirs in a chain and some chains are circles."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"))
    view = lambda number: F.concat(F.lit("v_"), number.cast("string"))
    parts = lines.where("n % 3 = 1").select(view(F.col("o")).alias("view"), F.concat(F.lit("p_"), F.col("p").cast("string")).alias("object"))
    orders = settle(lines.select("o").distinct(), "orders")
    before = orders.where("o % 12 <> 0").select(view(F.col("o")).alias("view"), view(F.col("o") - 1).alias("object"))
    around = orders.where("o % 36 = 0").select(view(F.col("o")).alias("view"), view(F.col("o") + 5).alias("object"))
    objects = table(spark, sf_dir, "part").where("p_size % 8 <> 3").select(F.concat(F.lit("p_"), F.col("p_partkey").cast("string")).alias("object"))
    return orders.select(view(F.col("o")).alias("view")), parts.unionByName(before).unionByName(around), objects


def set_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type, read as a setting."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    newest = (
        table(spark, sf_dir, "events")
        .select("user_id", "event_type", "event_id", k.alias("k"))
        .groupBy("user_id", "event_type")
        .agg(F.max_by("k", "event_id").alias("k"))
    )
    kind, k = F.col("event_type"), F.col("k")
    key = (
        F.when(kind == "click", "backups_to_keep")
        .when(kind == "purchase", "purge-policy")
        .when(kind == "view", "historic_size")
        .when(kind == "signup", "estimated-size-factor")
        .otherwise("colour")
    )
    policy = (
        F.when(k % 4 == 0, "manual")
        .when(k % 4 == 1, "before-backup")
        .when(k % 4 == 2, "after-backup")
        .otherwise("sometimes")
    )
    value = (
        F.when(kind == "click", (k - 10).cast("string"))
        .when(kind == "purchase", policy)
        .when((kind == "view") & (k % 3 == 0), "Yes")
        .otherwise(k.cast("string"))
    )
    typed_key = (
        F.when(kind == "click", "log-level")
        .when(kind == "purchase", "umask")
        .when(kind == "view", "databases")
        .when(kind == "signup", "options")
        .otherwise("log_level")
    )
    typed_value = (
        F.when(kind == "click", _pick(k, "Info", "critical", "banana"))
        .when(kind == "purchase", k.cast("string"))
        .when(kind == "view", _pick(k, "a", "a, b", "a,b,c"))
        .when(kind == "signup", _pick(k, '--x "a b"', "--x 'a"))
        .otherwise("debug")
    )
    both = F.array(F.struct(key.alias("key"), value.alias("value")), F.struct(typed_key.alias("key"), typed_value.alias("value")))
    return newest.select(
        F.concat(F.lit("set"), F.col("user_id").cast("string")).alias("scope"), F.lit("run").alias("section"), F.inline(both)
    )


def _pick(k, *texts: str):
    return F.get(F.array(*(F.lit(t) for t in texts)), (k % len(texts)).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("archive"),
        F.concat("lang", F.lit("/doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )


def file_tree(spark: SparkSession, sf_dir: str, root: str) -> int:
    """Writes each document as a file of its own, some hidden, some in hidden folders, some empty."""
    folder = F.get(F.array(*(F.lit(f) for f in ("", ".state/", "_parts/", "deep/er/", "a b+%41/"))), (F.col("doc_id") % 5).cast("int"))
    begin = F.get(F.array(*(F.lit(b) for b in ("", ".", "_"))), (F.col("doc_id") % 3).cast("int"))
    member = F.concat("source", F.lit("/"), folder, begin, F.col("doc_id").cast("string"))
    content = F.encode(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")), "UTF-8")
    return stores.write_files(table(spark, sf_dir, "documents").select(member.alias("member"), content.alias("content")), root)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("s"))
    return texts.unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("s")))


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*(F.lit(u) for u in ("", "K", "m", "G", "B", "x"))), (F.col("event_id") % 6).cast("int"))
    whole = F.regexp_extract("props", r"(\d+)", 1)
    fraction = F.when(F.col("event_id") % 5 == 0, ".5").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", F.concat(whole, fraction, unit).alias("s"))
