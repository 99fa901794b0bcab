"""The catalog of past runs, one ``<set>/<run name>/backup.conf`` each."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.functions.times import parse_run_name
from tablekeep.functions.values import to_boolean, to_float, to_integer
from tablekeep.plans.settled import settle
from tablekeep.sources.files import decoded_name
from tablekeep.sources.stores import delete_folders, list_files, listing, read_contents

# The keys of a run record with their type and default.
RUN_RECORD_SPEC = [
    ("plugin", "string", ""),
    ("start-time", "float", "0"),
    ("stop-time", "float", "0"),
    ("failed", "boolean", "no"),
    ("estimated-size", "float", "0"),
    ("on-disk-size", "float", "0"),
    ("estimated-size-factor", "float", "1.0"),
    ("backups-to-keep", "integer", "1"),
    ("auto-purge-failures", "boolean", "yes"),
    ("purge-policy", "string", "after-backup"),
    ("purge-on-demand", "boolean", "no"),
    ("before-backup-command", "string", None),
    ("after-backup-command", "string", None),
    ("failed-backup-command", "string", None),
    ("historic-size", "boolean", "yes"),
    ("historic-size-factor", "float", "1.5"),
    ("historic-estimated-size-factor", "float", "1.1"),
    ("create-symlinks", "boolean", "yes"),
    ("relative-symlinks", "boolean", "no"),
]


def run_name_filter(names: DataFrame, name: str = "name") -> DataFrame:
    """Keep the names that are run names and add the start time they stand for."""
    return names.withColumn("started", parse_run_name(name)).where(F.col("started").isNotNull())


def _typed(text: Column, kind: str) -> Column:
    match kind:
        case "float":
            return to_float(text)
        case "integer":
            return to_integer(text)
        case "boolean":
            return to_boolean(text)
    return text


def _section_entries(conf: Column, section: str) -> Column:
    """``[key, value]`` lists of one section of an INI text."""
    body = F.regexp_extract(conf, rf"(?s)(?:\A|\n)\[\Q{section}\E\][^\n]*\n(.*?)(?:\n\[|\z)", 1)
    lines = F.filter(F.split(body, r"\r?\n"), lambda line: line.rlike(r"\A\s*[^#=\s][^=]*="))
    return F.transform(lines, lambda line: F.split(line, "=", 2))


def _glob(name: Column, pattern: str) -> Column:
    """Whether a file is called so; case counts."""
    return name.rlike("\\A" + fnmatch.translate(pattern).removesuffix("\\Z").removesuffix("\\z") + "\\z")


def _run_of(member: str) -> tuple[Column, Column]:
    """Set and name of a run from ``set/name/...``, or from folders as ``write_run_records`` makes them."""
    steps = F.split(member, "/")
    given = steps[0].startswith("backupset=")
    backupset = F.when(given, decoded_name(F.regexp_replace(steps[0], r"\Abackupset=", ""))).otherwise(steps[0])
    return backupset.alias("backupset"), F.regexp_replace(steps[1], r"\Aname=", "").alias("name")


def scan_runs(spark: SparkSession, root: str, section: str = "run", file_name: str = "backup.conf") -> DataFrame:
    """Read every run record under ``root``; folders that are no run names are skipped.

    Tasks list the folders and read the records. ``file_name`` is a name or a glob. The known keys
    are picked out of each record, so records are not shuffled. Of a key that is written several
    times, in either spelling, the last one counts. An empty record is a broken run with default
    values. Times are seconds since the epoch and become timestamps here.
    """
    there = list_files(spark, root, levels=3)
    records = there.where((F.size(F.split("member", "/")) == 3) & _glob(F.substring_index("member", "/", -1), file_name))
    files = read_contents(records.select("path", "member", "length"))
    files = files.select(F.decode("content", "UTF-8").alias("value"), *_run_of("member"))
    entries = F.transform(
        _section_entries(F.col("value"), section),
        lambda pair: F.struct(
            F.translate(F.trim(pair[0]), "_", "-").alias("key"),
            F.regexp_replace(F.trim(pair[1]), r"""\A(["'])(.*)\1\z""", "$2").alias("text"),
        ),
    )
    parsed = files.select("backupset", "name", entries.alias("conf"))

    def given(key: str) -> Column:
        mine = F.filter("conf", lambda entry: entry["key"] == key)
        return F.try_element_at(mine, F.lit(-1))["text"]

    columns = {
        key.replace("-", "_"): _typed(F.coalesce(given(key), F.lit(default)), kind) for key, kind, default in RUN_RECORD_SPEC
    }
    for moment in ("start_time", "stop_time"):
        columns[moment] = F.timestamp_micros((columns[moment] * 1e6).cast("bigint")).cast("timestamp_ntz")
    for size in ("estimated_size", "on_disk_size"):
        columns[size] = columns[size].cast("bigint")
    return run_name_filter(parsed).select(
        "backupset", "name", *(column.alias(name) for name, column in columns.items())
    )


def _run_path(spark: SparkSession, root: str, backupset: str, name: str):
    if "/" in backupset or backupset in ("", ".", "..") or not re.fullmatch(r"\d{8}_\d{6}", name):
        raise ValueError(f"{backupset!r}/{name!r} is not the name of a run")
    return spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{backupset}/{name}")


def write_run_record(
    spark: SparkSession,
    root: str,
    backupset: str,
    name: str,
    values: Mapping[str, object],
    section: str = "run",
    file_name: str = "backup.conf",
) -> None:
    """Write the record of one run, replacing an earlier state of it."""
    known = {key for key, _, _ in RUN_RECORD_SPEC}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings in a run record: {', '.join(sorted(unknown))}")
    folder = _run_path(spark, root, backupset, name)
    lines = [f"[{section}]", *(f"{key} = {value}" for key, value in values.items())]
    stream = folder.getFileSystem(spark._jsc.hadoopConfiguration()).create(
        spark._jvm.org.apache.hadoop.fs.Path(folder, file_name), True
    )
    try:
        stream.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    finally:
        stream.close()


def write_run_records(records: DataFrame, root: str, section: str = "run") -> None:
    """Write the records of many new runs in tasks: ``backupset, name`` and any keys of a record,
    spelled with underscores, as columns. NULL values are left out.

    Folders are called ``backupset=<set>/name=<run name>`` and files ``part-*``; ``scan_runs`` reads
    them with that ``file_name``.
    """
    known = {key.replace("-", "_"): key for key, _, _ in RUN_RECORD_SPEC}
    keys = [c for c in records.columns if c not in ("backupset", "name")]
    if unknown := set(keys) - set(known):
        raise ValueError(f"unknown settings in a run record: {', '.join(sorted(unknown))}")
    lines = [F.concat(F.lit(f"{known[key]} = "), F.col(key).cast("string")) for key in keys]
    record = F.concat_ws("\n", F.lit(f"[{section}]"), *lines)
    rows = records.select("backupset", "name", record.alias("value"))
    rows.write.partitionBy("backupset", "name").text(root)


def delete_runs(spark: SparkSession, root: str, plan: DataFrame) -> int:
    """Delete the folders of the runs a plan purges and return how many there were.

    The only function that deletes; the plan itself is the dry run. Tasks list the folders of the
    sets and delete those of the plan, which is settled first: it may be drawn from the records
    that go.
    """
    purged = settle(plan.where(F.col("action") == "purge").select("backupset", "name").distinct(), "purged")
    named = F.col("name").rlike(r"\A\d{8}_\d{6}\z") & ~F.col("backupset").isin("", ".", "..") & ~F.contains("backupset", F.lit("/"))
    if bad := purged.where(~F.coalesce(named, F.lit(False))).first():
        raise ValueError(f"{bad['backupset']!r}/{bad['name']!r} is not the name of a run")
    there = listing(spark, root, levels=2).where("is_folder AND level = 2").select("member", *_run_of("member"))
    return delete_folders(settle(there.join(purged, ["backupset", "name"], "left_semi").select("member"), "folders"), root)
