"""Choosing databases, tables and other objects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.functions.globs import (
    exclude_glob,
    exclude_glob_qualified,
    include_glob,
    include_glob_qualified,
    qualify,
)
from tablekeep.plans.settled import settle
from tablekeep.session import scratch_dir

# Databases the pattern finder always leaves out.
ALWAYS_EXCLUDED = ["information_schema", "lost+found"]


@dataclass(frozen=True)
class FilterSpec:
    """Include and exclude globs. An option left empty adds no filter."""

    databases: Sequence[str] = ()
    exclude_databases: Sequence[str] = ()
    tables: Sequence[str] = ()
    exclude_tables: Sequence[str] = ()
    engines: Sequence[str] = ()
    exclude_engines: Sequence[str] = ()

    def keeps_database(self, name: str) -> Column:
        return _keeps(
            (include_glob(name, *self.databases), self.databases),
            (exclude_glob(name, *self.exclude_databases), self.exclude_databases),
        )

    def keeps_table(self, database: str = "database", name: str = "name", engine: str = "engine") -> Column:
        return _keeps(
            (include_glob_qualified(database, name, *self.tables), self.tables),
            (exclude_glob_qualified(database, name, *self.exclude_tables), self.exclude_tables),
            (include_glob(engine, *self.engines), self.engines),
            (exclude_glob(engine, *self.exclude_engines), self.exclude_engines),
        )


def _keeps(*conditions: tuple[Column, Sequence[str]]) -> Column:
    kept = F.lit(True)
    for condition, patterns in conditions:
        if patterns:
            kept = kept & condition
    return kept


def filter_engines(df: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Keep tables by engine; here an empty include list keeps nothing."""
    return df.where(include_glob("engine", *include) & exclude_glob("engine", *exclude))


def apply_filters(dbs: DataFrame, tbls: DataFrame, spec: FilterSpec) -> tuple[DataFrame, DataFrame]:
    """Flag databases and tables with ``excluded``.

    Tables of an excluded or unknown database are not listed at all. The database patterns
    are put on the tables too, so they reach the table scan before the semi join. The list
    of databases is read once and settled.
    """
    flagged = settle(dbs.withColumn("excluded", ~spec.keeps_database("name")), "databases")
    kept = flagged.where(~F.col("excluded")).select(F.col("name").alias("database"))
    tables = (
        tbls.where(spec.keeps_database("database"))
        .join(kept, "database", "left_semi")
        .withColumn("excluded", ~spec.keeps_table())
    )
    return flagged, tables


def excluded(flagged: DataFrame) -> DataFrame:
    return flagged.where("excluded")


def dump_set(flagged: DataFrame) -> DataFrame:
    """What is left to dump."""
    return flagged.where(~F.col("excluded")).drop("excluded")


def ignore_lines(tbls: DataFrame) -> DataFrame:
    """One ``ignore-table = database.table`` line per excluded table."""
    return excluded(tbls).select(
        F.concat(F.lit("ignore-table = "), F.col("database"), F.lit("."), F.col("name")).alias("line")
    )


def find_tables(
    tbls: DataFrame,
    dbinc: Sequence[str] = (),
    dbexc: Sequence[str] = (),
    tinc: Sequence[str] = (),
    texc: Sequence[str] = (),
    excluded: bool = False,
) -> DataFrame:
    """Tables by pattern; an empty include list means everything.

    ``excluded=True`` gives the tables of the chosen databases that the table patterns drop.
    """
    in_database = include_glob("database", *(dbinc or ["*"])) & exclude_glob(
        "database", *dbexc, *ALWAYS_EXCLUDED
    )
    full_name = F.concat_ws(".", "database", "name")
    wanted = include_glob(full_name, *qualify(*(tinc or ["*"]))) & exclude_glob(full_name, *qualify(*texc))
    return tbls.where(in_database & (~wanted if excluded else wanted))


def find_databases(dbs: DataFrame, dbinc: Sequence[str] = (), dbexc: Sequence[str] = ()) -> DataFrame:
    return dbs.where(
        include_glob("name", *(dbinc or ["*"])) & exclude_glob("name", *dbexc, *ALWAYS_EXCLUDED)
    )


def filter_objects(
    objects: DataFrame, rules: Mapping[str, tuple[Sequence[str], Sequence[str]]]
) -> DataFrame:
    """Keep routines, events, triggers and users by globs on ``database.name``.

    ``rules`` maps a kind to its include and exclude patterns, empty ones adding no filter.
    Kinds without a rule are kept.
    """
    kept = F.lit(True)
    for kind, (include, exclude) in rules.items():
        full_name = F.concat_ws(".", "database", "name")
        allowed = _keeps(
            (include_glob(full_name, *qualify(*include)), include),
            (exclude_glob(full_name, *qualify(*exclude)), exclude),
        )
        kept = F.when(F.col("kind") == kind, allowed).otherwise(kept)
    return objects.where(kept)


def partition_sources(sources: DataFrame, is_valid: Column) -> tuple[DataFrame, DataFrame]:
    """Good and bad sources. A check that gives NULL counts as bad."""
    ok = F.coalesce(is_valid, F.lit(False))
    return sources.where(ok), sources.where(~ok)


def refuse_sources(invalid: DataFrame, name: str = "name", path: str | None = None) -> None:
    """Fail when there are bad sources, with their number and where all of them are listed.

    The list is a JSON table at ``path``, by default in the scratch folder. To be called once the
    good ones are dumped.
    """
    path = path or scratch_dir(invalid.sparkSession, "invalid-sources")
    invalid.select(F.col(name).alias("name")).write.json(path)
    if n := invalid.sparkSession.read.schema("name string").json(path).count():
        raise ValueError(f"{n} invalid sources, listed in {path}")
