import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablekeep.operators import filters, sizing
from tablekeep.operators.filters import FilterSpec
from tablekeep.sources import catalog

TABLES = [
    ("shop", "orders", 100, 10, "InnoDB"),
    ("shop", "log", 50, None, "MyISAM"),
    ("shop", "all_logs", 50, 5, "MRG_MyISAM"),
    ("shop", "remote", 70, 5, "FEDERATED"),
    ("shop", "v", None, None, None),
    ("hr", "people", 7, 1, "InnoDB"),
    ("gone", "t", 1000, 1, "InnoDB"),
]


@pytest.fixture(scope="module")
def tbls(spark):
    return catalog.catalog_tables(
        spark.createDataFrame(TABLES, "database string, name string, data_length long, index_length long, engine string")
    )


@pytest.fixture(scope="module")
def dbs(spark):
    names = ["shop", "hr", "empty", "information_schema", "Information_Schema", "lost+found", "performance_schema"]
    return catalog.catalog_databases(spark.createDataFrame([(n,) for n in names], "name string"))


def test_databases(dbs, spark):
    assert {r[0] for r in dbs.collect()} == {"shop", "hr", "empty", "Information_Schema"}
    with pytest.raises(ValueError):
        catalog.catalog_databases(dbs, kind="other")


def test_tables(tbls):
    got = {r["name"]: (r["data_size"], r["index_size"], r["engine"]) for r in tbls.collect()}
    assert got["v"] == (0, 0, "view")
    assert got["log"] == (50, 0, "myisam")


def test_cheap_listing_reads_no_sizes(spark, folder):
    spark.createDataFrame(TABLES, "database string, name string, data_length long, index_length long, engine string").write.parquet(f"{folder}/t")
    listing = catalog.catalog_tables(spark.read.parquet(f"{folder}/t"), sizes=False)
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "data_length" not in plan and "index_length" not in plan
    assert listing.agg(F.sum(F.col("data_size") + F.col("index_size"))).first()[0] == 0


def test_filters_and_sizes(dbs, tbls):
    spec = FilterSpec(exclude_databases=["hr"], exclude_tables=["shop.lo*"])
    fdbs, ftbls = filters.apply_filters(dbs, tbls, spec)
    assert {r["name"] for r in fdbs.where("excluded").collect()} == {"hr"}
    assert {r["name"] for r in ftbls.collect()} == {"orders", "log", "all_logs", "remote", "v"}
    assert {r["name"] for r in filters.excluded(ftbls).collect()} == {"log"}
    assert [r["line"] for r in filters.ignore_lines(ftbls).collect()] == ["ignore-table = shop.log"]
    sizes = {r["database"]: r["size"] for r in sizing.database_sizes(fdbs, ftbls).collect()}
    assert sizes == {"shop": 110, "hr": 0, "empty": 0, "Information_Schema": 0}
    assert sizing.estimate(fdbs, ftbls).first()[0] == 110
    assert sizing.estimate(fdbs, ftbls, "const:1K").first()[0] == 1024


def test_bad_estimates(dbs, tbls):
    fdbs, ftbls = filters.apply_filters(dbs, tbls, FilterSpec())
    with pytest.raises(ValueError):
        sizing.estimate(fdbs, ftbls, "guess")
    with pytest.raises(PySparkException):
        sizing.estimate(fdbs, ftbls, "const:lots").collect()


def test_engine_or_table_filters_exclude(dbs, tbls):
    spec = FilterSpec(tables=["*o*"], exclude_engines=["myisam"])
    _, ftbls = filters.apply_filters(dbs, tbls, spec)
    assert {r["name"] for r in filters.dump_set(ftbls).collect()} == {"orders", "all_logs", "remote", "people"}


def test_empty_options_add_no_filter(dbs, tbls):
    fdbs, ftbls = filters.apply_filters(dbs, tbls, FilterSpec())
    assert fdbs.where("excluded").count() == 0 and ftbls.where("excluded").count() == 0
    assert filters.filter_engines(tbls, []).count() == 0


def test_lock_modes(dbs, tbls):
    fdbs, ftbls = filters.apply_filters(dbs, tbls, FilterSpec(exclude_databases=["empty"]))
    got = {r["database"]: r["lock_option"] for r in sizing.lock_mode(fdbs, ftbls).collect()}
    assert got == {"shop": "--lock-tables", "hr": "--single-transaction", "Information_Schema": "--single-transaction"}
    fixed = {r["lock_option"] for r in sizing.lock_mode(fdbs, ftbls, "none").collect()}
    assert fixed == {"--skip-lock-tables"}
    with pytest.raises(ValueError):
        sizing.lock_mode(fdbs, ftbls, "hope")
    assert sizing.lock_mode_all(ftbls, unrestricted=True).first()[0] == "--lock-all-tables"
    assert sizing.lock_mode_all(ftbls, unrestricted=False).first()[0] == "--lock-tables"
    assert sizing.lock_mode_all(ftbls.where("database = 'hr'"), unrestricted=False).first()[0] == "--single-transaction"


def test_finder(tbls):
    assert filters.find_tables(tbls).count() == len(TABLES)
    assert {r["name"] for r in filters.find_tables(tbls, dbinc=["SHOP"], tinc=["Orders", "shop.v"]).collect()} == {"orders", "v"}
    assert {r["name"] for r in filters.find_tables(tbls, dbinc=["shop"], texc=["*log*"], excluded=True).collect()} == {"log", "all_logs"}


def test_sources_that_cannot_be_checked_are_bad(spark, folder):
    sources = spark.createDataFrame([("a", 1), ("b", None), ("c", -1)], "name string, n int")
    good, bad = filters.partition_sources(sources, F.col("n") > 0)
    assert [r["name"] for r in good.collect()] == ["a"]
    assert {r["name"] for r in bad.collect()} == {"b", "c"}
    filters.refuse_sources(good.where("false"))
    with pytest.raises(ValueError, match="2 invalid sources"):
        filters.refuse_sources(bad, path=f"{folder}/bad")
    assert {r["name"] for r in spark.read.json(f"{folder}/bad").collect()} == {"b", "c"}


def test_object_kinds_without_rules_are_kept(spark):
    objects = spark.createDataFrame([("event", "d", "x"), ("user", "d", "x"), ("event", "d", "y")], "kind string, database string, name string")
    got = filters.filter_objects(objects, {"event": (["x"], [])})
    assert {(r["kind"], r["name"]) for r in got.collect()} == {("event", "x"), ("user", "x")}
