import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablekeep.operators import history, retention

SCHEMA = (
    "backupset string, name string, run_id long, failed boolean, estimated_size long, on_disk_size long, "
    "estimated_size_factor double, plugin string, start_time timestamp_ntz, stop_time timestamp_ntz"
)
START = datetime(2024, 1, 1)
ORDER = ("name", "run_id")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        backupset = "hot" if rng.random() < 0.5 else f"s{rng.randrange(12)}"
        at = START + timedelta(seconds=rng.randrange(900_000))
        failed = rng.random() < 0.2
        rows.append(
            (backupset, at.strftime("%Y%m%d_%H%M%S"), i, failed, rng.randrange(0, 200), 0 if failed else rng.randrange(0, 150),
             rng.choice([0.0, 1.0, 1.0]), rng.choice(["", "sql"]), at, at + timedelta(seconds=61))
        )
    return rows


@pytest.fixture(scope="module")
def runs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def grouped(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def purged(plan):
    return {r["run_id"] for r in plan.where("action = 'purge'").collect()}


@pytest.mark.parametrize("keep", [0, 1, 3, 40, 10_000])
def test_retention_keeps_the_newest(runs, data, keep):
    expected = {row[2] for rows in grouped(data).values() for row in rows[: max(0, len(rows) - keep)]}
    assert purged(retention.retention_plan(runs, keep, ORDER)) == expected
    assert purged(retention.retention_plan(runs.withColumn("k", F.lit(keep)), "k", ORDER)) == expected
    assert retention.retention_plan(runs, keep, ORDER).count() == len(data)
    newest = {r["run_id"] for r in retention.newest_n(runs, keep, ORDER).collect()}
    assert newest == {row[2] for row in data} - expected


def test_runs_are_not_shuffled_for_retention(runs, spark, folder):
    runs.write.parquet(f"{folder}/r")
    plan = retention.retention_plan(spark.read.parquet(f"{folder}/r"), 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("BroadcastHashJoin") < text.index("Exchange")


def test_negative_keep_is_an_error(runs):
    for call in (retention.retention_plan, retention.newest_n):
        with pytest.raises(ValueError):
            call(runs, -1)
    with pytest.raises(PySparkException):
        retention.retention_plan(runs.withColumn("k", F.lit(-1)), "k").collect()


@pytest.mark.parametrize(
    ("n", "policy", "event", "expected"),
    [
        (2, "before-backup", "before-backup", 3), (0, "before-backup", "before-backup", 1),
        (2, "after-backup", "after-backup", 2), (0, "after-backup", "after-backup", 1),
        (2, "manual", "after-backup", None), (2, "after-backup", "before-backup", None), (5, "manual", "all", 0),
    ],
)
def test_policies(one, n, policy, event, expected):
    assert one(retention.effective_keep(F.lit(n), F.lit(policy), event)) == expected


def test_a_policy_that_does_not_apply_purges_nothing(runs):
    assert purged(retention.retention_plan(runs.withColumn("k", F.lit(None).cast("int")), "k")) == set()


def test_purge_on_demand(spark, runs, data):
    rng = random.Random(5)
    capacity, expected = [], set()
    for name, rows in grouped(data).items():
        total = sum(r[5] for r in rows)
        required = rng.choice([total // 3, total + 50, total + 51, 10, 0])
        free = rng.choice([0, 10, 50])
        capacity.append((name, free, required))
        if free > required:
            continue
        chosen, available = set(), free
        for row in rows:
            available += row[5]
            chosen.add(row[2])
            if available > required:
                expected |= chosen
                break
    frame = spark.createDataFrame(capacity, "backupset string, free_bytes long, required_bytes long")
    plan = retention.purge_on_demand(runs, frame, ORDER)
    assert purged(plan) == expected
    assert plan.count() == len(data)


@pytest.mark.parametrize(("free", "required", "purges"), [(10, 19, 1), (10, 20, 2), (10, 30, 0), (10, 29, 2), (11, 10, 0), (10, 10, 1)])
def test_purge_on_demand_borders(spark, free, required, purges):
    runs = spark.createDataFrame([("s", f"2024010{i}_000000", i, 10) for i in (1, 2)], "backupset string, name string, run_id long, on_disk_size long")
    capacity = spark.createDataFrame([("s", free, required)], "backupset string, free_bytes long, required_bytes long")
    assert len(purged(retention.purge_on_demand(runs, capacity))) == purges


@pytest.mark.parametrize("slice_bytes", [4_000, 1 << 28])
def test_historic_estimate(runs, data, slice_bytes):
    expected = {}
    for rows in grouped(data).values():
        prior = None
        for row in rows:
            estimate = float(row[4])
            if prior and prior[6] and prior[5] and not estimate > prior[4] * 1.5:
                expected[row[2]] = (prior[5] * 1.1, "history")
            else:
                expected[row[2]] = (estimate * 1.3, "estimate")
            if not row[3]:
                prior = row
    got = history.historic_estimate(runs, size_factor=1.3, order=ORDER, slice_bytes=slice_bytes).collect()
    assert {r["run_id"]: (r["required_bytes"], r["basis"]) for r in got} == expected
    per_set = history.historic_estimate(runs, historic_size=F.col("backupset") != "hot", size_factor=F.lit(1.3), order=ORDER)
    for r in per_set.collect():
        plain = (r["estimated_size"] * 1.3, "estimate")
        assert (r["required_bytes"], r["basis"]) == (plain if r["backupset"] == "hot" else expected[r["run_id"]])
    switched_off = history.historic_estimate(runs, historic_size=False)
    assert switched_off.where("basis <> 'estimate'").count() == 0


def test_survivors(runs, data):
    plan = retention.retention_plan(runs, 2, ORDER)
    kept = {row[2] for rows in grouped(data).values() for row in rows[-2:]}
    failed = {row[2] for row in data if row[3]}
    assert {r["run_id"] for r in retention.survivors(runs, plan, False, ORDER).collect()} == kept
    assert {r["run_id"] for r in retention.survivors(runs, plan, order=ORDER).collect()} == kept - failed


def test_space_check_refuses_equality(spark):
    required = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0)], "backupset string, required_bytes double")
    capacity = spark.createDataFrame([("a", 10), ("b", 11)], "backupset string, free_bytes long")
    got = {r["backupset"]: r["status"] for r in history.space_check(required, capacity).collect()}
    assert got == {"a": "insufficient", "b": "ok", "c": "unknown"}


def test_low_space_border(spark):
    capacity = spark.createDataFrame([("a", 100, 10), ("b", 100, 9)], "backupset string, total_bytes long, free_bytes long")
    assert [r["backupset"] for r in history.low_space(capacity).collect()] == ["b"]


def test_listing_is_sorted(runs, data):
    order = [(r["backupset"], r["name"], r["run_id"]) for r in history.list_runs(runs, order=ORDER).collect()]
    assert order == sorted((r[0], r[1], r[2]) for r in data)
    backwards = [(r["backupset"], r["name"], r["run_id"]) for r in history.list_runs(runs, reverse=True, order=ORDER).collect()]
    assert backwards == order[::-1]


@pytest.mark.parametrize("name", ["hot", "hot/a/b", "", "hot/20000101_000000"])
def test_find_run_without_result(runs, name):
    assert history.find_run(runs, name).count() == 0


def test_find_run(runs, data):
    row = data[0]
    assert row[2] in {r["run_id"] for r in history.find_run(runs, f"{row[0]}/{row[1]}").collect()}


def test_empty_history(spark, runs):
    empty = runs.where("false")
    assert retention.purge_summary(retention.retention_plan(empty, 1)).count() == 0
    assert history.historic_estimate(empty).count() == 0
    assert history.run_report(empty).count() == 0


def test_report(runs, data):
    got = {r["backupset"]: r for r in history.run_report(runs).collect()}
    for name, rows in grouped(data).items():
        assert (got[name]["runs"], got[name]["failures"], got[name]["seconds"]) == (len(rows), sum(r[3] for r in rows), 61 * len(rows))


def test_runs_go_by_age(runs):
    for call in (lambda o: retention.retention_plan(runs, 1, o), lambda o: retention.newest_n(runs, 1, o)):
        with pytest.raises(ValueError, match="name"):
            call(["run_id"])
    single = runs.dropDuplicates(["backupset", "name"])
    assert retention.newest_n(single.drop("run_id"), 1).count() == single.select("backupset").distinct().count()
