import pytest
from pyspark.sql import functions as F

from tablekeep.functions import values
from tablekeep.operators.settings import Setting, for_scopes, merge_settings, validate_settings

SCHEMA = "scope string, section string, key string, value string"
SPEC = [
    Setting("run", "plugin"),
    Setting("run", "keep", "integer", "1", minimum=0, maximum=9),
    Setting("run", "policy", "option", "manual", options=("manual", "auto")),
    Setting("run", "on", "boolean", "yes"),
    Setting("run", "factor", "float", "1.0", minimum=1),
    Setting("run", "mode", "octal", "0755"),
    Setting("run", "names", "force_list", ""),
    Setting("other", "level-name", "logging_level", "info"),
]


def status(spark, *rows):
    got = validate_settings(spark.createDataFrame(list(rows), SCHEMA), SPEC).collect()
    return {(r["section"], r["key"]): (r["value"], r["status"]) for r in got}


@pytest.mark.parametrize(
    ("key", "value", "expected"),
    [
        ("keep", "0", "ok"), ("keep", "9", "ok"), ("keep", "10", "out_of_range"), ("keep", "-1", "out_of_range"),
        ("keep", "x", "bad_type"), ("keep", "1.5", "bad_type"), ("policy", "auto", "ok"), ("policy", "AUTO", "bad_option"),
        ("on", "OFF", "ok"), ("on", "maybe", "bad_type"), ("factor", "1", "ok"), ("factor", "0.9", "out_of_range"),
        ("factor", "y", "bad_type"), ("mode", "0644", "ok"), ("mode", "9", "bad_type"), ("names", "a,b", "ok"),
        ("colour", "red", "unknown"),
    ],
)
def test_status(spark, key, value, expected):
    assert status(spark, ("s", "run", key, value))["run", key] == (value, expected)


def test_absent_settings_are_filled(spark):
    got = status(spark, ("s", "run", "keep", "2"), ("s", "other", "level_name", "debug"))
    assert got["run", "plugin"] == (None, "missing")
    assert got["run", "factor"] == ("1.0", "default")
    assert got["other", "level-name"] == ("debug", "ok")
    assert len(got) == len(SPEC)


def test_the_same_key_elsewhere_is_unknown(spark):
    assert status(spark, ("s", "other", "keep", "2"))["other", "keep"] == ("2", "unknown")


def test_unknown_type(spark):
    with pytest.raises(ValueError):
        validate_settings(spark.createDataFrame([("s", "a", "b", "c")], SCHEMA), [Setting("a", "b", "colour")])


def test_layers(spark):
    provider = spark.createDataFrame([("s", "run", "a_b", "1"), ("s", "run", "c", "2")], SCHEMA)
    override = spark.createDataFrame([("s", "run", "a-b", "9"), ("s", "run", "d", "3"), ("t", "run", "c", "4")], SCHEMA)
    got = {tuple(r) for r in merge_settings(provider, override).collect()}
    assert got == {("s", "run", "a-b", "9"), ("s", "run", "c", "2"), ("s", "run", "d", "3"), ("t", "run", "c", "4")}


def test_defaults_per_scope(spark):
    scopes = spark.createDataFrame([("s",), ("t",)], "scope string")
    assert for_scopes(scopes, SPEC).count() == 2 * len(SPEC)


def test_one_value_per_key_and_layer(spark):
    schema = "scope string, section string, key string, value string"
    low = spark.createDataFrame([("s", "run", "a_b", "9"), ("s", "run", "a-b", "1"), ("s", "run", "c_d_e", "2"), ("s", "run", "c_d-e", "3")], schema)
    merged = merge_settings(low, low.limit(0)).collect()
    assert {(r["key"], r["value"]) for r in merged} == {("a-b", "1"), ("c-d-e", "3")}


def test_levels_and_command_lines(one):
    line = r""" -a 'b c' d\ e "f'g"h """
    assert one(values.to_args(F.lit(line))) == ["-a", "b c", "d e", "f'gh"]
    assert one(values.to_args(F.lit(""))) == []
    for text in ("'open", '"open', "end\\"):
        assert one(values.to_args(F.lit(text))) is None
