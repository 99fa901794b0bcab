import math
import string
import urllib.parse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablekeep.functions import sizes, text, times, values

GIB = 1024**3


@pytest.mark.parametrize(
    ("n", "expected"),
    [
        (0, "0.00B"), (1, "1.00B"), (1023, "1023.00B"), (1024, "1.00KB"), (1152, "1.12KB"), (1664, "1.62KB"),
        (1024**2 - 1, "1024.00KB"), (1024**2, "1.00MB"), (GIB, "1.00GB"), (1024**4, "1.00TB"), (1024**5, "1.00PB"),
        (1024**6, "1.00EB"), (float(1024**7), "1.00ZB"), (float(1024**8), "1.00YB"), (float(1024**9), "1024.00YB"),
    ],
)
def test_format_bytes(one, n, expected):
    assert one(sizes.format_bytes(F.lit(n))) == expected


def test_format_bytes_like_printf(spark):
    numbers = [n * 7919 % (1 << 41) for n in range(1, 4000, 3)] + [n * 128 for n in range(1, 2000)]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", sizes.format_bytes("n")).collect()
    for n, shown in got:
        power = next(p for p in range(8, -1, -1) if n >= 1024**p)
        assert shown == f"{n / 1024**power:.2f}{sizes.BYTE_UNITS[power]}"


def test_format_bytes_edges(one):
    assert one(sizes.format_bytes(F.lit(None).cast("long"))) is None
    assert one(sizes.format_bytes(F.lit(1536), precision=0)) == "2KB"
    with pytest.raises(PySparkException):
        one(sizes.format_bytes(F.lit(-1)))


@pytest.mark.parametrize(("n", "expected"), [(1024, "1.00KB"), (0, "0.00Bytes"), (-1, "-1.00Bytes"), (-1536, "-1.50KB")])
def test_format_bytes_signed(one, n, expected):
    assert one(sizes.format_bytes_signed(F.lit(n))) == expected


@pytest.mark.parametrize(
    ("size", "bare_bytes", "bare_megabytes"),
    [
        ("1024", 1024, 1024 * 1024**2), ("1024G", 1024 * GIB, 1024 * GIB), ("1.5T", 1649267441664, 1649267441664),
        ("4k", 4096, 4096), ("0", 0, 0), ("2B", None, 2), ("7b", None, 7), ("1e3", None, None), ("", None, None),
        ("K", None, None), ("-1", None, None), ("1 K", None, None), ("1.", None, None), ("3P", 3 * 1024**5, 3 * 1024**5),
        ("1E", 1024**6, 1024**6), ("99999E", None, None),
    ],
)
def test_sizes_are_parsed(one, size, bare_bytes, bare_megabytes):
    assert one(sizes.parse_size(F.lit(size)), sizes.parse_bytes(F.lit(size))) == (bare_bytes, bare_megabytes)


def test_reserve_size(one):
    assert one(sizes.reserve_size(F.lit(100), F.lit(10_000))) == 100
    assert one(sizes.reserve_size(F.lit(100 * GIB), F.lit(GIB))) == GIB * 0.2
    assert one(sizes.reserve_size(F.lit(100 * GIB), F.lit(1000 * GIB))) == 15 * GIB


def interval(seconds):
    parts = []
    for name, size in (("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60)):
        count, seconds = divmod(seconds, size)
        if count:
            parts.append(f"{int(count)} {name}{'s' if count > 1 else ''}")
    if seconds:
        parts.append(f"{seconds:.2f} second{'' if seconds == 1 else 's'}")
    return ", ".join(parts)


@pytest.mark.parametrize("seconds", [0, 1, 2, 1.5, 59.99, 60, 61, 3600, 3661, 86400, 90061, 604800, 1300000.25, 694861])
def test_format_interval(one, seconds):
    assert one(times.format_interval(F.lit(seconds))) == interval(seconds)


@pytest.mark.parametrize(
    ("name", "ok"),
    [("20240101_000007", True), ("20240230_000000", False), ("20241301_000000", False), ("newest", False),
     ("20240101_000007x", False), ("20240101-000007", False), ("", False), ("20240101_240000", False)],
)
def test_run_names(one, name, ok):
    parsed = times.parse_run_name(F.lit(name))
    assert one(parsed.isNotNull()) is ok
    if ok:
        assert one(times.run_name(parsed)) == name


VISIBLE = string.ascii_letters + string.digits + string.punctuation
NAMES = ["plain", "a b", "x/y", "(q)", "tab\tnl\nnul\0", "é", "日本", "😀z", "", VISIBLE, "\x7f", "a  b", " (20)"]


def test_safe_name(spark):
    got = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", text.safe_name("n")).collect()
    for name, shown in got:
        assert shown == "".join(c if c in VISIBLE else f"({ord(c):x})" for c in name)


def test_path_names_are_unique_and_visible(spark):
    names = NAMES + ["_hidden", ".hidden", "a_b", "a(5f)b", "(20)", "a-b", "A*", "[x]", "a:b", "%41"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.path_name_column("n")).collect()
    for name, shown in got:
        assert shown == text.path_name(name)
        assert not shown.startswith(("_", ".")) and not set(shown) & set("/*[]{}?:% ")
    assert len({shown for _, shown in got}) == len(set(names))


def test_url_quoting(spark):
    got = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", text.quote_url("n")).collect()
    for name, shown in got:
        assert shown == urllib.parse.quote_plus(name)


def test_other_quoting(one):
    assert one(text.quote_double(F.lit('a"b'))) == '"a\\"b"'
    assert one(text.quote_identifier(F.lit("a`b"))) == "`a``b`"


@pytest.mark.parametrize(
    "template",
    ["$a ${b}", "$ab $a_b ${a}b", "$$a $", "${c} $c", "$a$b", "$1 $(a) ${a", "no dollars", "$A", "$b $a", ""],
)
def test_templates(one, template):
    given = {"a": "1", "b": "$a\\1"}
    expected = string.Template(template).safe_substitute(given)
    assert one(text.fill_template(F.lit(template), {"a": F.lit("1"), "b": given["b"]})) == expected


def test_directory_template(one):
    assert one(text.fill_directory(F.lit("cp {backup_data_dir}/x {other}"), F.lit("/d"))) == "cp /d/x {other}"


@pytest.mark.parametrize(
    ("path", "base", "expected"),
    [("/a/b/c", "/a", "b/c"), ("/a", "/a", "."), ("/a/b", "/a/c", "../b"), ("/x", "/a/b", "../../x"), ("/a/b", "/", "a/b"),
     ("/", "/a", ".."), ("//a///b/", "/a/", "b"), ("/ab", "/a", "../ab")],
)
def test_relative_paths(one, path, base, expected):
    assert one(text.relative_to(F.lit(path), base)) == expected


def test_paths_are_moved(one):
    assert one(text.remap_path(F.lit("/mnt/raid10/foo/bar/baz"), "/mnt/raid10", "/mnt/snapshot/")) == "/mnt/snapshot/foo/bar/baz"


def test_names_of_keys_and_archives(one):
    assert one(text.canonical_key(F.lit("a_b-c"))) == "a-b-c"
    assert one(text.kebab_to_camel(F.lit("dump-USER-data"))) == "dumpUserData"
    assert one(text.kebab_to_camel(F.lit("Plain"))) == "Plain"
    assert one(text.archive_name(F.lit("//var/lib"))) == "var_lib.tar"


@pytest.mark.parametrize(
    ("word", "expected"),
    [("yes", True), ("On", True), ("1", True), ("TRUE", True), ("no", False), ("OFF", False), ("0", False), ("2", None), ("t", None)],
)
def test_booleans(one, word, expected):
    assert one(values.to_boolean(F.lit(word))) is expected


@pytest.mark.parametrize(
    ("word", "integer", "number", "octal"),
    [("12", 12, 12.0, 10), (" -7 ", -7, -7.0, -7), ("1.5", None, 1.5, None), ("x", None, None, None), ("1e3", None, 1000.0, None),
     ("0755", 755, 755.0, 493), ("0o17", None, None, 15), ("8", 8, 8.0, None)],
)
def test_numbers(one, word, integer, number, octal):
    assert one(values.to_integer(F.lit(word)), values.to_float(F.lit(word)), values.to_octal(F.lit(word))) == (integer, number, octal)


def test_lists_and_levels(one):
    assert one(values.to_list(F.lit("a, b ,c"))) == ["a", "b", "c"]
    assert one(values.to_list(F.lit(""))) == []
    assert one(values.to_log_level(F.lit(" Warning "))) == 30
    assert one(values.to_log_level(F.lit("loud"))) is None


def test_versions(one):
    assert one(values.parse_version(F.lit("10.4.2"))) == [10, 4, 2]
    assert one(values.parse_version(F.lit("10"))) == [10]
    assert one(values.parse_version(F.lit("10.x"))) is None
    assert one(values.parse_version(F.lit("10.4")) > values.parse_version(F.lit("8.4"))) is True
    assert one(values.find_version(F.lit("server v8.0.36-log"))) == "8.0.36"
    assert one(values.find_version(F.lit("server"))) is None


def test_flatten(one):
    assert one(text.flatten_list(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))))) == [1, 2, 3]
    assert math.isclose(one(sizes.reserve_size(F.lit(10), F.lit(10))), 2.0)
