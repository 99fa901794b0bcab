import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablekeep.functions import globs

PATTERN_TEXT = st.text(alphabet="ab.B[]!-*?^\\&~#$()é\n", max_size=8)
NAME_TEXT = st.text(alphabet="ab.B[]!-^\\&~#$()éÉ\n", max_size=6)

PATTERNS = [
    "*", "?", "", "a*", "*.b", "[ab]*", "[!ab]*", "[]a]*", "[!]a]*", "[]", "[!]", "[a", "a]", "[a-c]x", "[c-a]x",
    "[!c-a]x", "[-a]", "[a-]", "[^a]", "[a&&b]", "[a[b]", "x.y", "x+y", "(x)", "a|b", "$", "\\E", "\\Q", "É*", "a#b c", "{1}",
]
NAMES = [
    "", "a", "A", "b", "c", "x", "ax", "bx", "cx", "-", "^", "&", "[", "]", "[]", "[!]", "[a", "a]", "x.y", "xzy", "x+y",
    "xxy", "(x)", "a|b", "$", "\\E", "\\Q", "é", "ÉCOLE", "a#b c", "{1}", "a\n", "a\nb", "q.b", "z", "[^", "!",
]


def shell_match(pattern, name):
    return re.match(fnmatch.translate(pattern), name, re.I | re.M | re.U) is not None


def test_java_regex_equals_shell_rules(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = names.select("name", *(globs.include_glob("name", p).alias(str(i)) for i, p in enumerate(PATTERNS))).collect()
    for row in got:
        for i, pattern in enumerate(PATTERNS):
            assert row[i + 1] == shell_match(pattern, row["name"]), (pattern, row["name"])


@settings(max_examples=500, deadline=None)
@given(PATTERN_TEXT, NAME_TEXT)
def test_translation_equals_shell_rules(pattern, name):
    mine = re.match(rf"(?is)\A(?:{globs.glob_to_regex(pattern)})\Z", name) is not None
    assert mine == shell_match(pattern, name)


def test_empty_pattern_lists(one):
    assert one(globs.include_glob(F.lit("a"))) is False
    assert one(globs.exclude_glob(F.lit("a"))) is True
    assert one(globs.include_regex(F.lit("a"))) is False
    assert one(globs.exclude_regex(F.lit("a"))) is True


def test_qualified_patterns(one):
    db, name = F.lit("shop"), F.lit("orders")
    assert one(globs.include_glob_qualified(db, name, "orders")) is True
    assert one(globs.include_glob_qualified(db, name, "other.orders")) is False
    assert one(globs.exclude_glob_qualified(db, name, "SHOP.*")) is False


@pytest.mark.parametrize(
    ("pattern", "name", "matches"),
    [("a", "abc", True), ("b", "abc", False), ("^b", "a\nb", False), ("a$", "a\nb", True), (r"\w+$", "éa", True)],
)
def test_regex_is_anchored_at_the_start_only(one, pattern, name, matches):
    assert (re.match(pattern, name, re.I | re.M | re.U) is not None) is matches
    assert one(globs.include_regex(F.lit(name), pattern)) is matches
