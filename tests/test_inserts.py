from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from tablekeep.operators.dump import to_insert_sql
from tablekeep.sources.inserts import from_insert_sql

SCHEMA = "k long, t string, d double, b boolean, x binary, at timestamp_ntz, l array<string>"


@pytest.mark.parametrize("extended", [False, True])
def test_every_type_comes_back(spark, extended, as_rows):
    texts = ["", "NULL", "it's (a, b); 'c'", "line\nbreak\r\\n \\' \0", "\\", "x" * 50_000 + "\n'," * 5_000, None, "  ", "é 漢 \U0001f600"]
    rows = [(k, t, -1.5e10 * k, k % 2 == 0, bytearray(b"\x00'\\") * k, datetime(2024, 1, 2, 3, 4, 5, k), ["a'", None, t]) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None,) * 7], SCHEMA)
    statements = to_insert_sql(df, "odd `t` VALUES (1)", extended=extended, hex_blob=True, key="k", chunk_bytes=200)
    assert as_rows(from_insert_sql(statements, df.schema)) == as_rows(df)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="'\\n\r\0\n,()NULa ;`")), min_size=1, max_size=8))
def test_any_text_comes_back(spark, as_rows, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    assert as_rows(from_insert_sql(to_insert_sql(df, "t", key="k"), df.schema)) == as_rows(df)


@pytest.mark.parametrize("text", ["DELETE FROM t;", "INSERT INTO t VALUES (1,2", "INSERT INTO t VALUES (1,2,3);", "INSERT INTO t VALUES ('\uf8f0',2);"])
def test_what_is_no_statement_is_an_error(spark, text):
    schema = spark.createDataFrame([], "a string, b long").schema
    with pytest.raises(PySparkException):
        from_insert_sql(spark.createDataFrame([(text,)], "statement string"), schema).collect()


def test_blank_lines_are_left_out(spark):
    schema = spark.createDataFrame([], "a long").schema
    lines = spark.createDataFrame([(None,), ("  ",), ("INSERT IGNORE INTO t VALUES (4),(5);",)], "statement string")
    assert [r[0] for r in from_insert_sql(lines, schema).collect()] == [4, 5]
