from pathlib import Path

from tablekeep.sources import documents

LINES = [
    '{"a": 1, "b": {"c": [1, "x", null, {"d": 2.5}]}}',
    '{"a": "one", "b": 3}',
    '{"a": null, "n": 1}',
    '{"n": 1.5, "a b": true}',
    "[1, 2]",
    '"text"',
]


def written(spark, folder, lines=LINES):
    Path(folder, "docs").mkdir()
    Path(folder, "docs", "part.json").write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    return documents.scan_variants(spark, f"{folder}/docs")


def test_fields_are_counted_by_type_at_any_depth(spark, folder):
    found = {(r["path"], r["type"]): r["n"] for r in documents.field_catalog(written(spark, folder)).collect()}
    assert found == {
        ("$", "OBJECT"): 4, ("$", "ARRAY"): 1, ("$", "STRING"): 1, ("$[]", "BIGINT"): 2,
        ("$.a", "BIGINT"): 1, ("$.a", "STRING"): 1, ("$.a", "VOID"): 1, ("$.a b", "BOOLEAN"): 1,
        ("$.b", "OBJECT"): 1, ("$.b", "BIGINT"): 1, ("$.b.c", "ARRAY"): 1,
        ("$.b.c[]", "BIGINT"): 1, ("$.b.c[]", "STRING"): 1, ("$.b.c[]", "VOID"): 1, ("$.b.c[]", "OBJECT"): 1,
        ("$.b.c[].d", "DECIMAL"): 1, ("$.n", "BIGINT"): 1, ("$.n", "DECIMAL"): 1,
    }


def test_one_type_holds_all_values_of_a_path(spark, folder):
    types = documents.field_types(documents.field_catalog(written(spark, folder)))
    found = {r["path"]: (r["type"], r["conflict"]) for r in types.collect()}
    assert found["$.n"] == ("DOUBLE", True)
    assert found["$.a"] == ("VARIANT", True)
    assert found["$.a b"] == ("BOOLEAN", False)
    assert found["$.b.c[].d"] == ("DOUBLE", False)


def test_columns_are_cut_out_and_documents_kept(spark, folder):
    docs = written(spark, folder)
    cut = documents.cut_columns(docs, {"a": ("bigint", "$.a", "$.b"), "d": ("double", "$.b.c[3].d")})
    assert cut.columns == ["a", "d", "doc"] and cut.count() == len(LINES)
    assert sorted(((r["a"], r["d"]) for r in cut.select("a", "d").collect()), key=repr) == sorted(
        [(1, 2.5), (3, None), (None, None), (None, None), (None, None), (None, None)], key=repr
    )


def test_no_documents(spark, folder):
    docs = written(spark, folder, [])
    assert documents.field_catalog(docs).collect() == documents.field_types(documents.field_catalog(docs)).collect() == []
