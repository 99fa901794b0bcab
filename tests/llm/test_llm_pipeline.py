import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tablekeep.llm import decontamination, language, packing, pii, simhash
from tablekeep.llm.settings import SURROGATE_KEY, VOCABULARY

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        out.append(spark.createDataFrame(docs.collect(), docs.schema))
        docs = out[-1]
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_keeps_the_columns_and_decides_on_its_own_input(spark, stages):
    raw, named, single, clean, private = stages
    assert all(df.columns == raw.columns and df.dtypes == raw.dtypes for df in stages)
    assert ids(named) == [r["doc_id"] for r in sorted(language.identified(raw).collect()) if r["lang_pred"] != "und"]
    groups: dict = {}
    for r in simhash.near_duplicates(named).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert ids(single) == sorted(min(group) for group in groups.values()) and len(groups) < named.count()
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert ids(clean) == sorted(r["doc_id"] for r in decontamination.judged(single, bench).collect() if not r["contaminated"])
    assert clean.count() < single.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert ids(private) == ids(clean)
    for r in private.collect():
        assert r["text"] == pii.rewritten(texts[r["doc_id"]], SURROGATE_KEY, {})[0]
        assert r["n_chars"] == len(r["text"])


def test_the_whole_run_packs_what_the_stages_kept(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    mine = corpus_pipeline.run(spark, SF_DIR).select(*key).collect()
    assert sorted(mine) == sorted(packing.pack(stages[-1], VOCABULARY).select(*key).collect())


def test_nulls_and_no_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (None, "the cat and the dog", "en", "s", None), (4, "the cat and the dog", None, "s", 19), (4, "the cat and the dog", None, "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.selectExpr("*", "7L AS mentions", "7L AS Own_Mark", "'a' AS replaced", "7 AS mark", "7 AS `a.b`")
    for table, kept in ((docs, {None, 4}), (docs.limit(0), set()), (clashing, {None, 4})):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF_DIR)
            table = spark.createDataFrame(table.collect(), table.schema)
        assert {r["doc_id"] for r in table.collect()} == kept


def test_registered():
    names = entry.queries()
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None
