"""One query per operator, with production parameters, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tablekeep.llm import decontamination, jaccard, language, lm, nearest, packing, pii, prefixes, quality, simhash, spelling, substrings, warc
from tablekeep.llm.oracles import SQL
from tablekeep.llm.settings import SURROGATE_KEY, VOCABULARY


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"), VOCABULARY)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, SURROGATE_KEY, count_col="n_mentions")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.corpus_variants(_table(spark, sf_dir, "documents"), every=31, least=7, occurrences=2)


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.rebuilt_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_decontaminate": op2_decontaminate,
    "op3_lm_scores": op3_lm_scores,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_substrings": op6_substrings,
    "op7_surrogates": op7_surrogates,
    "op8_simhash": op8_simhash,
    "op9_nearest": op9_nearest,
    "op10_language": op10_language,
    "op11_jaccard": op11_jaccard,
    "op12_spelling": op12_spelling,
    "op13_prefixes": op13_prefixes,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
