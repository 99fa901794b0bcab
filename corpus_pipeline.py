"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written and read again as the ``docs`` of the next one. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm import decontamination, language, packing, pii, simhash
from tablekeep.llm.common import settle, unused
from tablekeep.llm.settings import SURROGATE_KEY, VOCABULARY


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    return language.with_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose fingerprints are linked, that of the smallest id."""
    return simhash.deduplicated(docs, width=3, max_distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or re-parameterised."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates and counts the characters anew where texts changed."""
    mentions = unused(docs, "mentions")
    new = pii.pseudonymised(docs, SURROGATE_KEY, count_col=mentions)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new = new.withColumn("n_chars", F.when(F.col(mentions) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return new.drop(mentions)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Fingerprints, learned models and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is settled before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
