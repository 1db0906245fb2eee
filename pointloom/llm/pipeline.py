"""The corpus pipeline: five stages over documents, each written and read again before the next.

language: documents whose language cannot be told are dropped, lang becomes the prediction.
near_duplicates: of every component of near copies the smallest id stays.
decontaminate: documents that hold a benchmark item within its error budget are dropped.
secrets: secret spans are masked; every document stays.
mix: documents are selected per source to the target weights, from seeded epochs, with their texts.

Edge cases, by stage. Null and empty texts: dropped by language. Null ids: kept by every stage; near_duplicates
leaves such rows alone. Repeated rows: near_duplicates keeps one row an id, the least by its columns; the other
stages treat rows one by one. Null lang or source: predicted, or a child of its own in mix. Empty tables give
empty tables. Further columns pass through all stages but mix, which returns doc_id, domain, lang, source, epoch,
n_tokens, take_tokens and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import decontam, langid, mixing, ngram_join, secrets
from pointloom.llm.common import stored

#: Target weights of the mixing stage and query, by child name.
MIX = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0, "d0": 3.0, "d1": 2.0, "src3": 2.0}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.with_texts(mixing.mix_sources(docs, budget=0.5, weights=MIX, digest=True), docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("mix", mix),
]

#: No stage but near duplicates and mixing can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
