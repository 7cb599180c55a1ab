"""Training-data pipeline: five stages over ``documents``, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and
the next stage reads that.  The first four return the columns of ``documents``; the last returns
the packed pieces.  Null texts pass through and are packed as empty ones; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.bradley_terry import filter_quality
from tracelake.llm.ngram_join import drop_near_duplicates
from tracelake.llm.packing import pack
from tracelake.llm.pfp_dedup import remove_repeats
from tracelake.llm.pii_crf import mask_personal_data
from tracelake.llm.session import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score lies at or above the learned quantile."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur elsewhere too."""
    return remove_repeats(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return mask_personal_data(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and offset that each takes."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]
#: No SQL expresses the classifier, the field or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them goes to the shared folder."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
