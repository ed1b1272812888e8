"""From raw documents to packed training sequences: stages in order, each reading what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemosa.llm import mixing, toxicity
from mnemosa.llm.near_dedup import one_of_each
from mnemosa.llm.packing import packed
from mnemosa.llm.shared import Tables
from mnemosa.llm.substring_dedup import strip_repeats


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector, trained on the labels of docs, scores under its threshold of 0.3."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near-duplicates, one with the smallest doc_id; ids may repeat or be null."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that occur elsewhere too."""
    return strip_repeats(docs)


def soft_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that high- and low-quality tokens meet their target shares."""
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", mixing.domain_of_label().alias("domain"))
    return mixing.mixed_rows(docs, labelled)


def best_two_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity_filter", toxicity_filter),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("soft_mixing", soft_mixing),
    ("best_two_fit", best_two_fit),
]

#: Classifiers, tokenizers and iterative fits have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is a table in the shared folder."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.write(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
