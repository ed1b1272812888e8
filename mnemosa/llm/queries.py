"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, filter_audit, hard_negatives, media, mixing, near_dedup, quality_model, quality_rules, substring_dedup, toxicity, url_filter, warc
from .near_dedup import near_duplicates
from .packing import packed
from .substring_dedup import digest, remove_repeats


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = warc.captures_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.flat_headers(warc.resolve(warc.read_records(warc.write_records(crawl))))


def op3_tar_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op5_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    return chat_format.digests(chat_format.format_trees(chat_format.threads(rows.unionByName(chat_format.planted(rows)))))


def op7_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_soft_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labels(spark, sf_dir).select("doc_id", mixing.domain_of_label().alias("domain"))
    return mixing.mix(_documents(spark, sf_dir), labelled)


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(_documents(spark, sf_dir)))


def op10_line_first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_figures(_documents(spark, sf_dir))


def op11_filter_order_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op12_shift_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity_bigru, op2_warc_revisits, op3_tar_media_columns, op4_minmax_near_dedup, op5_best_two_fit_packing, op6_reply_tree_chat, op7_random_indexing_quality, op8_soft_domain_mixing, op9_recompression_dedup, op10_line_first_rules, op11_filter_order_replay, op12_shift_and_urls, op13_ball_tree_negatives)}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, trained models and stored files have no SQL; their queries are tested against brute force."""
    return {
        "op2_warc_revisits": warc.SQL,
        "op4_minmax_near_dedup": near_dedup.SQL,
        "op6_reply_tree_chat": chat_format.SQL,
        "op9_recompression_dedup": substring_dedup.SQL,
        "op10_line_first_rules": quality_rules.SQL,
        "op11_filter_order_replay": filter_audit.SQL,
        "op12_shift_and_urls": url_filter.SQL,
        "op13_ball_tree_negatives": hard_negatives.SQL,
    }
