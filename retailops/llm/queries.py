"""Registered queries of this folder: opN_<name> and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_tree, context_mixing, decontaminate, filter_audit, hard_negatives, html_extract, language_id, pii_tagger, quality_rules,
               simhash_dedup, token_counts, token_file, url_filter)
from .common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 5) == 0)
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return context_mixing.score(docs.withColumn("held_out", fold("doc_id", 7) == 2))


#: The contract's rules.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.id_file_digests(table(spark, sf_dir, "documents", "doc_id", "text"),
                                      public_tokenizers.path("word_bpe_49k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"),
                                      table(spark, sf_dir, "benchmark", "item_id", "text"), similarity=0.8, radius=20)


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.bpe_round_trip(table(spark, sf_dir, "documents", "doc_id", "text"),
                                   public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"), width=4, radius=4)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"),
                                     public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", label.alias("label"), (F.col("vec_id") % 50 == 0).alias("anchor")),
                               scale=256, positives=5, negatives=3, low=50, high=95)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii_tagger.find(docs, pii_tagger.fit(docs))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_orders(filter_audit.document_masks(table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                                                                 table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_lm_score, op3_url_filter, op4_quality_rules, op5_html_extract, op6_token_file, op7_decontaminate, op8_bpe_tree,
    op9_simhash_dedup, op10_token_counts, op11_hard_negatives, op12_pii, op13_filter_audit)}
#: DuckDB SQL of the queries that it can express.
ORACLE: dict[str, str] = {"op3_url_filter": url_filter.oracle_sql(URL_RULES), "op11_hard_negatives": hard_negatives.ORACLE_SQL,
                          "op13_filter_audit": filter_audit.ORACLE_SQL}
