"""The corpus pipeline over ``documents``: language ID, quality rules, SimHash
near-dedup, benchmark decontamination, byte-level BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
calls one of the operators, and returns the columns of documents; the last one
returns each kept document's encoding. A stage is written as Parquet in the
shared checkpoint folder and read again as the next one's docs.

Defined results: a null or empty text is rejected by the first stage (no
letter); repeated rows count as one group of copies and leave one row; a null
doc_id passes the filters and never wins a group that has a doc_id; an empty
table leaves an empty result; extra columns pass through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from retailops.llm import bpe_tree, decontaminate, language_id, quality_rules, simhash_dedup
from retailops.llm.common import fold, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language of at least even odds go."""
    model = language_id.fit(docs.where(fold("doc_id", 5) != 0))
    return language_id.keep_identified(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base check or are more likely bad than good go."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within 4 bits over four-word shingles stays."""
    return simhash_dedup.keep_first(docs, width=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded bytes."""
    return bpe_tree.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", identify_language), ("quality_rules", apply_quality_rules),
          ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]

#: SQL can express none of the stages in full; each is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
