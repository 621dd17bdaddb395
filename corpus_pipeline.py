"""A training-data pipeline over ``documents``.

Quality rules and the quality classifier drop documents, near-duplicates leave
one of each group, the mix draws sources towards their target weights, and the
result is encoded as tokens.  Every stage is written as Parquet and read back
as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import bpe, mixing, near_dup, quality_model, quality_rules
from sparquill.llm.common import Scratch, small_batches, table

#: Word shingles and threshold of the near-duplicate stage.
NEAR = near_dup.Rule(words=5, percent=80)
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learnt fences keep, with all columns.

    Null, empty and very short texts fail the base rules and go; repeated rows count
    each and are judged alike; nulls in lang and source are groups of their own; an
    empty table stays empty."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like those labelled good, with all columns.

    The model learns from the original documents and labels, so what earlier stages
    drop makes no difference to it; without usable labels all documents stay.
    Null and empty texts count as the share of good ones; repeated rows are judged alike."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, with all columns.

    Null and empty texts are near nothing and stay, as do rows without doc_id; of
    rows that repeat a doc_id one stays for each group it is the smallest of."""
    return near_dup.drop_near_duplicates(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row for each pass over it, with all columns.

    Documents without words, or of which nothing is taken, go; null sources are a
    source; of rows that are alike in all columns each is mixed."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding gave the text back.

    A row for each row: null and empty texts have no ids, repeated rows equal ones."""
    import public_tokenizers

    return bpe.encode_table(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ("doc_id", "lang", "source"))


def in_small_batches(stage: Callable) -> Callable:
    """A stage that holds its session's Arrow batches small, whichever ran before it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", in_small_batches(rules)),
    ("quality classifier", in_small_batches(classifier)),
    ("near duplicates", in_small_batches(dedup)),
    ("mixing", in_small_batches(mix)),
    ("byte-level BPE", in_small_batches(encode)),
]

#: The learnt stages cannot be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        used, docs = docs, scratch.staged(stage(spark, docs, sf_dir), "stage")
        scratch.drop(used)
    return STAGES[-1][1](spark, docs, sf_dir)
