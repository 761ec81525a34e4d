"""A training-corpus pipeline of five stages over ``documents``; counted as part of ``tracewright.llm``.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import language_id, minhash, mixing, packing, substring
from tracewright.llm.storage import Scratch, table


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be found go."""
    return language_id.identified(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def stage_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occur earlier are cut; documents of nothing else go."""
    return substring.corpus(docs, window=20)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture of their sources, file by file."""
    return mixing.mixture(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens, numbered in the order of the mixture."""
    docs = mixing.numbered(docs)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=0, shard_pieces=1024, order=docs.columns[-1])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language),
    ("minhash_dedup", stage_near_duplicates),
    ("substring_dedup", stage_repeated_passages),
    ("source_mixing", stage_mixing),
    ("best_fit_packing", stage_packing),
]

#: Language models, the schedule and bin packing have no SQL form; tests/llm/test_pipeline.py compares a run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
