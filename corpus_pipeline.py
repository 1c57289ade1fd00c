"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Toxic documents go, then exact duplicates, then near duplicates; what is left is mixed by source
and packed into sequences.  Every stage keeps extra columns of ``documents``, whatever their names,
and takes an empty table.  Without the training-data operators this module can't be imported.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timeweave.llm import bagminhash, exact_dedup, mixing, packing, toxicity
from timeweave.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxic go; null and empty texts stay, each of repeated rows is judged by its own text."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to the case of A-Z the row with the largest id stays, nulls counting as empty texts and as the smallest ids."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the row with the smallest id stays, a null id coming last; texts without words stay."""
    return bagminhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in order of virtual finish time: a document that it takes twice is there twice, one without words not at all."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 1024 tokens; a repeated row is packed each time."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), max_len=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: the first, third and last stages train a model, sketch and run a tokenizer.  All five are
#: held against a brute-force version in tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the pipeline's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
