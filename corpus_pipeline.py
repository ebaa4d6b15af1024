"""Five operators in a row over `documents`: each stage works on all that the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet to the shared
folder and read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from classcraft.llm import bpe, langid, mixing, simhash, suffix_dedup
from classcraft.llm.common import crc_slice, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognisable language, learned from the documents' own labels, stay."""
    model = langid.fit(docs.where(crc_slice("doc_id", 4) != 2))
    return langid.recognised(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.deduplicated(docs, distance=2, shingle=3)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier in the documents."""
    return suffix_dedup.without_repeats(docs, length=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, one row per row of the mix."""
    import public_tokenizers

    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(encoded)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# SimHash components, suffix matches and BPE merges are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
