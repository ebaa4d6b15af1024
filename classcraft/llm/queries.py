"""The queries of the training-data operators, (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classcraft.llm import ann_dedup, bpe, langid, lm_score, mixing, periodic, phrase_index, quality, simhash, suffix_dedup, url_filter, warc, whitening
from classcraft.llm.common import crc_slice, table


# The rules of the contract: host, path prefix, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


def op1_ann_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_slice("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    out = langid.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_slice("doc_id", 7) == 2
    out = lm_score.score(table(spark, sf_dir, "documents"), held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=2, shingle=3)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                   public_tokenizers.PATTERN)
    return bpe.digests(encoded)


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted().alias("text"))
    return periodic.digests(periodic.periodic_runs(docs))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_dedup": op1_ann_dedup, "op2_langid": op2_langid, "op3_lm_score": op3_lm_score, "op4_quality": op4_quality,
    "op5_suffix": op5_suffix, "op6_url_filter": op6_url_filter, "op7_warc": op7_warc, "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash, "op10_bpe": op10_bpe, "op11_phrase_index": op11_phrase_index, "op12_periodic": op12_periodic,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op7_warc": warc.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op11_phrase_index": phrase_index.ORACLE_SQL}
