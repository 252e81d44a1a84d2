"""Queries over the training-data operators, each over its whole table, and the SQL that some are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, js_rules, langmix, maxscore, ngram_trie, packing, pii, quality_zstd, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), quality_zstd.fold
    model = quality_zstd.train(docs, table(spark, sf_dir, "labels"), lambda i: fold(i, 5) != 0)
    return quality_zstd.score(docs, model, lambda i: fold(i, 5) == 0)


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.near_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return js_rules.verdicts(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_langmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), quality_zstd.fold
    model = langmix.learn(docs, lambda i: fold(i, 4) != 2)
    return langmix.predict(docs, model, lambda i: fold(i, 4) == 2)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_maxscore": op2_maxscore,
        "op3_warc": op3_warc,
        "op4_ngram_trie": op4_ngram_trie,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_rules": op6_rules,
        "op7_bpe": op7_bpe,
        "op8_langmix": op8_langmix,
        "op9_pii": op9_pii,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_maxscore": maxscore.ORACLE_SQL,
        "op3_warc": warc.ORACLE_SQL,
        "op4_ngram_trie": ngram_trie.ORACLE_SQL,
        "op5_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op6_rules": js_rules.ORACLE_SQL,
    }
