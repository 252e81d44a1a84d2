"""The corpus pipeline: quality, near duplicates, repeats, personal data, packing.

Each stage takes the whole of what the stage before it kept, as a written table, and all but the last give back the
columns of `documents`.

Defined cases, in every stage: a null text counts as empty (scored as such, in no class of near duplicates, without
repeats or identifiers, packed as one closing id) and stays null in the table; a null id stays null, and such rows are
rows like others; repeated rows are scored, cleaned and packed each, but near duplicates leave one of them; long texts are
taken whole; of copies the least id stays, ties go to the least hash; further columns, also of names that operators use
themselves, are carried through all stages but the last; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import ngram_trie, packing, pii, quality_zstd, suffix_dedup
from stratakv.llm.workdir import Table

ORACLE_SQL = None
BROADCAST_IDS = 500_000  # ids of 8 bytes; more are joined by a shuffle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the compression classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_zstd.train(docs, labels, lambda i: quality_zstd.fold(i, 5) != 0)
    return quality_zstd.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share five-word n-grams to a similarity of 0.8: that of the least id, a null
    id after all others. Rows go by id and text: of repeated rows, with an id or without, one stays, and of rows of one id
    only those whose own text is in another's class go. Texts without words are in no class and all stay."""
    found = Table(ngram_trie.surplus(docs, n=5, num=80, den=100), "near-duplicates").df
    small = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "kept")
    same = lambda d: d.doc_id.cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(d.text.cast("string")) == F.col("__hash"))
    pick = lambda x: F.broadcast(x) if small else x
    left = docs.join(pick(named), same(docs), "left_anti")
    if not named.filter("kept").limit(1).count():
        return left
    copies = docs.join(pick(named.filter("kept")), same(docs), "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = copies.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash")).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row"))
    return left.unionByName(one.select("__row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur more than once."""
    return suffix_dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with identifiers masked."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = Table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
