"""From raw documents to token ids: quality, exact and near duplicates, benchmark leaks, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinlake.checkpoints import drop_folder, shared_folder
from twinlake.llm import decontaminate, exact_dedup, near_dup, quality
from twinlake.llm.queries import bpe_digests, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("MinHash near-dedup", distinct_shingles),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: SQL cannot express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is written to the shared folder and read again, so later stages do not repeat it and
    a lost executor costs at most the work of one stage; a stage's table is deleted once the next is written.

    Null texts are empty, and so are told apart by no stage: of rows with empty texts one stays. Rows that repeat
    an id, null too, are rows of their own and go by their texts. Other columns come along to the last stage, whatever
    their names. An empty table gives an empty one."""
    rows, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        folder = shared_folder(spark, f"stage{k}")
        stage(spark, rows, sf_dir).write.parquet(folder)
        rows = spark.read.parquet(folder)
        if before:
            drop_folder(spark, before)
        before = folder
    return rows
