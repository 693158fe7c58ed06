"""Quality rules, near-duplicate removal, mixing and packing of documents, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common, mix, pack, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't rejected, with their columns as they were. Null and empty texts fail, null hosts are one host; equal rows fare alike; empty tables stay empty."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of copies and near copies (five-word shingles, similarity 0.8). Null counts as the empty text; of equal rows one stays; columns pass through; empty tables stay empty."""
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shuffled in shards. Null sources are one source; equal rows are taken alike; columns pass through; empty tables stay empty."""
    return mix.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids. Null counts as the empty text (its end id alone); equal rows are documents of their own; other columns are ignored; empty tables give no row."""
    return pack.pack_documents(docs, kept=150_000)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packing)]

#: Fingerprints, hash order and tokenizer are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
