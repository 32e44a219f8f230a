"""The corpus pipeline: documents are selected, deduplicated, decontaminated, mixed and written as token IDs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontaminate, mixing, quality, records, simhash
from veilspark.llm.common import drop_dir, shared_dir, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document may come in part, and again."""
    return mixing.mix(docs)


def write_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token IDs in binary records; the digest of what was read back from them."""
    return records.write_and_read(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_records),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds each stage, and all of them, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's table goes once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_dir(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # its files are written, and what's returned reads them
    drop_dir(spark, last)
    return out
